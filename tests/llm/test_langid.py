import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from earshot.llm import langid
from earshot.llm.q_langid import op6_langid

A = ["the cat and the dog", "that thing there", "another day with them", "The Cat! 42"]
B = ["der hund und die katze", "über das ding dort", "ein anderer tag", "Ünd"]


def plain(text):
    out = " "
    for ch in text:
        ch = ch.lower() if ch.isalpha() else " "
        if ch != " " or out[-1] != " ":
            out += ch
    return out


def brute_model(texts):
    """Kneser-Ney probabilities by the textbook, over padded text."""
    top = Counter()
    for t in texts:
        s = "   " + plain(t)
        top.update(s[i - 3:i + 1] for i in range(3, len(s)))
    counts = {4: top}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


def brute_p(counts, letters, gram):
    k = len(gram)
    if k == 0:
        return 1 / letters
    c = counts[k]
    n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    d = n1 / (n1 + 2 * n2) if n1 else 0.5
    with_context = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
    total = sum(with_context.values())
    below = brute_p(counts, letters, gram[1:])
    return max(c[gram] - d, 0) / total + d * len(with_context) / total * below if total else below


def test_model_equals_textbook(spark):
    docs = spark.createDataFrame([(t, "a") for t in A] + [(t, "b") for t in B], "text string, lang string")
    tables = [t.toPandas() for t in langid.order_counts(langid.count_grams(docs))]
    model = langid.interpolated(["a", "b"], tables)
    a, b = brute_model(A), brute_model(B)
    letters = len(set(a[1]) | set(b[1])) + 1
    table = langid.letter_table()
    for text in ["the hund there", "Über!  a", "tag", "x", *A, *B]:
        c, first = langid.characters([text], table)
        got = model.log_likelihoods(langid.gram_keys(c, first))
        s = "   " + plain(text)
        for i in range(3, len(s)):
            if s[i] in a[1] or s[i] in b[1]:
                want = [math.log(brute_p(m, letters, s[i - 3:i + 1])) for m in (a, b)]
                assert got[i - 3].tolist() == pytest.approx(want, rel=1e-4), (text, i)
    # texts of one batch do not influence each other
    texts = ["the cat", "", "?", None, "der hund", "漢字"]
    together, apart = langid.score(texts, model, table), pd.concat([langid.score([t], model, table) for t in texts], ignore_index=True)
    assert together.equals(apart) and together["best"].tolist()[:5] == [0, -1, -1, -1, 1]


def test_logistic():
    rnd = np.random.default_rng(3)
    x = rnd.exponential(2, 5000)
    right = rnd.random(5000) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))
    assert langid.logistic(x, right) == pytest.approx((0.3, 0.8), abs=0.15)
    assert all(map(math.isfinite, langid.logistic(x, np.ones(5000, bool))))


def test_defined_cases(spark, documents):
    rnd = random.Random(1)
    make = lambda words, n: " ".join(rnd.choice(" ".join(words).split()) for _ in range(n))
    rows = [(i, make(A if i % 2 else B, 40), "a" if i % 2 else "b", "s", 1) for i in range(60)]
    rows += [(100, None, "a", "s", 1), (101, "12 ?!", "a", "s", 1), (102, "", None, "s", 1), (103, "the dog " * 30000, None, "s", 1), (103, "the dog", None, "s", 1), (None, "die katze", "b", "s", 1)]
    docs = documents(rows).withColumnRenamed("source", "score")
    out = {r.doc_id: r.language for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(out[i].lang_pred == ("a" if i % 2 else "b") for i in range(60)) and out[103].lang_pred == "a" and out[None].lang_pred == "b"
    assert {(out[i].lang_pred, out[i].score, out[i].rejected) for i in (100, 101, 102)} == {("und", 0.0, True)}
    assert all(0 <= r.score <= 1 for r in out.values())
    nothing = langid.fit(docs.limit(0))
    assert {r.language.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), nothing).count() == 0


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op6_langid(spark, sf).collect()
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
