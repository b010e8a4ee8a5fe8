import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from earshot.llm import anchors, exchange
from earshot.llm.q_anchors import SQL, op10_anchors
from test_quality import thue_morse


def brute(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_packing():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 1000):
        v = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        assert (exchange.unpacked(exchange.packed(v)) == v).all()
    rows = exchange.entries(3, v, np.zeros(len(v), np.uint8), 7, 64)
    assert (np.concatenate([exchange.unpacked(p) for p in rows["packed"]]) == v).all() and len(rows) == 7


@pytest.mark.parametrize("window, chunk_bytes", [(35, 2000), (5, 500), (6, 4_000_000)])
def test_equals_brute_force(spark, documents, window, chunk_bytes):
    rnd = random.Random(window)
    vocabulary = [f"w{i}" for i in range(3 if window < 10 else 60)] + ["é\x1c", "漢"]
    passage = [rnd.choice(vocabulary) for _ in range(80)]
    texts = []
    for _ in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 90))]
        for _ in range(rnd.randrange(3)):
            i, n = rnd.randrange(50), rnd.randrange(window - 2, 80)
            words[rnd.randrange(len(words) + 1):0] = passage[i:i + n]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(words))
    texts += [texts[0], texts[1], None, "", " ", "la " * 100, "x " * window, "y " * (window - 1), " ".join(passage)]
    docs = documents(list(enumerate(texts))).withColumnRenamed("lang", "chunk").withColumnRenamed("source", "key")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in anchors.remove_repeats(docs, window=window, chunk_bytes=chunk_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)
    assert anchors.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_rows(spark, documents):
    text = " ".join(map(str, range(60)))
    out = anchors.remove_repeats(documents([(1, text), (1, text), (None, "a b"), (2, " ".join(map(str, range(34))))])).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.n_repeats) for r in out) == [("1", 60, 1), ("1", 60, 1), ("2", 0, 0), ("None", 0, 0)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({SQL})").fetchall())
    got = op10_anchors(spark, sf).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    full = dict(zip(texts, brute(texts.values(), 35)))
    assert all(r.kept_sha256 == hashlib.sha256(full[r.doc_id][2].encode()).hexdigest() for r in got)


def test_texts_that_simple_hashes_confuse(spark, documents):
    rnd = random.Random(11)
    a, b = thue_morse(10)
    own = [str(rnd.randrange(10**9)) for _ in range(34)]
    rows = [(None, " ".join([*own[:20], w, *own[20:]])) for w in (a, b)]  # one NULL key
    got = sorted((r.n_removed, r.n_words) for r in anchors.remove_repeats(documents(rows)).collect())
    want = sorted((t[1], t[0]) for t in brute([t for _, t in rows], 35))
    assert got == want
