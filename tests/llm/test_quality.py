import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 5]) for i in range(n - 4))
    five = {j for i in range(n - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    cover = {j for i in range(n) if best[i] >= quality.LEAST_REPEAT for j in range(i, i + best[i])}
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(five), sum(len(words[j]) for j in cover), max(best, default=0)]


def check(texts):
    got = quality.measures([(t or "").encode() for t in texts])
    assert got.values.tolist() == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "a b c", "\n", " \t", "#|", " ", "\x1c"]), max_size=60).map(" ".join), min_size=1, max_size=6))
def test_equals_brute_force(texts):
    check(texts)


def test_long_and_repeated():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    check([passage + "\nx\n" + passage, "a " * 300, "", None, "   ", " ".join(rnd.choice(words) for _ in range(400)), "x", passage])


def thue_morse(halvings):
    """Two strings that polynomial hashes modulo a power of two can't tell apart."""
    a, b = "a", "b"
    for _ in range(halvings):
        a, b = a + b, b + a
    return a, b


def test_lines_that_simple_hashes_confuse():
    for halvings in (10, 11, 12):
        a, b = thue_morse(halvings)
        check([f"{a}\n{b}", f"{a}\n{b}\n{a}", " ".join([a, "x", "y", "z", "w"]) + " " + " ".join([b, "x", "y", "z", "w"])])


def test_what_only_the_repeats_reject(spark, documents):
    rnd = random.Random(8)
    own = lambda n: " ".join(str(rnd.randrange(10**9)) for _ in range(n))
    passage = own(250)
    rows = [(1, passage + " " + own(6000) + " " + passage), (2, own(6000)), (3, own(15) + " " + own(3000))]
    got = {r.doc_id: (r.quality.base_failed, r.quality.kept) for r in quality.assess(documents(rows)).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (False, True)}


def test_rules(spark, documents):
    rnd = random.Random(4)
    clean = " ".join(f"{rnd.randrange(10**6)}" for _ in range(300))
    passage = " ".join(str(rnd.randrange(10**6)) for _ in range(30))
    rows = [(1, clean), (2, "too short"), (3, None), (4, ""), (5, "la " * 50), (6, passage + " " + clean + " " + passage), (7, clean), (7, clean)]
    docs = documents(rows).withColumnRenamed("source", "n_words").withColumnRenamed("lang", "kept")
    got = [(r.doc_id, r.quality.base_failed, r.quality.kept) for r in quality.assess(docs).collect()]
    assert sorted(got) == [(1, False, True), (2, True, False), (3, True, False), (4, True, False), (5, True, False), (6, False, False), (7, False, True), (7, False, True)]
    assert quality.assess(docs.limit(0)).count() == 0


def test_union_of_spans():
    assert quality.covered(np.array([0, 3, 0, 0, 0, 1, 0])).tolist() == [False, True, True, True, False, True, False]


def test_memory_follows_a_chunk_not_the_batch():
    rnd = random.Random(4)
    texts = pd.Series([" ".join(rnd.choices(["ab", "cde", "fghi", "jklmn"], k=500)) for _ in range(1200)])
    tracemalloc.start()
    try:
        got = pd.concat(quality._measured.func(iter([texts])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == len(texts) and (got["n_words"] == 500).all()
    assert peak < 40e6
