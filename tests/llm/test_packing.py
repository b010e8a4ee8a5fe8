import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from earshot.llm import configurations, packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def first_fit(lengths, capacity):
    rooms = []
    for s in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= s), None)
        if at is None:
            rooms.append(capacity - s)
        else:
            rooms[at] -= s
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=12))
def test_plan_holds_exactly_the_pieces(histogram):
    found, bound = configurations.plan(histogram, 40)
    used = Counter()
    for configuration, times in found:
        assert times > 0 and sum(s * n for s, n in configuration) <= 40
        for s, n in configuration:
            used[s] += n * times
    assert used == Counter({s: n for s, n in histogram.items() if n})
    sequences = sum(n for _, n in found)
    assert bound - 1e-6 <= sequences <= first_fit(used.elements(), 40) + len(used)


def test_plan_is_near_its_bound_at_any_count():
    rnd = random.Random(1)
    few = {rnd.randrange(1, 2048): rnd.randrange(1, 60) for _ in range(700)}
    for scale in (1, 10 ** 7):
        found, bound = configurations.plan({s: n * scale for s, n in few.items()}, 2048)
        assert bound <= sum(n for _, n in found) * (1 + 1e-9) and sum(n for _, n in found) <= 1.02 * bound + 2
        assert len(found) < 5000
    assert configurations.plan({3: 10 ** 12}, 6) == ([(((3, 2),), 5 * 10 ** 11)], 5 * 10 ** 11)


def brute_pieces(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    first = len(ids) % 2048 or 2048
    cuts = [0, *range(min(first, len(ids)), len(ids), 2048), len(ids)]
    return [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["the", "naïve", "straße", "x1", "  ", "\n\n", "'s", "don't", "日本語", "🙂", "!!", "2024", "<|endoftext|>"]
    long = " ".join(rnd.choices(words, k=9000))
    return [None, "", " ", "\x00", "'s", *[" ".join(rnd.choices(words, k=rnd.randrange(1, 900))) for _ in range(60)], long, long, "a" * 5000]


def test_pieces_equal_the_tokenizer(spark, documents, texts):
    docs = documents([(i if i else None, t) for i, t in enumerate(texts)]).withColumnRenamed("n_chars", "length")
    got = defaultdict(list)
    for r in packing.pieces(docs, PATH, PATTERN).withColumn("crc", F.crc32("ids")).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.crc))
    assert {k: sorted(v) for k, v in got.items()} == {(i if i else None): brute_pieces(t) for i, t in enumerate(texts)}


def test_sequences_have_no_gaps(spark, documents, texts):
    docs = documents([(i, t) for i, t in enumerate(texts * 3)] + [(1, "one two")] * 300).repartition(5)
    pieces = packing.pieces(docs, PATH, PATTERN).drop("ids").withColumn("slot", F.lit("own"))
    rows = packing.pack(pieces).collect()
    assert len(rows) == pieces.count() and {r.slot for r in rows} == {"own"}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= first_fit([r.length for r in rows], 2048)


def test_odd_lengths_and_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, 0), (3, 9), (4, 8), (5, -1)], "sequence long, length int")
    got = {r.sequence: (r.place is None, r.offset) for r in packing.pack(rows, capacity=8, sequence="place").collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (True, None), 4: (False, 0), 5: (True, None)}
    assert packing.pack(rows.limit(0)).count() == 0
