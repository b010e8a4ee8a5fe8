import random
import tracemalloc
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.Encoder(ranks, bpe.split_patterns(public_tokenizers.PATTERN))


def test_merge_is_least_rank_then_leftmost():
    rnd = random.Random(1)
    for _ in range(400):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        free = rnd.sample(range(3, 70000), 40)
        for rank in free:
            ranks.setdefault(bytes(rnd.choices(b"abc", k=rnd.choice([2, 2, 2, 3, 4, 5]))), rank)
        piece = bytes(rnd.choices(b"abc", k=rnd.randrange(1, 40)))
        parts = [piece[i:i + 1] for i in range(len(piece))]
        if piece in ranks:
            parts = [piece]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        merges = bpe.Merges(ranks)
        want = [ranks[p] for p in parts]
        assert bpe.merge(piece, merges) == want
        if len(parts) > 1:
            others = [bytes(rnd.choices(b"abc", k=5)) for _ in range(20)]
            got = bpe.merge_many([*others, piece, *others], merges)
            assert array("I", got[20]).tolist() == want and [array("I", g).tolist() for g in got[:20] if len(g)] == [bpe.merge(o, merges) if o not in ranks else array("I", g).tolist() for g, o in zip(got, others)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_equals_library(coder, library, text):
    assert array("I", coder.encode([text])[0]).tolist() == library.encode_ordinary(text)


def test_odd_texts(coder, library):
    rnd = random.Random(2)
    texts = [
        "", " ", "a" * 20000, " " * 5000, "ab" * 4000, "don't  \n\n you'll \x1c\x85\xa0 x", "½ ² 漢字 ٣٤ œuvre — ’s", "՘꟎ 𞤀 \U0001f600" * 3,
        "".join(rnd.choice("abcdefgh") for _ in range(5000)), "".join(chr(rnd.randrange(0x20, 0xD7FF)) for _ in range(3000)),
    ]
    for t in texts:
        assert array("I", coder.encode([t])[0]).tolist() == library.encode_ordinary(t)
    assert coder.encode([None, "", "a"])[:2] == [b"", b""]
    assert [array("I", ids).tolist() for ids in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_memory_of_new_pieces_is_bounded(ranks, library):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    texts = [" ".join(word() for _ in range(5000)) for _ in range(50)]
    coder = bpe.Encoder(ranks, bpe.split_patterns(public_tokenizers.PATTERN))
    tracemalloc.start()
    try:
        out = coder.encode(texts)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert [array("I", ids).tolist() for ids in out[:3]] == [library.encode_ordinary(t) for t in texts[:3]]
    assert held - sum(map(len, out)) < 20e6  # words that come once are not remembered
    assert peak < 200e6


def test_parts_are_the_texts_in_order(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 10)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 2)
    texts = ["one two one two", None, "three", "", "one two", "one three three", "xyzzy" * 50, "two"]
    parts = list(coder.parts(texts))
    assert len(parts) > 2
    assert [array("I", ids).tolist() for part in parts for ids in part] == [library.encode_ordinary(t or "") for t in texts]


def test_round_trip_and_defined_cases(spark, documents, ranks):
    docs = documents([(1, "Über alles, naïve café 漢字\n"), (2, None), (3, ""), (4, "x" * 50000), (5, "same"), (5, "same"), (None, "key")]).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, out="back").collect()
    assert len(out) == 7 and all(r.decoded == 1 for r in out)
    assert all(bytes(r.back).decode() == (r.text or "") for r in out)
    both = bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN).collect()
    key = lambda r: (str(r.doc_id), bytes(r.token_ids))
    assert sorted(map(key, both)) == sorted(map(key, out)) and all(bytes(r.decoded).decode() == (r.text or "") for r in both)
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
