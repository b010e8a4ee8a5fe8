import re
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from earshot.llm import bpe, mixing
from graphs import least_reachable
from test_pii import brute as base_spans
from test_quality import brute as measured
from test_simhash import brute_fp


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage over the stored documents."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.lit("clash"))
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, sf))
        out.append(docs.collect())
        assert docs.columns[:len(columns)] == columns
    return out


def test_quality(stages):
    kept = {r.doc_id for r in stages[1]}
    for r in stages[0]:
        if len(words(r.text)) > 400:
            continue  # brute force is slow there
        n, chars, _, _, repeat, cover, longest = measured(r.text)
        assert (r.doc_id in kept) == (n >= 10 and 100 * repeat <= 20 * n and cover <= 0.15 * chars and longest <= 0.3 * n)


def test_near_duplicates(stages):
    fp = {r.doc_id: brute_fp(r.text) for r in stages[1]}
    ids = sorted(fp)
    root = least_reachable(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert sorted(r.doc_id for r in stages[2]) == sorted(set(root.values())) and set(stages[2]) <= set(stages[1])


def test_personal_data(stages):
    before = {r.doc_id: r for r in stages[2]}
    assert sorted(before) == sorted(r.doc_id for r in stages[3])
    for r in stages[3]:
        assert base_spans(r.text) == "" and (r.text == before[r.doc_id].text or "[" in r.text) and r.n_chars == len(r.text)
        if not base_spans(before[r.doc_id].text) and "token" not in before[r.doc_id].text:
            assert r == before[r.doc_id]


def test_mixture(spark, stages):
    sizes = defaultdict(int)
    for r in stages[3]:
        sizes[r.source] += len(words(r.text))
    goals = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    have = defaultdict(int)
    for r in stages[4]:
        have[r.source] += len(words(r.text))
    assert all(abs(have[s] - goals[s]) <= 0.05 * goals[s] for s in goals) and set(stages[4]) <= set(stages[3])
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 3


def test_tokens(stages):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        ids = array("I", bytes(r.token_ids)).tolist()
        assert ids == library.encode_ordinary(r.text) and r.n_tokens == len(ids)


def test_odd_rows(spark, documents):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good), (1, good), (2, None), (3, ""), (4, good + " mail me@x.org ok"), (None, " ".join(f"v{i}" for i in range(50)), None, None, None)]
    docs = documents(rows).withColumns({c: F.lit(1) for c in ("_size", "own", "dealt", "times", "turn", "spans", "clean", "verdict", "row", "_row", "_n")}).withColumn("n_tokens_before", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, "unused"))
    ids = {r.doc_id for r in docs.collect()}
    assert ids <= {1, 4, None} and None in ids
    empty = documents([(1, good)]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, "unused"))
    assert empty.count() == 0


def test_repeated_rows_are_mixed_together(spark, documents):
    rows = [(1, "a b c", "en", "s", 1)] * 5 + [(2, "d e", "en", "s", 1), (3, "f " * 40, "en", "t", 1)]
    docs = documents(rows)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.taken(docs).collect()) == +copies


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup"
