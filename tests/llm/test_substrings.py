import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from earshot.llm import lcpmerge, substrings
from earshot.llm.q_substrings import SQL, op5_substrings
from test_quality import thue_morse


def brute(texts, window):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i:i + window]] > 1:
                gone[i:i + window] = True
        out.append((len(r), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(r) else 0, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def test_merge_of_front_coded_runs():
    rnd = np.random.default_rng(2)
    for runs, letters in ((1, 3), (2, 2), (7, 2), (40, 3), (9, 250)):
        arrays = []
        for _ in range(runs):
            a = np.unique(rnd.integers(0, letters, (rnd.integers(1, 60), 16), dtype=np.uint8), axis=0)
            a[:, :8] = 1
            a = np.unique(a, axis=0)
            arrays.append(a[lcpmerge.sort_order(a)])
        coded = [lcpmerge.front_coded(a) for a in arrays]
        got, place, last = [], [0] * runs, b""
        for run, shared in lcpmerge.merged([c[0] for c in coded], [c[1] for c in coded], 16):
            s = arrays[run][place[run]].tobytes()
            place[run] += 1
            n = next((i for i in range(16) if s[i:i + 1] != last[i:i + 1]), 16)
            assert shared == n
            last = s
            got.append(s)
        assert got == sorted(r.tobytes() for a in arrays for r in a)


@pytest.mark.parametrize("window, chunk_bytes", [(200, 3000), (60, 1500), (50, 2_000_000)])
def test_equals_brute_force(spark, documents, window, chunk_bytes):
    rnd = random.Random(window)
    letters = "ab é漢" if window < 60 else "abcdefgh é漢\n"
    passage = "".join(rnd.choice(letters) for _ in range(600))
    texts = []
    for _ in range(50):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 700)))
        for _ in range(rnd.randrange(3)):
            i, n, at = rnd.randrange(400), rnd.randrange(window // 2, 400), rnd.randrange(len(t) + 1)
            t = t[:at] + passage[i:i + n] + t[at:]
        texts.append(t)
    texts += [texts[0], texts[1][:-3], None, "", "a" * (window - 1), "b" * window, "c" * (3 * window), "c" * 2 * window, passage]
    docs = documents(list(enumerate(texts))).withColumnRenamed("lang", "chunk").withColumnRenamed("source", "key")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(docs, window=window, chunk_bytes=chunk_bytes).collect()}
    want = brute(texts, window)
    assert [got[i] for i in range(len(texts))] == want and any(w[1] for w in want)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({SQL})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in op5_substrings(spark, sf).collect()) == want


def test_texts_that_simple_hashes_confuse(spark, documents):
    rnd = random.Random(11)
    a, b = thue_morse(10)
    own = [str(rnd.randrange(10**9)) for _ in range(2)]
    rows = [(None, own[0] + w + own[1]) for w in (a, b)]  # one NULL key
    got = sorted((r.n_removed, r.n_bytes) for r in substrings.remove_repeats(documents(rows)).collect())
    want = sorted((t[1], t[0]) for t in brute([t for _, t in rows], 200))
    assert got == want


def test_chunks_do_not_look_for_words():
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab \n") for _ in range(rnd.randrange(600))) for _ in range(30)]
    c = substrings.Chunk(texts, 200)
    starts = np.arange(len(c.w.bytes) - 48 + 1)
    assert (c.w.marks_along(48) == c.w.marks(starts, starts + 48)).all()
    c.suffixes(200)
    assert "blank" not in vars(c.w) and c.w.counts.tolist() == [len(t.split()) for t in texts]
