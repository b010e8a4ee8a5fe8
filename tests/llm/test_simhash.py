import random
import re

import xxhash
from pyspark.sql import functions as F

from earshot.llm import simhash
from earshot.llm.components import components
from graphs import least_reachable


def brute_fp(text, k=3):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    rnd = random.Random(5)
    texts = [None, "", " \n", "One", "One two", "one TWO three", "ÀB àb Çç x\x1cy z\x85w", *[" ".join(rnd.choice("ab é Ü xyz".split()) for _ in range(n)) for n in (3, 4, 17, 400)]]
    assert [f & (1 << 64) - 1 for f in simhash.fingerprints(texts, 3).tolist()] == [brute_fp(t) for t in texts]
    assert [f & (1 << 64) - 1 for f in simhash.fingerprints(texts, 5).tolist()] == [brute_fp(t, 5) for t in texts]


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(6)
    ids = rnd.sample(range(-1000, 1000), 300)
    edges = list(zip(ids[:80], ids[1:81])) + [(ids[100], x) for x in ids[101:180]] + [(ids[200], ids[200])]
    edges += [(rnd.choice(ids[210:]), rnd.choice(ids[210:])) for _ in range(60)] + [(5000, 5001), (5001, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = least_reachable({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_connect_what_close_pairs_connect(spark):
    rnd = random.Random(7)
    fps = {0}
    for _ in range(12):
        base = rnd.getrandbits(64)
        cluster = [base]
        for _ in range(40):
            x = rnd.choice(cluster)
            for _ in range(rnd.choice([1, 2, 2, 3])):
                x ^= 1 << rnd.randrange(64)
            cluster.append(x)
        fps.update(cluster)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bits(a, b) <= 2]
    links = [tuple(r) for r in simhash.close_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert all(bits(*e) <= 2 for e in links)
    assert least_reachable(fps, links) == least_reachable(fps, pairs)


def test_groups(spark, documents):
    rnd = random.Random(8)
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(3000))
    rows = [(3, long), (1, long + " tail"), (9, long.upper().replace("W", "w")), (4, None), (2, ""), (7, " \t"), (5, "alone here"), (6, "another text"), (6, "another text"), (None, "key missing")]
    docs = documents(rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")
    out = simhash.groups(docs).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.component_id for r in out}
    assert got[1] == got[3] == got[9] == 1 and got[4] == got[2] == got[7] == 2 and got[5] == 5 and got[6] == 6 and got[None] is None
    kept = simhash.first_of_each(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 5, 6, None] and kept.columns == docs.columns
    assert simhash.groups(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from earshot.llm.q_simhash import op8_simhash
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {d: brute_fp(t) for d, t in texts.items()}
    ids = sorted(fps)
    want = least_reachable(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = op8_simhash(spark, sf).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {d: (fps[d], want[d]) for d in ids}
    assert op8_simhash(spark, sf).select(F.max(F.length("fingerprint"))).first()[0] == 16


def test_first_rows_of_groups_whatever_their_keys(spark, documents):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0]), (4, texts[3]), (4, texts[4]), (4, texts[4]), (5, texts[5]), (None, texts[5]), (3, texts[5])]
    kept = [(r.doc_id, r.text) for r in simhash.first_of_each(documents(rows)).collect()]
    assert sorted(kept, key=str) == sorted([*[(None, t) for t in texts[:3]], (4, texts[3]), (4, texts[4]), (3, texts[5])], key=str)
