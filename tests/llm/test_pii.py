import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.llm import boosting, pii
from earshot.llm.q_pii import op3_pii

BASE = [  # the contract's patterns
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text or "") if good(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


NO_MODEL = ([], {})


def found(spark, texts, model=NO_MODEL):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, _draw string").repartition(1)
    rows = pii.find(df, model).select("doc_id", pii.described(F.filter("pii", lambda s: s["base"])).alias("base"), pii.described(F.col("pii")).alias("all")).collect()
    return {r.doc_id: (r.base, r.all) for r in rows}


def test_base_spans_equal_contract(spark):
    rnd = random.Random(10)
    bits = ["a", "x.y", "@", "mail", ".", "-", "+1", " ", "(555)", "255", "256", "1", "0012", "4111 1111 1111 1111", "4379362835490466", "_", "%", "é", "漢", "\n", "🙂", "+49 30 1234567", "a@b.c", "1.2.3.4", "99"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(1500)]
    texts += [None, "", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "1.2.3.4.5.6.7.8.9", "x" * 60000, "1" * 60000, "1 " * 30000, "+1" + "(" * 50000, "a." * 30000 + "@", ("9" * 16 + "x") * 300, "a@b.c," * 500]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == brute(t), t[:80]


def test_luhn(spark):
    cases = ["4111111111111111", "4111111111111112", "0", "18", "79927398713", "79927398710"]
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", pii.luhn(F.col("c")).alias("ok"))
    assert {r.c: r.ok for r in df.collect()} == {c: luhn(c) for c in cases}


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 15), st.booleans()), st.integers(1, 20), min_size=2, max_size=12))
def test_trees_reduce_the_loss(counts):
    import math
    trees = boosting.fit(counts, 4)
    loss = lambda m: sum(n * math.log1p(math.exp(-m(p) if y else m(p))) for (p, y), n in counts.items())
    assert loss(lambda p: boosting.margin(trees, p)) <= loss(lambda p: 0.0) + 1e-9


def test_trees_as_columns(spark):
    trees = boosting.fit({(1, True): 9, (2, False): 8, (3, True): 1, (6, False): 5}, 3)
    rows = spark.range(8).select("id", boosting.margin_column(trees, F.col("id")).alias("m")).collect()
    assert all(r.m == pytest.approx(boosting.margin(trees, r.id)) for r in rows)


def test_threshold():
    assert boosting.threshold([(2.0, True, 50), (1.0, True, 50), (0.0, False, 30)], 0.95) == 0.5 and boosting.threshold([(2.0, True, 50)], 0.95) == 1.0
    assert boosting.threshold([(2.0, True, 1)], 0.95) == float("inf") and boosting.threshold([], 0.9) == float("inf")


def test_additions_learned_from_labels(spark, documents):
    rnd = random.Random(11)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hexes = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = []
    for i in range(400):
        rows.append((i, f'some words +1 ({digits(3)}) 555-{digits(4)} and {digits(16)} or token = "{hexes()}" ip {rnd.randrange(300)}.1.2.{rnd.randrange(400)} key: notasecretatall done'))
    rows += [(1000, "call (523) 555-1055 now"), (1001, 'x token = "' + "a1b2c" * 8 + '" y'), (1002, None), (1003, "nothing here 2024-01-02 and 123456789012"), (1003, "nothing here 2024-01-02 and 123456789012")]
    docs = documents(rows).withColumnRenamed("lang", "pii0").withColumnRenamed("source", "spans")
    model = pii.fit(docs)
    out = [(r.doc_id, r.s, r.base, r.clean) for r in pii.find(docs, model).select(
        "doc_id", pii.described(F.col("pii")).alias("s"), pii.described(F.filter("pii", lambda s: s["base"])).alias("base"), pii.redacted(F.col("text"), F.col("pii")).alias("clean")).collect()]
    by = {d: (s, b, c) for d, s, b, c in out}
    assert len(out) == len(rows) and by[1000] == ("phone:5:19", "", "call [PHONE] now") and by[1001][0] == "secret:2:52"
    assert by[1002] == ("", "", None) and by[1003][0] == ""
    for i in range(400):
        text = dict(rows[:400])[i]
        assert by[i][1] == brute(text) and "[SECRET]" in by[i][2] and "key: notasecretatall" in by[i][2] and "[PHONE]" in by[i][2]
    empty = docs.limit(0)
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_query_on_stored_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_pii(spark, sf).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k, _ in BASE]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_secrets_of_other_case_and_form(spark, documents):
    rnd = random.Random(12)
    hexes = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'a token = "{hexes() if i % 3 else hexes().upper()}" b key: notasecretatall c') for i in range(300)]
    forms = ['token = "' + "9A3F" * 9 + '"', "token = '" + "9a3f" * 9 + "'", 'token = "aGVsbG8gd29ybGQhIQ8xYz+/Zm9vYmFyMTIz="', "key: notasecretatall"]
    rows += [(1000 + i, f"x {form} y") for i, form in enumerate(forms)]
    docs = documents(rows)
    labels = {r.doc_id: r.label for r in pii.candidates(docs.where("doc_id >= 1000")).select("doc_id", F.explode("_c").alias("c")).where("c.kind = 4").select("doc_id", "c.label").collect()}
    assert labels == {1000: True, 1001: None, 1002: None, 1003: False}
    found = pii.find(docs, pii.fit(docs)).where("doc_id >= 1000").collect()
    assert {r.doc_id for r in found if r.pii} >= {1000, 1001} and not next(r.pii for r in found if r.doc_id == 1003)


def test_every_text_is_learned_from(spark, documents, monkeypatch):
    """Nothing is drawn: trees and thresholds together count each address once, however many texts there are."""
    docs = documents([(i, "from one@example.org") for i in range(9000)])
    counted = []
    monkeypatch.setattr(boosting, "fit", lambda counts, features: counted.append(sum(counts.values())) or [])
    monkeypatch.setattr(boosting, "threshold", lambda held, precision: counted.append(sum(n for _, _, n in held)) or 0.0)
    pii.fit(docs)
    assert sum(counted) == 9000 and 5500 < counted[0] < 6500
