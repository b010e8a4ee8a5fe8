import random
from itertools import permutations

from earshot.llm import filter_audit


def brute(docs, labels):
    """Every order applied to every document."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    rows = []
    for key, text, part in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        fails |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        fails |= {"E"} if key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in docs) else set()
        rows.append((part or "", fails, key in good, key in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = {}
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] = removed_by.get(f, 0) + len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone),
                              sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*l, removed_by[l[1][l[2] - 1]]) for l in lines]
    return sorted(out)


def test_equals_every_order(spark, documents):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["BIG", "LOUD"]
    texts = [None, "", " \t\n", "#", "LOUD " * 200, "a " * 150]
    texts += [" ".join(rnd.choices(vocabulary, k=rnd.choice([30, 100, 120, 400]))) + rnd.choice(["", " #", "\n"]) for _ in range(60)]
    rows = [(rnd.choice([None, *range(80)]), rnd.choice(texts), rnd.choice(["en", "de", None, ""]), "s", 0) for _ in range(250)]
    rows += rows[:20] + [(7, "LOUD " * 200, "en", "s", 0)] * 90  # repeated rows, one of them often
    labels = [(rnd.choice([None, *range(80)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(120)]
    docs = documents(rows).withColumnRenamed("source", "mask").withColumnRenamed("n_chars", "n")
    failed = filter_audit.failures(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(tuple(r) for r in filter_audit.audit(failed).select(*columns).collect())
    assert got == brute([(k, t, p) for k, t, p, *_ in rows], labels)


def test_nothing_and_one(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(documents([]), labels)).count() == 0
    one = filter_audit.audit(filter_audit.failures(documents([(None, None)]), labels))
    assert one.count() == 600 and one.where("kept + removed > 1").count() == 0


def test_labels_are_not_broadcast(spark, documents, tmp_path):
    # a small file of labels by its bytes, sixteen times its rows by the join
    documents([(i, f"t{i % 150}") for i in range(200)]).write.parquet(f"{tmp_path}/documents")
    spark.range(300).selectExpr("id doc_id", "cast(id % 2 as int) quality", "cast(id % 5 = 0 as int) toxic").write.parquet(f"{tmp_path}/labels")
    failed = filter_audit.failures(spark.read.parquet(f"{tmp_path}/documents"), spark.read.parquet(f"{tmp_path}/labels"))
    got = sorted(tuple(r) for r in failed.select("part", "mask", "n", "good", "toxic").collect())
    assert got == [("en", 1, 150, 75, 30), ("en", 17, 50, 25, 10)]
    assert "Broadcast" not in failed._jdf.queryExecution().executedPlan().toString()


def test_intervals_cover_each_order_once():
    for n in (1, 2, 5):
        order = list(permutations(range(n)))
        step_of = {}
        for mask, step, low, high in filter_audit.removal_intervals(n):
            for rank in range(low, high):
                assert (mask, rank) not in step_of
                step_of[mask, rank] = step
        assert step_of == {
            (m, r): next(s for s, f in enumerate(o, 1) if m >> f & 1) for m in range(1, 1 << n) for r, o in enumerate(order)}
