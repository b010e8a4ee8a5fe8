"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times it is taken on average. Among all rates
between 0 and ``MOST_COPIES`` that give each source its target of words, the ones of least
relative entropy to taking every document once are r = min(MOST_COPIES, exp(t * size)) with
one multiplier t per source. The multipliers solve the convex dual, one equation per source:
distributed Newton steps, kept inside a bracket that always holds the solution.

All steps work on counts by source and size, which partial sums make from the documents in
one pass. The rates become whole copies by systematic
rounding along the sizes of a source (the error stays below its longest document), then
what is missing is filled by single copies of the longest documents that fit. The
copies of one source and size are shared over slots of about ``SLOT_ROWS`` documents, so
that a hot size is spread; hashes of the rows order a slot's documents: reruns agree.

Only DataFrame functions are used. NULL texts and texts without words have size 0 and are
taken once, which adds no words; a NULL source is a source of its own, the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.tables import fresh, salted_join, written

WEIGHTS = [1, 2, 3]  # repeated over the sources in order
MOST_COPIES = 3
SLOT_ROWS = 500
PRECISION = 1e-9  # of a source's target
STEPS = 5  # Newton steps in one job


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def exact_sum(values: Column) -> Column:
    """A sum that does not depend on the order of its rows: decimals are added without rounding."""
    return F.sum(values.cast("decimal(38,12)")).cast("double")


def targets(sources: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """Targets for a table of (source, source_size), one row per source.

    Weights share the total of all sizes; a target stops at ``most`` times its source's
    size and the excess is shared again by weight until none is above. The final common
    factor is found in one step: with sources in the order in which they stop, it is the
    first factor (what is left) / (weights left) that the next source can take.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    named = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    stop = Window.orderBy(most * F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    factor = (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    free = named.withColumn("factor", factor).withColumn("free", F.col("factor") * F.col("weight") <= most * F.col("source_size"))
    common = F.min(F.when(F.col("free"), F.struct(most * F.col("source_size") / F.col("weight"), "factor"))).over(whole)["factor"]
    return free.select(
        "source", "source_size", F.least(F.coalesce(common * F.col("weight"), most * F.col("source_size").cast("double")), most * F.col("source_size").cast("double")).alias("target"),
    )


def _balanced(counts: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """(source, t): the multiplier of each source, for sizes relative to the mean size."""
    start = counts.join(goals, "source_key").groupBy("source_key").agg(
        F.min("x").alias("least"), F.first("goal").alias("goal"), exact_sum(F.col("n") * F.col("x")).alias("total"), F.first("full").alias("full"),
    )
    # at the lower end no rate sum exceeds the goal, at the upper end every rate is at its most
    low = F.least(F.lit(0.0), F.log(F.col("goal") / F.col("total")) / F.col("least"))
    high = F.log(F.lit(float(most))) / F.col("least")
    now = start.select("source_key", "goal", "full", low.alias("low"), high.alias("high"), F.lit(0.0).alias("t"), F.lit(False).alias("done"))
    turn = 0
    while True:
        for _ in range(STEPS):
            turn += 1
            now = _stepped(counts, now, most, halve=turn % 4 == 0)
        now = written(now)
        if not now.where(~F.col("done") & ~F.col("full")).limit(1).count():
            return now.select("source_key", "t", "full")


def _stepped(counts: DataFrame, now: DataFrame, most: float, halve: bool) -> DataFrame:
    """One Newton step per source, or the middle of its bracket where that leaves it or ``halve`` asks for it."""
    size, t = F.col("x"), F.col("t")
    rated = F.least(F.exp(t * size), F.lit(float(most)))
    sums = counts.join(now, "source_key").groupBy("source_key").agg(
        *[F.first(c).alias(c) for c in ("goal", "full", "low", "high", "t")],
        (exact_sum(F.col("n") * size * rated) - F.first("goal")).alias("over"),
        exact_sum(F.when(F.exp(t * size) < most, F.col("n") * size * size * rated).otherwise(0.0)).alias("slope"),
    )
    low = F.when(F.col("over") < 0, t).otherwise(F.col("low"))
    high = F.when(F.col("over") > 0, t).otherwise(F.col("high"))
    newton = t - F.col("over") / F.when(F.col("slope") > 0, F.col("slope"))
    inside = (newton > low) & (newton < high) & F.lit(not halve)
    done = (F.abs("over") <= PRECISION * F.col("goal")) | (high - low <= 1e-14 * (F.abs(low) + F.abs(high)))
    return sums.select(
        "source_key", "goal", "full", low.alias("low"), high.alias("high"),
        F.when(done, t).when(inside, newton).otherwise((low + high) / 2).alias("t"), done.alias("done"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST_COPIES) -> DataFrame:
    """One row per input row: ``key``, size, source, source_size, target, rate, copies, taken."""
    name = F.col(f"`{source}`").cast("string")
    sized = docs.select(F.col(f"`{key}`").alias("key"), size_of(F.col(f"`{text}`").cast("string")).alias("size"), name.alias("source"))
    # a struct compares NULL to NULL as equal, so the source without a name is an ordinary group
    sized = sized.select("key", "size", F.struct("source").alias("source_key"), F.xxhash64("key", "source", "size").alias("turn"))
    sized = written(sized)
    classes = written(sized.groupBy("source_key", "size").agg(F.count("*").alias("n")))
    sums = classes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = written(targets(sums.select(F.col("source_key.source").alias("source"), "source_size"), most).select(
        F.struct("source").alias("source_key"), "source_size", "target"))
    mean = classes.where("size > 0").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    counts = classes.where("size > 0").crossJoin(F.broadcast(mean)).select(  # one row
        "source_key", "size", "n", (F.col("size") / F.col("mean")).alias("x"))
    scaled = goals.where("source_size > 0").crossJoin(F.broadcast(mean)).select(
        "source_key", (F.col("target") / F.col("mean")).alias("goal"),
        (F.col("target") >= most * F.col("source_size") * (1 - PRECISION)).alias("full"))
    rate = F.when(F.col("full"), float(most)).otherwise(F.least(F.exp(F.col("t") * F.col("x")), F.lit(float(most))))
    rates = counts.join(_balanced(counts, scaled, most), "source_key").select("source_key", "size", "n", rate.alias("rate"))
    copies = _filled(written(_rounded(rates)), goals, most).unionByName(
        classes.where("size = 0").withColumns({"rate": F.lit(1.0), "copies": F.col("n")}))
    return _dealt(sized, written(copies.join(goals, "source_key"))).select(
        F.col("key").alias(key), "size", F.col("source_key.source").alias("source"), "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def _rounded(rates: DataFrame) -> DataFrame:
    """Whole copies per (source, size): running sums of rates along the sizes, rounded."""
    along = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(F.col("n") * F.col("rate")).over(along)
    to = F.floor(upto + 0.5)
    step = Window.partitionBy("source_key").orderBy("size")
    return rates.withColumn("to", to).select(
        "source_key", "size", "n", "rate", (F.col("to") - F.coalesce(F.lag("to").over(step), F.lit(0))).alias("copies"))


def _filled(classes: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """Copies added or taken away until no document fits into what a source is off by.

    Per source the sizes that fit are gone through once, the largest first, each as often as
    it fits and has documents for; every step leaves less than its size.
    """
    off = classes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("have")).join(goals, "source_key").select(
        "source_key", F.round(F.col("target") - F.col("have")).cast("long").alias("off"))
    room = F.when(F.col("off") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    fits = classes.join(off, "source_key").where((F.col("size") <= F.abs("off")) & (room > 0)).groupBy("source_key", "off").agg(
        F.sort_array(F.collect_list(F.struct("size", room.alias("room"))), asc=False).alias("sizes"))  # distinct sizes
    state = "struct<left: bigint, out: array<struct<size: bigint, m: bigint>>>"

    def take(s: Column, x: Column) -> Column:
        m = F.least(x["room"], F.floor(s["left"] / x["size"]))
        more = F.array(F.struct(x["size"].alias("size"), m.alias("m")))
        return F.when(m > 0, F.struct((s["left"] - m * x["size"]).alias("left"), F.concat(s["out"], more).alias("out")).cast(state)).otherwise(s)

    begin = F.struct(F.abs("off").alias("left"), F.array().alias("out")).cast(state)
    changes = fits.select("source_key", F.signum("off").cast("long").alias("sign"), F.explode(F.aggregate("sizes", begin, take, lambda s: s["out"])).alias("c"))
    changes = changes.select("source_key", F.col("c.size").alias("size"), (F.col("sign") * F.col("c.m")).alias("change"))
    filled = classes.join(changes, ["source_key", "size"], "left").select(
        "source_key", "size", "n", "rate", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))
    return _nearest(filled, goals, most)


def _nearest(classes: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """One more copy, of the smallest document that can still be added (or taken away), where going past the target comes nearer to it."""
    have = classes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("have"))
    off = have.join(goals, "source_key").select("source_key", (F.col("target") - F.col("have")).alias("off"))
    room = F.when(F.col("off") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    best = classes.join(off, "source_key").where(room > 0).groupBy("source_key", "off").agg(F.min("size").alias("size"))
    change = best.where(F.abs(F.abs("off") - F.col("size")) < F.abs("off")).select(
        "source_key", "size", F.signum("off").cast("long").alias("change"))
    return classes.join(change, ["source_key", "size"], "left").select(
        "source_key", "size", "n", "rate", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def _dealt(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """Copies per document: those of a class shared over its slots, then over each slot's documents."""
    spread = classes.withColumn("slots", F.ceil(F.col("n") / SLOT_ROWS))
    slot = ["source_key", "size", "slot"]
    rows = written(salted_join(sized, spread, ["source_key", "size"], "turn").withColumn("slot", F.pmod("turn", "slots")))
    parts = rows.groupBy(*slot).agg(F.count("*").alias("part_n"), F.first("copies").alias("all"), F.first("n").alias("n"))
    upto = F.sum("part_n").over(Window.partitionBy("source_key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def through(n: Column) -> Column:  # copies for the first n documents, so that the shares add up to all
        return F.when(n == F.col("n"), F.col("all")).otherwise(F.floor(F.col("all").cast("double") * n / F.col("n")))

    parts = parts.withColumn("upto", upto)
    parts = parts.select(*slot, "part_n", (through(F.col("upto")) - through(F.col("upto") - F.col("part_n"))).alias("share"))
    place = F.row_number().over(Window.partitionBy(*slot).orderBy("turn", "key"))
    base = F.floor(F.col("share") / F.col("part_n"))
    extra = F.col("place") <= F.col("share") - base * F.col("part_n")
    return rows.drop("copies").withColumn("place", place).join(parts, slot).withColumn("copies", base + extra.cast("long"))


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST_COPIES) -> DataFrame:
    """The rows of the mix: each row of the table as often as it is taken, all columns as they are.

    Copies are joined by key, source and size. Where several rows share these, their copies
    are dealt to them one by one, so together they are taken as often as ``mix`` says.
    """
    own, dealt, turn, n = (fresh(docs, c) for c in ("own", "dealt", "turn", "times"))
    mixed = mix(docs, key, text, source, most)
    few = mixed.groupBy(F.struct(F.col(key).alias("key"), F.col("source"), F.col("size")).alias(own)).agg(F.collect_list("copies").alias(dealt))
    few = few.select(own, F.sort_array(dealt, asc=False).alias(dealt)).where(F.col(dealt)[0] > 0)
    size = size_of(F.col(f"`{text}`").cast("string"))
    named = F.struct(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"))
    joined = docs.withColumn(own, named).join(few, own)  # structs with equal NULLs are equal
    place = F.row_number().over(Window.partitionBy(own).orderBy(F.lit(0)))
    alone = F.size(dealt) == 1
    rows = joined.where(alone).withColumn(n, F.col(dealt)[0]).unionByName(
        joined.where(~alone).withColumn(n, F.get(dealt, place - 1)))
    rows = rows.where(F.col(n) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
