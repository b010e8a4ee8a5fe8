"""Filter interaction audit: what every order of some filters removes, at each of its steps.

What an order of filters does to a document depends only on which of them it fails. So
documents are reduced to counts by part and mask of failed filters, and no order is ever
applied to a document.

Orders are numbered lexicographically: the Lehmer code of an order gives its rank, and the
orders that begin with the same letters are consecutive ranks. A mask is removed at a step in
the orders whose letters before that step are not in the mask and whose letter there is. These
are whole intervals of ranks (``removal_intervals``). Each count is added where an interval
begins and taken off where it ends, and running sums along the ranks give what each order
removes at that step. The cost is one row for each mask and interval end, whatever the number
of documents; windows hold the ranks of one part and step.

Filters see whole texts (NULL counts as empty) and the audited table as it is: a copy of an
earlier text fails E even where another filter removes that text. A NULL key is smaller than
nothing and nothing is smaller than it; rows that repeat a key and its text are not copies of
each other. A NULL part counts with the empty string. An empty table has no parts, no rows.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.llm.tables import salted_join, written

LETTERS = "ABCDE"
LEAST_WORDS = 100  # A: fewer
LEAST_DISTINCT = 80  # B: fewer distinct words per 100 words
MOST_CAPITALS = 10  # C: more capitals per 100 characters
SYMBOLS = "[#$%&*|]"  # D: any; fixed values
SPACE = "[\\x20\\x09-\\x0D]+"
DIGEST_BITS = 256
COUNTS = ["n", "good", "toxic"]
SALTS = 16


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) where orders of n filters remove a mask."""
    def walk(mask: int, left: list[int], low: int):
        for j, letter in enumerate(left):
            size = math.factorial(len(left) - 1)
            at = low + j * size  # the j-th letter left: j is the next digit of the Lehmer code
            if mask >> letter & 1:
                yield n - len(left) + 1, at, at + size
            else:
                yield from walk(mask, left[:j] + left[j + 1:], at)

    out = []
    for mask in range(1, 1 << n):
        ends: list[list[int]] = []
        for step, low, high in sorted(walk(mask, list(range(n)), 0)):
            if ends and ends[-1][0] == step and ends[-1][2] == low:
                ends[-1][2] = high
            else:
                ends.append([step, low, high])
        out += [(mask, *e) for e in ends]
    return out


def text_filters(text: Column) -> Column:
    """Mask of the filters A to D that a text fails (bit 0 is A)."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(whole, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    conditions = [
        n < LEAST_WORDS,
        100 * distinct.cast("long") < LEAST_DISTINCT * n.cast("long"),
        100 * F.regexp_count(whole, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(whole).cast("long"),
        whole.rlike(SYMBOLS),
    ]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, with how many are labelled.

    A document is good or toxic where any of its rows in ``labels`` says so. Texts are compared
    by SHA-256 and leave the first task as digests. Rows are counted by key and text before
    they meet labels, and by text and mask before copies meet, so neither a key nor a text that
    a third of the rows share reaches one task row by row.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, DIGEST_BITS)).alias("digest"), text_filters(F.col(f"`{text}`")).alias("mask"),
    ).groupBy("key", "part", "digest", "mask").agg(F.count("*").alias("n"))
    flags = labels.groupBy(F.col("doc_id").alias("key")).agg(
        F.coalesce(F.max(F.when(F.col("quality") == 1, 1)), F.lit(0)).alias("good"),
        F.coalesce(F.max(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("toxic"),
    ).where("key is not null and good + toxic > 0")
    # merged: flags with their salts are many times what the planner takes the labels for, too many to broadcast
    marked = salted_join(rows.withColumn("_by", F.xxhash64("digest")), flags.hint("merge"), ["key"], "_by", SALTS, "left").drop(
        "_by").fillna(0, ["good", "toxic"])
    # of each text: rows without a key, those of the least key, and all
    texts = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("keyless"),
        F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("least"),
    )
    first = F.min("least.key").over(Window.partitionBy("digest"))  # as many rows as parts and labels at most
    own = F.col("keyless") + F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
    copies_bit = 1 << LETTERS.index("E")
    split = texts.withColumn("first", first).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), own.alias("n")),
        F.struct((F.col("mask") + copies_bit).alias("mask"), (F.col("n") - own).alias("n")),
    )).alias("s")).select("part", "good", "toxic", "s.mask", "s.n")
    return split.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(failed: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from counts by part and mask (``failures``).

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley; zeros included.
    """
    spark, n = failed.sparkSession, len(letters)
    failed = written(failed)
    ranks = math.factorial(n)
    intervals = spark.createDataFrame(removal_intervals(n), "mask int, step int, low int, high int")
    order = ["".join(o) for o in permutations(letters)]
    orders = spark.createDataFrame(
        [(r, s + 1, o, o[s]) for r, o in enumerate(order) for s in range(n)], "rank int, step int, filter_order string, letter string")
    holds = spark.createDataFrame(
        [(m, l, int(m == 1 << i)) for m in range(1, 1 << n) for i, l in enumerate(letters) if m >> i & 1], "mask int, letter string, only int")

    ends = failed.join(F.broadcast(intervals), "mask").select("part", "step", F.explode(F.array(
        F.struct(F.col("low").alias("rank"), *COUNTS),
        F.struct(F.col("high").alias("rank"), *[(-F.col(c)).alias(c) for c in COUNTS]),
    )).alias("e")).select("part", "step", "e.*")
    parts = failed.groupBy("part").agg(F.sum("n").alias("total"))
    zeros = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    # one exchange by part serves the sums and windows below, all of which hold a part's ranks and steps only
    differences = ends.unionByName(zeros).repartition("part").groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    lost = differences.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in COUNTS]).where(F.col("rank") < ranks)
    failing = failed.join(F.broadcast(holds), "mask").groupBy("part", "letter").agg(
        F.sum("n").alias("failing"), F.sum(F.col("n") * F.col("only")).alias("unique_fails"))
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lost.join(F.broadcast(orders), ["rank", "step"]).join(parts, "part").join(failing, ["part", "letter"], "left").fillna(
            0, ["failing", "unique_fails"])
        .select(
            "part", "filter_order", "step", (F.col("total") - F.sum("n").over(steps)).alias("kept"), F.col("n").alias("removed"),
            (F.col("failing") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"))
    )
