"""Trials, session log, file listing and ABR tables derived from stored star-schema tables.

The stored tables hold no hearing data, so each logical table is computed from
one of them by fixed rules (the rules are listed in FIXTURES.md). The same rules
are written as SQL in :mod:`earshot.plans.sql`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: stand-in rules ---
SUBJECTS = ["Green 1", "Green 2", "Green 3", "Orange 1", "Orange 2"]
TEST_BLOCK_SIZES = {"tone": 10, "BBN": 5}
TEST_MIN_BLOCKS = 2
# ------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _condition(day: Column) -> Column:
    return (
        F.when(day <= 12, "Baseline").when(day <= 15, "Recovery").when(day <= 26, "Post HHL")
        .when(day <= 28, "Recovery 2").otherwise("Post 2nd Exposure")
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trial, from ``events``."""
    day = F.dayofmonth("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    base = table(spark, sf_dir, "events").select(
        "ts", "event_id", "value",
        F.to_date("ts").alias("Date"), day.alias("_day"), k.alias("_k"),
        F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), (F.col("user_id") % 5 + 1).cast("int")).alias("ID"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("Type"),
    )
    go, bbn, level = F.col("Type") == 1, F.col("_k") % 10 < 5, (F.floor(F.col("_k") / 10) * 10).cast("double")
    durations = F.array(F.lit(50.0), F.lit(100.0), F.lit(300.0))
    shift = F.when(F.col("_day") > 15, 10.0).otherwise(0.0)
    hit = F.col("value") <= 3 + 1.5 * F.greatest(level - shift, F.lit(0.0))
    return base.select(
        "Date", "ID",
        F.when(F.col("ID").contains("Green"), "Male").otherwise("Female").alias("Sex"),
        _condition(F.col("_day")).alias("Condition"),
        F.when(F.col("_day") % 2 == 0, "NA").otherwise("PNK").alias("BG_Type"),
        F.when(F.col("_day") % 2 == 0, "NA").otherwise("50").alias("BG_Intensity"),
        F.when(bbn, "BBN").otherwise("tone").alias("Stim"),
        "Type",
        F.when(~go | bbn, 0.0).otherwise(F.element_at(F.array(*[F.lit(x) for x in (4.0, 8.0, 16.0, 32.0)]), F.col("_k") % 4 + 1)).alias("Freq"),
        F.when(go, level).otherwise(-100.0).alias("Inten"),
        F.when((F.col("ID") == "Green 3") & bbn, F.element_at(durations, (F.col("event_id") % 3 + 1).cast("int")))
        .when((F.col("ID") == "Orange 2") & bbn, F.element_at(durations, F.col("_day") % 3 + 1))
        .otherwise(50.0).alias("Dur"),
        F.when(~go, F.when(F.col("value") < 8, "F.A.").otherwise("C.R."))
        .otherwise(F.when(hit, "Hit").otherwise("Miss")).alias("Response"),
        (150 + 3 * (90 - level) + F.col("value")).alias("RTime"),
        "ts", "event_id",
    )


def trial_slot() -> Column:
    """Minute of the day: it follows the order of a day's trials."""
    return F.hour("ts") * 60 + F.minute("ts")


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject and day, summed up from the trials."""
    day = F.dayofmonth("Date")
    rate = lambda yes, no: F.try_divide(
        100.0 * F.count_if(F.col("Response") == yes), F.count_if(F.col("Response").isin(yes, no))
    )
    per_day = trials(spark, sf_dir).groupBy("ID", "Date", "Condition", "BG_Type").agg(
        F.count("*").alias("n"), rate("Hit", "Miss").alias("Hit"), rate("F.A.", "C.R.").alias("FA"),
    )
    kind = (
        F.when(day % 4 >= 2, "4-32kHz_MIXdB_50ms")
        .when(F.col("ID") == "Green 3", "BBN_30-90dB_50-300ms")
        .when((F.col("ID") == "Orange 2") & (day % 3 == 1), "BBN_30-90dB_100ms")
        .when((F.col("ID") == "Orange 2") & (day % 3 == 2), "BBN_30-90dB_300ms").otherwise("BBN_30-90dB_50ms")
    )
    ending = F.when(F.col("BG_Type") == "NA", "_4s").otherwise("_BG_PNK_50dB_4s")
    phase_end = (
        F.when(F.col("Condition") == "Recovery", ", recovery").when(F.col("Condition") == "Post HHL", ", post-HL")
        .when(F.col("Condition") == "Recovery 2", ", recovery2")
        .when(F.col("Condition") == "Post 2nd Exposure", ", post-HL2").otherwise("")
    )
    return per_day.select(
        "Date",
        F.when(day == 9, "Did not run").otherwise(F.concat(kind, ending)).alias("File"),
        (200 + day).cast("double").alias("Weight"), (day / 10.0).alias("WeightChange"),
        (F.col("n") + F.when(day % 7 == 0, 1).otherwise(0)).cast("double").alias("Trials"),
        "Hit", "FA",
        F.when(day % 4 < 2, "25").when(day % 3 == 0, "12, 15.5, 20, 22").when(day % 3 == 1, "25")
        .otherwise("n/a").alias("Thresholds"),
        F.when(day == 6, None).when(day == 11, "Error").when(day == 18, "Maintaince").when(day == 24, "Training")
        .otherwise(F.concat(F.lit("BBN"), phase_end)).alias("Phase"),
        "ID",
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-file paths with the session that claims each (``Date``, ``ID``, ``File``)."""
    log = session_log(spark, sf_dir).where(F.col("File") != "Did not run")
    day = F.dayofmonth("Date")
    folder = F.date_format(F.when(day % 13 == 0, F.date_add("Date", 1)).otherwise(F.col("Date")), "yyyyMMdd")
    subject = F.when(day % 17 == 0, "Orange9").otherwise(F.regexp_replace("ID", " ", ""))
    stamp = F.date_format("Date", "yyyyMMdd")
    runs = F.when(day % 8 == 0, F.expr("array()").cast("array<int>")) \
        .when(day % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return log.withColumn("run", F.explode(runs)).select(
        "Date", "ID", "File",
        F.concat(
            F.lit("./data/"), folder, F.lit("/export/"), subject, F.lit("_"), subject, F.lit("_"), F.col("File"),
            F.lit("_"), stamp, F.lit("-13000"), F.col("run").cast("string"), F.lit("_BOX#001_raw_data.csv"),
        ).alias("path"),
    )


def abr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evoked-response amplitudes, from ``lineitem``."""
    names = ["Baseline", "Hearing Loss", "1 day", "1 week", "2 week", "4 week", "5 week"]
    inten = (10 * (1 + F.col("l_quantity").cast("int") % 10)).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("A"), (F.col("l_suppkey") % 12).cast("string")).alias("ID"),
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber")).alias("Condition"),
        F.element_at(F.array(*[F.lit(f) for f in ("0", "4", "8", "16", "32")]), (F.col("l_partkey") % 5 + 1).cast("int")).alias("Freq"),
        inten.alias("Inten"),
        (F.col("l_extendedprice") / 10000).alias("RMS"),
        F.when(F.col("l_partkey") % 97 != 0, F.col("l_extendedprice") / 50000 + inten / 100).alias("W1"),
        F.col("l_suppkey").alias("_source"),
    )


def abr_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The amplitudes as two overlapping sheets: a short one and a detailed one."""
    rows = abr(spark, sf_dir)
    short = rows.where(F.col("_source") % 2 == 0).drop("_source")
    detailed = rows.where(F.col("_source") % 2 == 1).drop("_source")
    return short, detailed


def abr_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evoked-response thresholds per subject and ear, from ``orders``."""
    price = F.col("o_totalprice")
    freq = F.element_at(F.array(*[F.lit(f) for f in ("BBN", "4", "8", "16", "32")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    condition = (
        F.when(F.col("o_orderpriority").startswith("1"), "Baseline").when(F.col("o_orderpriority").startswith("2"), "1 day")
        .when(F.col("o_orderpriority").startswith("3"), "1 week").when(F.col("o_orderpriority").startswith("4"), "2 week")
        .otherwise("4-5 week")
    )
    step = lambda unit: (F.floor(price / unit) * 5).cast("double")
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 50 != 0, F.concat(F.lit("A"), (F.col("o_custkey") % 12).cast("string"))).alias("ID"),
        condition.alias("Condition"),
        F.when(F.col("o_orderstatus") == "F", "Left").when(F.col("o_orderstatus") == "O", "Right").otherwise("Both").alias("Ear"),
        freq.alias("Freq"),
        F.when(F.col("o_orderkey") % 31 != 0, step(50000)).alias("Run_TH"),
        F.when(F.col("o_orderkey") % 37 != 0, step(40000)).alias("RMS_TH"),
        F.when(F.col("o_orderkey") % 41 != 0, step(30000)).alias("Wave_TH"),
    )
