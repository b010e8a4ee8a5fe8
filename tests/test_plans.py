"""Registered queries against their SQL, and the shape of the plans that matter at scale."""

import contextlib
import io
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from earshot.operators import curves, linear, reaction, sdt
from earshot.operators.blocks import drop_first_block
from earshot.params import Params
from earshot.plans import registry
from earshot.sources import stand_ins

SF = "/root/testdata/sf0.001"
COMPARED_AT = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
COMPARED = sorted(registry.SQL)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no stored tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{COMPARED_AT}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v != v else (float(v) if not isinstance(v, str) else v)
    rows = [tuple(clean(v) for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, COMPARED_AT).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.fixture(scope="module")
def no_wave(spark, tmp_path_factory):
    """A folder whose amplitudes all lack wave 1 (at larger scales every cell has one that does)."""
    folder = str(tmp_path_factory.mktemp("nowave"))
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").limit(40).withColumn("l_partkey", F.col("l_partkey") * 97)
    rows.write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["abr_anova_w1", "abr_shapiro_w1"])
def test_models_of_nothing_equal_sql(spark, no_wave, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{no_wave}/lineitem.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, no_wave).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == 1 and normal(got) == normal(want)


def test_models_of_nothing(spark):
    none = stand_ins.table(spark, SF, "lineitem").where(F.lit(False)).select(F.col("l_tax").cast("double").alias("y"), F.col("l_returnflag").alias("a"))
    terms, levels = [("a",)], {"a": ["A", "N"]}
    for made in (linear.anova(none, "y", terms, levels), linear.coefficients(none, "y", terms, levels),
                 linear.residuals(none, "y", terms, levels), linear.tukey(none, "y", terms, levels, "a")):
        assert made.count() == 0


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert entry.entry(spark).limit(1).count() == 1


def explained(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_core_plans_stay_in_the_jvm(spark):
    trials = stand_ins.trials(spark, SF)
    d = sdt.dprime_table(trials)
    for df in (d, curves.thresholds(d), reaction.counted(trials)):
        text = explained(df)
        assert "Python" not in text and "ArrowEval" not in text and "Pandas" not in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_trials_are_shuffled_once_for_blocks(spark):
    text = explained(drop_first_block(stand_ins.trials(spark, SF), ["ts", "event_id"], stand_ins.trial_slot(), Params()))
    head = text.split("\n\n\n")[0]
    assert head.count("Exchange") == 1 and head.count("Scan") == 1


def test_only_needed_columns_are_read(spark):
    text = explained(stand_ins.trials(spark, SF).groupBy("ID").agg(F.count("*")))
    assert "ReadSchema: struct<user_id:bigint>" in text


def test_filters_reach_the_scan(spark):
    rows = stand_ins.table(spark, SF, "lineitem").where(F.col("l_linenumber") == 1)
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)]" in explained(rows)
