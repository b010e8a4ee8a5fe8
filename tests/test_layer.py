"""The stored layer of numbered trials: same rows as cutting blocks afresh, and no shuffle on reading."""

import contextlib
import datetime as dt
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from earshot.operators import blocks, ranks
from earshot.params import Params
from earshot.session import shared_path
from earshot.sources import layer

SCHEMA = "Date date, ID string, Sex string, Stim string, i int, note string"


def trials(spark):
    rows = []
    for d, n in ((1, 23), (2, 400), (3, 9), (None, 31)):
        for stim in ("BBN", "tone", "click", None):
            for who in ("Green 1", "Orange 2", None):
                rows += [(d and dt.date(2022, 4, d), who, "Male", stim, i, "x") for i in range(n)]
    rows += [rows[0]] * 3  # repeated rows
    return spark.createDataFrame(rows, SCHEMA)


def bag(df):
    return Counter(tuple(r) for r in df.select("Date", "ID", "Sex", "Stim", "i", "note", "Blocks_trimmed", "block_row").collect())


@pytest.fixture(scope="module", params=[ranks.ONE_TASK, 50])
def stored(spark, request):
    path = shared_path(spark)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ranks, "ONE_TASK", request.param)  # the small bound cuts recordings into slots
        layer.store(trials(spark), path, ["i"], F.floor(F.col("i") / 10), files=3)
    return path


def test_same_rows_as_cutting_afresh(spark, stored):
    want = bag(blocks.drop_first_block(trials(spark), ["i"], F.col("i")))
    assert want and bag(blocks.kept_rows(layer.read(spark, stored))) == want


def test_days(spark, stored):
    whole = bag(blocks.kept_rows(layer.read(spark, stored)))
    some = bag(blocks.kept_rows(layer.read(spark, stored, dt.date(2022, 4, 2), dt.date(2022, 4, 3))))
    assert some == Counter({r: n for r, n in whole.items() if r[0] and r[0].day in (2, 3)})
    until = bag(blocks.kept_rows(layer.read(spark, stored, last=dt.date(2022, 4, 1))))
    assert until == Counter({r: n for r, n in whole.items() if r[0] and r[0].day == 1})


def test_appended_days(spark):
    path = shared_path(spark)
    for day, mode in ((1, "overwrite"), (2, "append")):
        layer.store(trials(spark).where(F.dayofmonth("Date") == day), path, ["i"], F.col("i"), mode=mode)
    want = bag(blocks.drop_first_block(trials(spark).where(F.dayofmonth("Date") < 3), ["i"], F.col("i")))
    assert bag(blocks.kept_rows(layer.read(spark, path))) == want


def test_nothing(spark):
    path = shared_path(spark)
    none = trials(spark).where(F.lit(False))
    layer.store(none, path, ["i"], F.col("i"))
    assert blocks.kept_rows(layer.read(spark, path, schema=none.schema)).count() == 0


def test_stored_schema(spark, stored):
    given = layer.read(spark, stored, schema=trials(spark).schema)
    assert bag(blocks.kept_rows(given)) == bag(blocks.kept_rows(layer.read(spark, stored)))
    assert given.columns == [*trials(spark).columns, "row", "total"]


def test_reading_neither_shuffles_nor_sorts(spark, stored):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        blocks.kept_rows(layer.read(spark, stored, first=dt.date(2022, 4, 2)), Params()).explain("formatted")
    plan = out.getvalue()
    assert not any(word in plan for word in ("Exchange", "Window", "Sort", "Join"))
    assert "GreaterThan(row,10)" in plan and "PartitionFilters: [isnotnull(layer_day" in plan


def test_hot_recording_lies_in_several_files(spark):
    path = shared_path(spark)
    hot = spark.range(4000).select(F.lit(dt.date(2022, 4, 1)).alias("Date"), F.lit("Green 1").alias("ID"), F.lit("Male").alias("Sex"),
                                   F.lit("tone").alias("Stim"), F.col("id").cast("int").alias("i"), F.lit("x").alias("note"))
    layer.store(hot, path, ["i"], F.floor(F.col("i") / 10), files=4)
    per_file = layer.read(spark, path).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) > 2 and max(r["count"] for r in per_file) < 2500
