"""Query 4: near-duplicates among all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import itq
from earshot.llm.registry import query
from earshot.llm.tables import table


@query("op4_itq")
def op4_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
