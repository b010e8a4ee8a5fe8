"""Query 2: mix all documents to the weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import mixing
from earshot.llm.registry import query
from earshot.llm.tables import table


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
