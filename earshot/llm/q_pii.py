"""Query 3: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import pii
from earshot.llm.registry import query
from earshot.llm.tables import table


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).withColumn("base", F.filter("pii", lambda s: s["base"]))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda kind: kind == F.lit(pii.KINDS.index(name)))).cast("long").alias(f"n_{name}") for name in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.described(F.col("base")), 256).alias("base_sha256"), pii.described(F.col("pii")).alias("spans"))
