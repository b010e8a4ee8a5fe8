"""Query 6: the language of all documents, by models that never saw the held-out quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import langid
from earshot.llm.registry import query
from earshot.llm.tables import table


@query("op6_langid")
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(langid.fold(F.col("doc_id")) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("language.lang_pred"), F.col("language.score"), F.col("language.margin"), F.col("language.rejected"))
