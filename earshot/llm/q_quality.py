"""Query 9: quality rules on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import quality
from earshot.llm.registry import query
from earshot.llm.tables import table


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs).select("doc_id", F.col("quality")["n_words"].alias("n_words"), *[
        F.col("quality")[c].alias(c) for c in (
            "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_chars", "longest_repeat")
    ])
