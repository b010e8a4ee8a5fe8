"""Preparing a corpus: five stages in order, each written before the next reads it.

Every stage but the last takes and returns the columns of documents and any others that came
with them. Quality rules drop what they reject; of each group of near-duplicates the document
with the least doc_id stays; personal data is replaced by its kind in brackets (n_chars follows); mixing repeats or leaves out documents so that sources meet their weights;
the last stage adds token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import bpe, mixing, pii, quality, simhash
from earshot.llm.tables import fresh, table, written

#: Suffix arrays, SimHash, trees and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None

SHINGLE = 3  # words; the distance is simhash.DISTANCE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    verdict = fresh(docs, "verdict")
    return quality.assess(docs, out=verdict).where(F.col(verdict)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word runs are linked at two bits or fewer."""
    return simhash.first_of_each(docs, shingle=SHINGLE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data."""
    spans, clean = fresh(docs, "spans"), fresh(docs, "clean")
    found = pii.find(docs, pii.fit(docs), out=spans).withColumn(clean, pii.redacted(F.col("text"), F.col(spans)))
    n_chars = F.when(F.size(spans) > 0, F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns({"text": F.col(clean), "n_chars": n_chars}).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return coded.withColumn("n_tokens", bpe.id_count(coded["token_ids"]))


STAGES = [
    ("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("PII", personal_data),
    ("mixing to target weights", mixture), ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage but the last leaves is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
