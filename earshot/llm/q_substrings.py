"""Query 5: remove byte strings of all documents that occur again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import substrings
from earshot.llm.registry import query
from earshot.llm.tables import table

SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM docs WHERE len(x) >= 400),
hashed AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM starts),
again AS (SELECT r, i FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again),
spans AS (SELECT r, i, sum((before IS NULL OR i > before + 200)::INT) OVER (PARTITION BY r ORDER BY i) AS span FROM runs),
cuts AS (SELECT r, span, min(i) AS a, max(i) + 200 AS b FROM spans GROUP BY r, span),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_, row_number() OVER (PARTITION BY r ORDER BY a DESC) AS last_ FROM cuts),
parts AS (SELECT gaps.r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(first(x), 2 * max(b) + 1) AS kept FROM gaps JOIN docs ON gaps.r = docs.r GROUP BY gaps.r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM docs LEFT JOIN parts ON docs.r = parts.r
"""


@query("op5_substrings", SQL)
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
