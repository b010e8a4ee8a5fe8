"""Query 10: remove word windows of all documents that occur again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import anchors
from earshot.llm.registry import query
from earshot.llm.tables import table

SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
windows AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM docs WHERE len(w) >= 35),
hashed AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM windows),
again AS (SELECT r, i FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS i FROM again, range(35) AS t(k)),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n_removed FROM words LEFT JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.r = kept.r
"""


@query("op10_anchors", SQL)
def op10_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return anchors.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
