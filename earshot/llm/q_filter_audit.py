"""Query 11: every order of five filters over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import filter_audit
from earshot.llm.registry import query
from earshot.llm.tables import table

SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
words AS (SELECT doc_id, t, part, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
flags AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS mask
  FROM words LEFT JOIN flags USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step::INT, 1) AS letter, substr(filter_order, 1, step::INT - 1) AS before
  FROM orders, range(1, 6) AS r(step)),
cells AS (SELECT part, filter_order, step, letter, sum(n) AS total,
  coalesce(sum(n) FILTER (contains(mask, letter)), 0) AS failing,
  coalesce(sum(n) FILTER (mask = letter), 0) AS unique_fails,
  coalesce(sum(n) FILTER (contains(mask, letter) AND translate(mask, before, '') = mask), 0) AS removed,
  coalesce(sum(good) FILTER (contains(mask, letter) AND translate(mask, before, '') = mask), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (contains(mask, letter) AND translate(mask, before, '') = mask), 0) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, (total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept,
  removed::BIGINT AS removed, (failing - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM cells"""


@query("op11_filter_audit", SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.audit(filter_audit.failures(docs, labels))
