"""Query 13: codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import vector_codes
from earshot.llm.registry import query
from earshot.llm.tables import table


def _statement() -> str:
    """Rounds of assignment and means, one after the other; distances and indexes compared as one number."""
    gap = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
    steps = ["""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS v FROM kept, range(4) AS r(part)),
    firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256),
    book0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN firsts USING (vec_id))"""]
    for i in range(5):
        steps.append(f"""near{i} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.label) AS label, min({gap} * 256 + c.entry) AS best, any_value(p.v) AS v
          FROM parts p JOIN book{i} c ON p.part = c.part GROUP BY p.vec_id, p.part)""")
        if i < 4:
            steps.append(f"""means{i} AS (SELECT part, entry, list(m ORDER BY pos) AS v FROM (
              SELECT part, entry, pos, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS m FROM (
              SELECT part, best % 256 AS entry, unnest(v)::HUGEINT AS x, unnest(range(1, len(v) + 1)) AS pos FROM near{i}) GROUP BY ALL) GROUP BY ALL),
            book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v::BIGINT[], b.v) AS v FROM book{i} b LEFT JOIN means{i} m ON b.part = m.part AND b.entry = m.entry)""")
    body = ",\n".join(steps)
    return body + """,
    coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(best % 256), 2, '0')), '' ORDER BY part) AS code,
      sum(best // 256)::BIGINT AS error FROM near4 GROUP BY vec_id),
    books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books"""


@query("op13_vector_codes", _statement())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = vector_codes.compress(vectors)
    return vector_codes.with_group_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"))
