"""Personal data and secrets in texts: generators, boosted trees, calibrated thresholds.

Generators with high recall propose spans, which may overlap: everything of the base shapes,
phone numbers without a country code, and values after words like ``token``. Spans of a base
shape that pass its check are base spans and always stay; those that fail are none and only
serve as examples. Boosted trees over format and context features judge the others. They learn from all texts, whose candidates
one job counts by feature pattern (``2**FEATURES`` at most): the checks of the base shapes, a strict form of secrets and plain words in their place give
the labels (other values have none); features that only repeat a check's trigger (the plus sign) are left out, so that
what looks alike is found as well. Per kind, the threshold lies just below the least margin that is
right in ``PRECISION`` of the candidates of a third of all texts, which the trees do not see. Of overlapping additions the one with the
higher margin stays; an addition may hold a base span, but not cut into one.

Only DataFrame and SQL functions touch the texts, and nothing is shuffled: each row is judged
by its own text. The patterns start runs of letters or digits only at their beginning or at
the end of the match before, which gives the same matches in linear time. NULL and empty
texts have no spans.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm import boosting

KINDS = ["email", "ip", "card", "phone", "secret"]
PRECISION = 0.95
SHAPES = [  # (kind, base shape?, pattern)
    (0, True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (1, True, r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    (2, True, r"[0-9](?:[\x20-]?+[0-9])++"),
    (3, True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    (3, False, r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])"),
    (4, False, r"(?i)\b(?:token|key|secret|password|passwd)\b[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_=-]{12,}+[\"']?"),
]
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
STRICT_SECRET = r"(?i)^[^=:]*[=:]\x20?\"[0-9a-f]{32,}\"$"
PLAIN_WORD = r"[=:]\x20?[\"']?(?:[a-z]+|[A-Z]+)[\"']?$"
FEATURES = 12 + len(KINDS)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    d = lambda i: digits.substr(i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(
        (n - i) % 2 == 1, F.when(d(i) > 4, 2 * d(i) - 9).otherwise(2 * d(i))).otherwise(d(i)))
    return total % 10 == 0


def _checked(kind: int, m: Column) -> Column:
    """The check of a base shape; for secrets the label, NULL for values no check speaks about."""
    digits = F.length(_digits(m))
    return [
        F.lit(True), m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        F.when(digits.between(14, 19), luhn(_digits(m))).otherwise(False), digits.between(10, 15),
        F.when(m.rlike(STRICT_SECRET), True).when(m.rlike(PLAIN_WORD), False),
    ][kind]


def _placed(text: Column, pattern: str, matches: Column) -> Column:
    """Matches with start and stop (code points): gaps and matches alternate."""
    gaps = F.split(text, pattern, -1)
    state = "struct<at: bigint, out: array<struct<start: bigint, stop: bigint, m: string>>>"

    def step(s: Column, i: Column) -> Column:
        start = s["at"] + F.length(F.get(gaps, i))
        stop = start + F.length(F.get(matches, i))
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), F.get(matches, i).alias("m")))
        return F.struct(stop.alias("at"), F.concat(s["out"], one).alias("out")).cast(state)

    begin = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state)
    none = F.array().cast("array<struct<start: bigint, stop: bigint, m: string>>")
    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), begin, step, lambda s: s["out"])).otherwise(none)


def _pattern_of(kind: int, c: Column) -> Column:
    """Feature bits of a candidate with m, before and after."""
    m, n = c["m"], F.length(_digits(c["m"]))
    bits = [
        n >= 10, n.between(10, 15), n.between(14, 19), F.when(n.between(12, 24), luhn(_digits(m))).otherwise(False),
        m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), m.rlike(r"[0-9]{3}\)?[.\x20-]\x20?[0-9]{3}[.\x20-][0-9]{4}$"), m.rlike("[(].*[)]"),
        m.rlike("(?i)[0-9a-f]{32}"), m.rlike("[\"']"), F.length(m) >= 24, c["before"].rlike(r"\w$"), c["after"].rlike(r"^\w"),
        *[F.lit(kind == k) for k in range(len(KINDS))],
    ]
    out = F.lit(0)
    for i, b in enumerate(bits):
        out = out + F.when(b, 1 << i).otherwise(0)
    return out


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with ``_text`` and ``_c``, an array of candidates with features and the base verdict."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = docs.withColumn("_text", t)
    out = out.withColumns({f"_m{i}": F.regexp_extract_all("_text", F.lit(p), F.lit(0)) for i, (_, _, p) in enumerate(SHAPES)})
    out = out.withColumns({f"_p{i}": _placed(F.col("_text"), p, F.col(f"_m{i}")) for i, (_, _, p) in enumerate(SHAPES)})
    out = out.drop(*[f"_m{i}" for i in range(len(SHAPES))])
    def judged(column: str, kind: int, base: bool) -> Column:
        whole = F.col("_text")
        seen = F.transform(column, lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), x["m"].alias("m"),
            whole.substr(F.greatest(x["start"] - 1, F.lit(0)).cast("int"), F.least(x["start"], F.lit(2)).cast("int")).alias("before"),
            whole.substr((x["stop"] + 1).cast("int"), F.lit(1)).alias("after")))
        return F.transform(seen, lambda c: F.struct(
            c["start"].alias("start"), F.lit(kind).alias("kind"), c["stop"].alias("stop"), _checked(kind, c["m"]).alias("label"),
            F.lit(base).alias("shape"), _pattern_of(kind, c).alias("pattern")))

    parts = [judged(f"_p{i}", kind, base) for i, (kind, base, _) in enumerate(SHAPES)]
    return out.withColumn("_c", F.concat(*parts)).drop(*[f"_p{i}" for i in range(len(SHAPES))])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[list[boosting.Tree], dict[int, float]]:
    """Trees and a threshold per kind: trees from two thirds of all texts, thresholds from the rest, dealt by the key's hash."""
    dealt = docs.select((F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("pii")), F.lit(1 << 30)) % 3 == 0).alias("held"), F.col(f"`{text}`").alias("text"))
    # not plain explode: the planner would put a filter on the array before it and compute it twice
    each = candidates(dealt).select("held", F.explode_outer("_c").alias("c"))
    # candidates that no check speaks about have no label
    rows = each.where(F.col("c.shape") | ((F.col("c.kind") == 4) & F.col("c.label").isNotNull())).groupBy("held", "c.kind", "c.pattern", "c.label").count().collect()
    counts: dict[tuple[int, bool], int] = defaultdict(int)
    for r in rows:
        if not r["held"]:
            counts[r["pattern"], r["label"]] += r["count"]
    trees = boosting.fit(counts, FEATURES) if counts else []
    limits = {}
    for kind in range(len(KINDS)):
        held = [(boosting.margin(trees, r["pattern"]), r["label"], r["count"]) for r in rows if r["held"] and r["kind"] == kind]
        limits[kind] = boosting.threshold(held, PRECISION)
    return trees, limits


def find(docs: DataFrame, model: tuple[list[boosting.Tree], dict[int, float]], text: str = "text", out: str = "pii") -> DataFrame:
    """The table with ``out``, an array of (start, kind, stop, base): base spans and additions, by start and kind."""
    trees, limits = model
    rows = candidates(docs, text)
    base = F.filter("_c", lambda c: c["shape"] & c["label"])
    def passes(c: Column) -> Column:
        ok = F.lit(False)
        for kind, limit in limits.items():
            if limit != float("inf"):
                ok = F.when(c["kind"] == kind, c["margin"] >= limit - 1e-9).otherwise(ok)
        return ok

    rows = rows.withColumns({"_base": base, "_rest": F.filter("_c", lambda c: ~c["shape"])})
    apart = lambda b, c: (b["start"] >= c["stop"]) | (c["start"] >= b["stop"]) | ((c["start"] <= b["start"]) & (b["stop"] <= c["stop"]))
    rows = rows.withColumn("_rest", F.filter("_rest", lambda c: F.forall("_base", lambda b: apart(b, c))))
    rows = rows.withColumn("_rest", F.transform("_rest", lambda c: c.withField("margin", boosting.margin_column(trees, c["pattern"]))))
    rows = rows.withColumn("_rest", F.filter("_rest", passes))
    better = lambda a, c: (a["margin"] > c["margin"]) | ((a["margin"] == c["margin"]) & (
        F.struct(a["start"], a["kind"], a["stop"]) < F.struct(c["start"], c["kind"], c["stop"])))
    rows = rows.withColumn("_rest", F.filter("_rest", lambda c: ~F.exists("_rest", lambda a: (a["start"] < c["stop"]) & (c["start"] < a["stop"]) & better(a, c))))
    plain = lambda spans, base: F.transform(spans, lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), F.lit(base).alias("base")))
    return rows.withColumn(out, F.array_sort(F.concat(plain("_base", True), plain("_rest", False)))).drop("_text", "_c", "_base", "_rest")


def described(spans: Column) -> Column:
    """kind:start:stop of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = text.substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] >= s["at"], F.struct(x["stop"].alias("at"), F.concat(s["out"], gap, F.get(names, x["kind"])).alias("out"))).otherwise(
            F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["out"].alias("out")))

    rest = lambda s: F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, step, rest))
