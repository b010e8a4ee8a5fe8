"""Comparison SQL: named common table expressions and text generators.

``statement(body, doubles)`` puts the expressions a body names (and those they
name) in front of it and rounds the double columns as the queries do.
"""

from __future__ import annotations

import re

from earshot.functions import names, normal
from earshot.params import BACKGROUND_LABELS, CURVE_KEYS, EXCLUDED_PHASES
from earshot.plans.registry import TIE_GUARD

CTES: dict[str, str] = {}


def statement(body: str, doubles: list[str] = (), dates: list[str] = (), digits: int = 6) -> str:
    order: list[str] = []

    def need(text: str, inside: tuple = ()) -> None:
        for name in CTES:
            if name not in order and name not in inside and re.search(rf"\b{name}\b", text):
                need(CTES[name], (*inside, name))
                if name not in order:
                    order.append(name)

    need(body)
    swaps = [f'round(CAST("{c}" AS DOUBLE) + {TIE_GUARD}, {digits}) + 0.0 AS "{c}"' for c in doubles]
    swaps += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in dates]
    star = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return (f"WITH RECURSIVE {head}\n" if head else "") + f"SELECT {star} FROM ({body})"


def _poly(coefs: list[float], x: str) -> str:
    text = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        text = f"({text} * {x} + {c!r})"
    return text


def probit(p: str) -> str:
    """Normal quantile of a probability column."""
    q, t = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    r = f"(0.180625 - {q} * {q})"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly(normal.CENTRAL_NUM, r)} / {_poly(normal.CENTRAL_DEN, r)} "
        f"WHEN {t} <= 5 THEN sign({q}) * {_poly(normal.MIDDLE_NUM, f'({t} - 1.6)')} / {_poly(normal.MIDDLE_DEN, f'({t} - 1.6)')} "
        f"ELSE sign({q}) * {_poly(normal.FAR_NUM, f'({t} - 5)')} / {_poly(normal.FAR_DEN, f'({t} - 5)')} END"
    )


def normal_upper(x: str) -> str:
    a = f"abs({x})"
    tail = f"(exp(-{a} * {a} / 2) * {_poly(normal.TAIL_NUM, a)} / {_poly(normal.TAIL_DEN, a)})"
    return f"CASE WHEN {x} < 0 THEN 1 - {tail} ELSE {tail} END"


def stars(p: str) -> str:
    return (f"CASE WHEN {p} <= 0.001 THEN '***' WHEN {p} <= 0.01 THEN '**' WHEN {p} <= 0.05 THEN '*' "
            f"WHEN {p} <= 0.1 THEN '.' WHEN {p} IS NOT NULL THEN ' ' END")


def level_case(column: str, levels: list[str]) -> str:
    whens = " ".join(f"WHEN {column} = '{v}' THEN {i + 1}" for i, v in enumerate(levels))
    return f"CASE {whens} ELSE {len(levels) + 1} END"


def f_upper(f: str, d1: str, d2: str) -> str:
    """P(F > f) by the power series of the incomplete beta function, as a subquery."""
    a, b, x = f"({d2} / 2.0)", f"({d1} / 2.0)", f"({d2} / ({d2} + {d1} * {f}))"
    one = (f"(SELECT sum(exp(lgamma({a} + {b} + j) - lgamma({a} + j + 1) - lgamma({b}) + ({a} + j) * ln({x}) "
           f"+ {b} * ln(1 - {x}))) FROM range(0, 4000) s(j))")
    two = (f"(SELECT sum(exp(lgamma({a} + {b} + j) - lgamma({b} + j + 1) - lgamma({a}) + ({b} + j) * ln(1 - {x}) "
           f"+ {a} * ln({x}))) FROM range(0, 12000) s(j))")
    return f"CASE WHEN {f} IS NULL THEN NULL WHEN {x} < 0.5 THEN {one} ELSE 1 - {two} END"


# Stand-in tables (rules in FIXTURES.md) ------------------------------------------

CTES["event_days"] = """
SELECT ts, event_id, value, CAST(ts AS DATE) AS Date, day(ts) AS d,
       CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
       ['Green 1', 'Green 2', 'Green 3', 'Orange 1', 'Orange 2'][CAST(user_id % 5 AS INTEGER) + 1] AS ID,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS Type
FROM events"""
CTES["trials"] = """
SELECT Date, ID, CASE WHEN ID LIKE '%Green%' THEN 'Male' ELSE 'Female' END AS Sex,
       CASE WHEN d <= 12 THEN 'Baseline' WHEN d <= 15 THEN 'Recovery' WHEN d <= 26 THEN 'Post HHL'
            WHEN d <= 28 THEN 'Recovery 2' ELSE 'Post 2nd Exposure' END AS Condition,
       CASE WHEN d % 2 = 0 THEN 'NA' ELSE 'PNK' END AS BG_Type,
       CASE WHEN d % 2 = 0 THEN 'NA' ELSE '50' END AS BG_Intensity,
       CASE WHEN k % 10 < 5 THEN 'BBN' ELSE 'tone' END AS Stim, Type,
       CASE WHEN Type = 0 OR k % 10 < 5 THEN 0.0::DOUBLE ELSE ([4.0, 8.0, 16.0, 32.0][k % 4 + 1])::DOUBLE END AS Freq,
       CASE WHEN Type = 0 THEN -100.0::DOUBLE ELSE 10.0::DOUBLE * (k // 10) END AS Inten,
       CASE WHEN ID = 'Green 3' AND k % 10 < 5 THEN ([50.0, 100.0, 300.0][CAST(event_id % 3 AS INTEGER) + 1])::DOUBLE
            WHEN ID = 'Orange 2' AND k % 10 < 5 THEN ([50.0, 100.0, 300.0][d % 3 + 1])::DOUBLE ELSE 50.0::DOUBLE END AS Dur,
       CASE WHEN Type = 0 THEN CASE WHEN value < 8 THEN 'F.A.' ELSE 'C.R.' END
            WHEN value <= 3 + 1.5::DOUBLE * greatest(10 * (k // 10) - CASE WHEN d > 15 THEN 10 ELSE 0 END, 0) THEN 'Hit'
            ELSE 'Miss' END AS Response,
       150 + 3 * (90 - 10 * (k // 10)) + value AS RTime, ts, event_id
FROM event_days"""
CTES["raw_log"] = """
SELECT Date,
  CASE WHEN day(Date) = 9 THEN 'Did not run' ELSE
    CASE WHEN day(Date) % 4 >= 2 THEN '4-32kHz_MIXdB_50ms' WHEN ID = 'Green 3' THEN 'BBN_30-90dB_50-300ms'
         WHEN ID = 'Orange 2' AND day(Date) % 3 = 1 THEN 'BBN_30-90dB_100ms'
         WHEN ID = 'Orange 2' AND day(Date) % 3 = 2 THEN 'BBN_30-90dB_300ms' ELSE 'BBN_30-90dB_50ms' END || CASE WHEN BG_Type = 'NA' THEN '_4s' ELSE '_BG_PNK_50dB_4s' END END AS File,
  CAST(200 + day(Date) AS DOUBLE) AS Weight, day(Date) / 10.0::DOUBLE AS WeightChange,
  CAST(n + CASE WHEN day(Date) % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS Trials, Hit, FA,
  CASE WHEN day(Date) % 4 < 2 THEN '25' WHEN day(Date) % 3 = 0 THEN '12, 15.5, 20, 22' WHEN day(Date) % 3 = 1 THEN '25'
       ELSE 'n/a' END AS Thresholds,
  CASE WHEN day(Date) = 6 THEN NULL WHEN day(Date) = 11 THEN 'Error' WHEN day(Date) = 18 THEN 'Maintaince'
       WHEN day(Date) = 24 THEN 'Training' ELSE 'BBN' || CASE Condition WHEN 'Recovery' THEN ', recovery'
       WHEN 'Post HHL' THEN ', post-HL' WHEN 'Recovery 2' THEN ', recovery2' WHEN 'Post 2nd Exposure' THEN ', post-HL2'
       ELSE '' END END AS Phase, ID
FROM (SELECT ID, Date, Condition, BG_Type, count(*) AS n,
        100.0::DOUBLE * count(*) FILTER (Response = 'Hit') / nullif(count(*) FILTER (Response IN ('Hit', 'Miss')), 0) AS Hit,
        100.0::DOUBLE * count(*) FILTER (Response = 'F.A.') / nullif(count(*) FILTER (Response IN ('F.A.', 'C.R.')), 0) AS FA
      FROM trials GROUP BY ALL)"""
CTES["parsed_log"] = rf"""
SELECT *, regexp_replace(File, '{names.NAME_PATTERN}', '\1') AS Frequency, regexp_replace(File, '{names.NAME_PATTERN}', '\2') AS Intensity,
  regexp_replace(File, '{names.NAME_PATTERN}', '\3') AS Duration,
  CASE WHEN File LIKE '%\_BG\_%' ESCAPE '\' THEN regexp_replace(File, '{names.BACKGROUND_PATTERN}', '\2') ELSE 'NA' END AS BG_Type,
  CASE WHEN File LIKE '%\_BG\_%' ESCAPE '\' THEN regexp_replace(File, '{names.BACKGROUND_PATTERN}', '\3') ELSE 'NA' END AS BG_Intensity
FROM raw_log WHERE File <> 'Did not run'"""
_PHASES = ", ".join(f"'{p}'" for p in EXCLUDED_PHASES)
_tone = lambda i: (rf"CASE WHEN Frequency = '4-32kHz' THEN CAST(round_even(TRY_CAST(regexp_replace(Thresholds, '{names.FOUR_NUMBERS}', "
                   rf"'\{i}') AS DOUBLE), 0) AS DOUBLE) END")
CTES["sessions"] = f"""
SELECT *,
  CASE WHEN regexp_matches(Phase, 'recovery$') THEN 'Recovery' WHEN regexp_matches(Phase, 'post-HL$') THEN 'Post HHL'
       WHEN regexp_matches(Phase, 'recovery2$') THEN 'Recovery 2'
       WHEN regexp_matches(Phase, 'post-HL2$') THEN 'Post 2nd Exposure' ELSE 'Baseline' END AS Condition,
  CASE WHEN ID LIKE '%Green%' THEN 'Male' ELSE 'Female' END AS Sex,
  CASE WHEN Frequency = 'BBN' THEN CAST(round_even(TRY_CAST(Thresholds AS DOUBLE), 0) AS DOUBLE) END AS BBN_TH,
  {_tone(1)} AS "4_TH", {_tone(2)} AS "8_TH", {_tone(3)} AS "16_TH", {_tone(4)} AS "32_TH"
FROM parsed_log WHERE Phase IS NOT NULL AND Phase NOT IN ({_PHASES})"""
CTES["claimed_files"] = """
SELECT Date, ID, File,
  './data/' || strftime(CASE WHEN day(Date) % 13 = 0 THEN Date + INTERVAL 1 DAY ELSE Date END, '%Y%m%d') || '/export/'
  || subject || '_' || subject || '_' || File || '_' || strftime(Date, '%Y%m%d') || '-13000' || run
  || '_BOX#001_raw_data.csv' AS path
FROM (SELECT *, CASE WHEN day(Date) % 17 = 0 THEN 'Orange9' ELSE replace(ID, ' ', '') END AS subject,
        unnest(CASE WHEN day(Date) % 8 = 0 THEN [] WHEN day(Date) % 10 = 0 THEN [1, 2] ELSE [1] END) AS run
      FROM raw_log WHERE File <> 'Did not run')"""
CTES["listed_files"] = """
SELECT DISTINCT path, regexp_extract(path, '/data/([0-9]+)/', 1) AS folder,
  regexp_extract(path, '([^/]+)$', 1) AS name, regexp_extract(regexp_extract(path, '([^/]+)$', 1), '^([^_]+)_', 1) AS subject
FROM claimed_files"""

CTES["abr_rows"] = """
SELECT 'A' || CAST(l_suppkey % 12 AS VARCHAR) AS ID,
  ['Baseline', 'Hearing Loss', '1 day', '1 week', '2 week', '4 week', '5 week'][l_linenumber] AS Condition,
  ['0', '4', '8', '16', '32'][CAST(l_partkey % 5 AS INTEGER) + 1] AS Freq,
  10.0::DOUBLE * (1 + CAST(l_quantity AS INTEGER) % 10) AS Inten, l_extendedprice / 10000 AS RMS,
  CASE WHEN l_partkey % 97 <> 0 THEN l_extendedprice / 50000 + (10.0::DOUBLE * (1 + CAST(l_quantity AS INTEGER) % 10)) / 100 END AS W1,
  l_suppkey AS source
FROM lineitem"""
CTES["abr_detailed"] = """
SELECT * EXCLUDE (source) REPLACE (CASE WHEN Freq = '0' THEN 'BBN' ELSE Freq END AS Freq) FROM abr_rows WHERE source % 2 = 1"""
CTES["abr_all"] = """
SELECT * EXCLUDE (source) REPLACE (CASE WHEN Freq = '0' THEN 'BBN' ELSE Freq END AS Freq,
  CASE WHEN Condition IN ('4 week', '5 week') THEN '4-5 week' ELSE Condition END AS Condition) FROM abr_rows"""
CTES["abr_th"] = """
SELECT CASE WHEN o_custkey % 50 <> 0 THEN 'A' || CAST(o_custkey % 12 AS VARCHAR) END AS ID,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'Baseline' WHEN '2' THEN '1 day' WHEN '3' THEN '1 week' WHEN '4' THEN '2 week'
       ELSE '4-5 week' END AS Condition,
  CASE o_orderstatus WHEN 'F' THEN 'Left' WHEN 'O' THEN 'Right' ELSE 'Both' END AS Ear,
  ['BBN', '4', '8', '16', '32'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS Freq,
  CASE WHEN o_orderkey % 31 <> 0 THEN 5.0::DOUBLE * floor(o_totalprice / 50000) END AS Run_TH,
  CASE WHEN o_orderkey % 37 <> 0 THEN 5.0::DOUBLE * floor(o_totalprice / 40000) END AS RMS_TH,
  CASE WHEN o_orderkey % 41 <> 0 THEN 5.0::DOUBLE * floor(o_totalprice / 30000) END AS Wave_TH
FROM orders"""

# Derived tables -------------------------------------------------------------------

CTES["numbered_trials"] = """
SELECT *, row_number() OVER (PARTITION BY Date, ID, Sex, Stim ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY Date, ID, Sex, Stim) AS total, CASE Stim WHEN 'tone' THEN 10 ELSE 5 END AS m
FROM trials"""
CTES["no_first"] = """
SELECT * EXCLUDE (rn, total, m), total // m - 1 AS Blocks_trimmed, rn - m AS block_row
FROM numbered_trials WHERE rn > m AND rn <= (total // m) * m"""
CTES["blocks_left"] = """
SELECT Date, ID, Sex, Stim, greatest(count(*) // any_value(CASE Stim WHEN 'tone' THEN 10 ELSE 5 END) - 1, 0) AS Blocks_trimmed
FROM trials GROUP BY ALL"""
CTES["caps"] = """
SELECT min(Blocks_trimmed) FILTER (Stim = 'BBN') AS bbn_cap,
  greatest(min(Blocks_trimmed) FILTER (Stim = 'tone'), 2) AS tone_cap FROM blocks_left"""
CTES["analysis"] = "SELECT * FROM no_first WHERE ID NOT IN ('Green 2')"


def responses(source: str) -> str:
    c = lambda r: f"nullif(count(*) FILTER (Response = '{r}'), 0)"
    return f"""
SELECT ID, Sex, Condition, Stim, BG_Type, BG_Intensity, Dur, Type, Freq, Inten,
  {c('C.R.')} AS CR, {c('F.A.')} AS FA, {c('Hit')} AS Hit, {c('Miss')} AS Miss
FROM {source} GROUP BY ALL"""


def go_rows(source: str) -> str:
    return f"""
SELECT g.* REPLACE (coalesce(g.CR, n.CR, 0) AS CR, coalesce(g.FA, n.FA, 0) AS FA, coalesce(g.Hit, 0) AS Hit,
  coalesce(g.Miss, 0) AS Miss)
FROM {source} g LEFT JOIN (SELECT ID, Sex, Condition, Stim, BG_Type, BG_Intensity, Dur, sum(CR) AS CR, sum(FA) AS FA
  FROM {source} WHERE Type = 0 GROUP BY ALL) n USING (ID, Sex, Condition, Stim, BG_Type, BG_Intensity, Dur)
WHERE g.Type = 1"""


def indices(source: str) -> str:
    return f"""
SELECT ID, Sex, Condition, Stim, BG_Type, BG_Intensity, Dur,
  CASE WHEN Freq = 0 THEN 'BBN' ELSE CAST(CAST(Freq AS INTEGER) AS VARCHAR) || 'kHz' END AS Type, Inten AS dB,
  CAST(Hit AS BIGINT) AS Hit, CAST(Miss AS BIGINT) AS Miss, CAST(FA AS BIGINT) AS FA, CAST(CR AS BIGINT) AS CR,
  zh - zf AS dprime, exp((zf * zf - zh * zh) / 2) AS beta,
  CASE WHEN h = f THEN 0.5 WHEN f > h THEN 0.5 - (f - h) * (1 + f - h) / nullif(4 * f * (1 - h), 0)
       ELSE 0.5 + (h - f) * (1 + h - f) / nullif(4 * h * (1 - f), 0) END AS aprime,
  ((1 - h) * (1 - f) - h * f) / nullif((1 - h) * (1 - f) + h * f, 0) AS bppd, -(zh + zf) / 2 AS c
FROM (SELECT *, {probit('ph')} AS zh, {probit('pf')} AS zf FROM
  (SELECT *, (Hit + 0.5::DOUBLE) / (Hit + Miss + 1) AS ph, (FA + 0.5::DOUBLE) / (FA + CR + 1) AS pf,
     Hit::DOUBLE / nullif(Hit + Miss, 0) AS h, FA::DOUBLE / nullif(FA + CR, 0) AS f FROM {source}))"""


CTES["counts_analysis"] = responses("analysis")
CTES["go_analysis"] = go_rows("counts_analysis")
CTES["dprimes"] = indices("go_analysis")
CTES["counts_all"] = responses("trials")
CTES["go_all"] = go_rows("counts_all")
CTES["dprimes_all"] = indices("go_all")

K = ", ".join(CURVE_KEYS)
CTES["curve_points"] = f"""
SELECT {K}, dB AS x, dprime AS y, row_number() OVER (PARTITION BY {K} ORDER BY dB) AS r,
  count(*) OVER (PARTITION BY {K}) AS n, CAST(floor(count(*) OVER (PARTITION BY {K}) * 0.75 + 0.00001) AS BIGINT) AS q
FROM dprimes"""
CTES["curve_cells"] = f"""
SELECT DISTINCT {K}, n, CAST(1 AS BIGINT) AS l, n AS u FROM curve_points
UNION ALL
SELECT {K}, n, unnest([l, (l + u) // 2 + 1]), unnest([(l + u) // 2, u]) FROM curve_cells
WHERE u > l AND u - l + 1 > floor(n * 0.75::DOUBLE * 0.2::DOUBLE)"""
CTES["curve_borders"] = f"""
SELECT {K}, (a.x + b.x) / 2 AS v FROM (SELECT DISTINCT {K}, l FROM curve_cells WHERE l > 1) c
  JOIN curve_points a USING ({K}) JOIN curve_points b USING ({K}) WHERE a.r = l - 1 AND b.r = l
UNION ALL
SELECT {K}, unnest([lo - w, hi + w]) AS v FROM (SELECT {K}, min(x) AS lo, max(x) AS hi,
  0.005 * greatest(max(x) - min(x), greatest(abs(min(x)), abs(max(x))) * 1e-3 + 1e-30) AS w FROM curve_points GROUP BY ALL)"""
# of one or two points: the least-norm quadratic through them, by the pseudo-inverse of the scaled normal matrix
CTES["curve_fits"] = f"""
SELECT {K}, v,
  CASE WHEN kk >= 3 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / nullif(det, 0)
    ELSE i0 * CASE WHEN e2 > 1e-12 THEN ((e1 * e1 - e2) * g0 - e1 * (n00 * g0 + n01 * g1 + n02 * g2)) / (e2 * e2) ELSE g0 / (e1 * e1) END END AS f,
  CASE WHEN kk >= 3 THEN (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2)) / nullif(det, 0) / h
    ELSE i1 * CASE WHEN e2 > 1e-12 THEN ((e1 * e1 - e2) * g1 - e1 * (n01 * g0 + n11 * g1 + n12 * g2)) / (e2 * e2) ELSE g1 / (e1 * e1) END / h END AS d
FROM (SELECT *, n00 * r0 + n01 * r1 + n02 * r2 AS g0, n01 * r0 + n11 * r1 + n12 * r2 AS g1, n02 * r0 + n12 * r1 + n22 * r2 AS g2,
   n00 + n11 + n22 AS e1, n00 * n11 - n01 * n01 + n00 * n22 - n02 * n02 + n11 * n22 - n12 * n12 AS e2
FROM (SELECT *, s0 * i0 * i0 AS n00, s1 * i0 * i1 AS n01, s2 * i0 * i2 AS n02, s2 * i1 * i1 AS n11, s3 * i1 * i2 AS n12, s4 * i2 * i2 AS n22,
   t0 * i0 AS r0, t1 * i1 AS r1, t2 * i2 AS r2
FROM (SELECT *, CASE WHEN s0 > 0 THEN 1 / sqrt(s0) ELSE 0 END AS i0, CASE WHEN s2 > 0 THEN 1 / sqrt(s2) ELSE 0 END AS i1,
   CASE WHEN s4 > 0 THEN 1 / sqrt(s4) ELSE 0 END AS i2
FROM (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM
 (SELECT {K}, v, any_value(h) AS h, count(*) AS kk, sum(w) AS s0, sum(w * z) AS s1, sum(w * z ** 2) AS s2, sum(w * z ** 3) AS s3,
    sum(w * z ** 4) AS s4, sum(w * y) AS t0, sum(w * z * y) AS t1, sum(w * z ** 2 * y) AS t2
  FROM (SELECT *, (x - v) / h AS z, (1 - abs((x - v) / h) ** 3) ** 3 AS w FROM
    (SELECT {K}, v, x, y, max(CASE WHEN place = q THEN dist END) OVER (PARTITION BY {K}, v) AS h FROM
      (SELECT {K}, v, x, y, q, abs(x - v) AS dist, row_number() OVER (PARTITION BY {K}, v ORDER BY abs(x - v)) AS place
       FROM curve_points JOIN curve_borders USING ({K})))
    WHERE (x - v) ** 2 < 0.999 * h ** 2) GROUP BY {K}, v)))))"""
CTES["curve_pieces"] = f"""
SELECT *, lead(v) OVER w AS v2, lead(f) OVER w AS f2, lead(d) OVER w AS d2 FROM
 (SELECT {K}, v, f, d FROM curve_borders LEFT JOIN curve_fits USING ({K}, v)) WINDOW w AS (PARTITION BY {K} ORDER BY v)"""
CTES["curve_fitted"] = f"""
SELECT {K}, x, y, (1 + 2 * s) * (1 - s) ** 2 * f + s * (1 - s) ** 2 * g * d + s * s * (3 - 2 * s) * f2 + s * s * (s - 1) * g * d2 AS fitted
FROM (SELECT *, (x - v) / (v2 - v) AS s, v2 - v AS g FROM curve_points JOIN curve_pieces USING ({K}) WHERE v <= x AND x < v2)"""
CTES["thresholds"] = f"""
SELECT {K}, CASE WHEN any_value(whole) THEN CASE WHEN max(a) = max(b) THEN avg(x) FILTER (fitted = a)
  ELSE avg(x) FILTER (fitted = a) + (1.5 - max(a)) / (max(b) - max(a)) * (avg(x) FILTER (fitted = b) - avg(x) FILTER (fitted = a)) END END AS TH
FROM (SELECT *, max(fitted) FILTER (fitted <= 1.5) OVER w AS a, min(fitted) FILTER (fitted >= 1.5) OVER w AS b,
   count(fitted) OVER w = count(*) OVER w AS whole FROM (SELECT * REPLACE (round(fitted, 9) AS fitted) FROM curve_fitted) WINDOW w AS (PARTITION BY {K})) GROUP BY {K}"""
TH = "ID, Sex, Condition, BG_Type, BG_Intensity, Dur"


def by_stimulus(source: str) -> str:
    cells = ", ".join(f"""avg(TH) FILTER (Type = '{t}') AS "{t}" """ for t in ("BBN", "4kHz", "8kHz", "16kHz", "32kHz"))
    return f"SELECT {TH}, {cells} FROM {source} GROUP BY ALL"


CTES["th_wide"] = by_stimulus("thresholds")
CTES["bracket"] = f"""
SELECT {K}, CAST(round_even(sum((1 - score) * dB) / sum(1 - score), 0) AS DOUBLE) AS TH FROM
 (SELECT *, rank() OVER (PARTITION BY {K} ORDER BY score) + (count(*) OVER (PARTITION BY {K}, score) - 1) / 2.0 AS r FROM
   (SELECT {K}, dB, abs(dprime - 1.5) AS score FROM dprimes WHERE abs(dprime - 1.5) < 1)) WHERE r IN (1, 2) GROUP BY {K}"""
CTES["bracket_wide"] = by_stimulus("bracket")
_labels = " ".join(f"WHEN BG_Type = '{a}' AND BG_Intensity = '{b}' THEN '{l}'" for (a, b), l in BACKGROUND_LABELS.items())
BACKGROUND = f"CASE {_labels} ELSE 'ISSUE' END"
CTES["dprime_pairs"] = f"""
SELECT ID, Sex, Type, BG_Type, BG_Intensity, Dur, dB, {BACKGROUND} AS BG,
  avg(dprime) FILTER (Condition = 'Baseline') AS base, avg(dprime) FILTER (Condition = 'Post HHL') AS post
FROM dprimes WHERE Condition IN ('Baseline', 'Post HHL') GROUP BY ALL"""
CTES["avg_th"] = """
SELECT BG_Type, BG_Intensity, Type, CAST(round_even(avg(TH), 0) AS DOUBLE) AS TH FROM
 (SELECT BG_Type, BG_Intensity, unnest(['BBN', '4kHz', '8kHz', '16kHz', '32kHz']) AS Type,
    unnest([BBN, "4kHz", "8kHz", "16kHz", "32kHz"]) AS TH FROM th_wide WHERE Condition IN ('Baseline', 'Post HHL'))
GROUP BY ALL"""

CTES["over_th"] = """
SELECT h.* FROM
 (SELECT *, CASE WHEN Freq = 0 THEN 'BBN' ELSE CAST(CAST(Freq AS INTEGER) AS VARCHAR) || 'kHz' END AS kind FROM analysis
  WHERE Type = 1 AND Response = 'Hit' AND Inten <> -100) h
LEFT JOIN (SELECT ID, Condition, BG_Intensity, Dur FROM thresholds GROUP BY ALL) s USING (ID, Condition, BG_Intensity, Dur)
LEFT JOIN (SELECT ID, Condition, BG_Intensity, Dur, Type AS kind, TH FROM thresholds
           QUALIFY row_number() OVER (PARTITION BY ID, Condition, BG_Intensity, Dur, Type ORDER BY BG_Type) = 1) t
  USING (ID, Condition, BG_Intensity, Dur, kind)
WHERE h.Inten >= CASE WHEN s.ID IS NULL THEN -99 ELSE t.TH END"""
RXN = "ID, Sex, Condition, BG_Type, BG_Intensity, Stim, Dur, Freq, Inten"
CTES["rxn"] = f"SELECT {RXN}, count(RTime) AS n, avg(RTime) AS mean FROM over_th GROUP BY ALL"
CTES["rxn_pairs"] = """
SELECT ID, Sex, BG_Type, BG_Intensity, Stim, Dur, Freq, Inten, avg(mean) FILTER (Condition = 'Baseline') AS "Baseline",
  avg(mean) FILTER (Condition = 'Post HHL') AS "Post HHL"
FROM rxn WHERE Condition IN ('Baseline', 'Post HHL') GROUP BY ALL"""
CTES["hits_by_day"] = """
SELECT *, CR + FA + Hit + Miss AS Trials, Hit::DOUBLE / nullif(Hit + Miss, 0) AS HitRate, FA::DOUBLE / nullif(CR + FA, 0) AS FARate FROM
 (SELECT Date, ID, Sex, Condition, Stim, BG_Type, BG_Intensity, count(*) FILTER (Response = 'C.R.') AS CR,
    count(*) FILTER (Response = 'F.A.') AS FA, count(*) FILTER (Response = 'Hit') AS Hit, count(*) FILTER (Response = 'Miss') AS Miss
  FROM analysis WHERE Condition <> 'Recovery' GROUP BY ALL)"""
CTES["hit_means"] = """
SELECT ID, Sex, Condition, Stim, BG_Type, BG_Intensity, count(DISTINCT Date) AS count, avg(Trials) AS Trials,
  avg(HitRate) AS Hit, avg(FARate) AS FA FROM hits_by_day GROUP BY ALL"""
CTES["log_means"] = """
SELECT ID, Sex, Condition, Frequency, BG_Type, BG_Intensity, count(DISTINCT Date) AS count, avg(Trials) AS Trials,
  avg(Hit) AS Hit, avg(FA) AS FA FROM sessions WHERE ID NOT IN ('Green 2') GROUP BY ALL"""
CTES["duration_rows"] = """
SELECT ID, Sex, Condition, Stim, Dur, Inten,
  CASE WHEN Duration IN ('50ms', '100ms', '300ms') THEN 'Alone' WHEN Duration = '50-300ms' THEN 'Mixed' ELSE Duration END AS Duration, Rxn
FROM (SELECT t.ID, t.Sex, t.Condition, Stim, Dur, Inten, s.Duration, avg(RTime) AS Rxn
  FROM no_first t LEFT JOIN (SELECT Date, ID, Duration FROM sessions WHERE Frequency = 'BBN' AND Condition = 'Baseline') s
    ON t.Date = s.Date AND t.ID = s.ID
  WHERE Type = 1 AND Response = 'Hit' AND Inten <> -100 AND Stim = 'BBN' AND t.Condition = 'Baseline' GROUP BY ALL)"""
CTES["abr_cells"] = """
SELECT ID, Freq, Inten, Condition, CASE WHEN count(RMS) = count(*) THEN avg(RMS) END AS RMS,
  CASE WHEN count(W1) = count(*) THEN avg(W1) END AS W1 FROM abr_all GROUP BY ALL"""
CTES["abr_th_rows"] = """
SELECT Condition, Freq, Wave_TH AS TH FROM abr_th WHERE Wave_TH IS NOT NULL"""


def mean_se(source: str, by: list[str], value: str, where: str = "true") -> str:
    keys = ", ".join(f'"{k}"' for k in by)
    return f"""
SELECT {keys}, n, mean, se, mean - se AS lower, mean + se AS upper FROM
 (SELECT {keys}, count({value}) AS n, avg({value}) AS mean, sqrt(var_samp({value}) / count({value})) AS se
  FROM {source} WHERE {where} GROUP BY ALL) WHERE n > 0"""


def box(source: str, by: list[str], value: str) -> str:
    keys = ", ".join(f'"{k}"' for k in by)
    return f"""
SELECT {keys}, any_value(n) AS n, any_value(lo) AS lower, any_value(mid) AS middle, any_value(hi) AS upper,
  min(v) FILTER (v BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)) AS ymin,
  max(v) FILTER (v BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)) AS ymax,
  count(*) FILTER (NOT v BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)) AS outliers
FROM (SELECT {keys}, {value} AS v, count(*) OVER w AS n, quantile_cont({value}, 0.25) OVER w AS lo,
   quantile_cont({value}, 0.5) OVER w AS mid, quantile_cont({value}, 0.75) OVER w AS hi
  FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys}"""


def describe(source: str, by: list[str], value: str) -> str:
    keys = ", ".join(f'"{k}"' for k in by)
    return f"""
SELECT {keys}, count(*) AS n, any_value(m) AS mean, stddev_samp(v) AS sd, any_value(med) AS median,
  avg(v) FILTER (r > c AND r <= n - c) AS trimmed, 1.4826 * quantile_cont(abs(v - med), 0.5) AS mad, min(v) AS min, max(v) AS max,
  max(v) - min(v) AS range, sum((v - m) ** 3) / (count(*) * nullif(stddev_samp(v), 0) ** 3) AS skew,
  sum((v - m) ** 4) / (count(*) * nullif(stddev_samp(v), 0) ** 4) - 3 AS kurtosis, stddev_samp(v) / sqrt(count(*)) AS se
FROM (SELECT {keys}, {value} AS v, avg({value}) OVER w AS m, quantile_cont({value}, 0.5) OVER w AS med, count(*) OVER w AS n,
   floor(0.1 * count(*) OVER w) AS c, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS r
  FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys}"""


def orthogonal(name: str, source: str, y: str, terms: list[tuple], levels: dict[str, list]) -> int:
    """Add expressions that make the design columns of a model orthogonal, one after another.

    The last one is ``<name>_done`` with y reduced to its residual (``y``), the
    columns ``x0..`` and the original row; returns the number of columns.
    """
    columns: list[tuple[int, str]] = [(-1, "1.0::DOUBLE")]
    for i, term in enumerate(terms):
        parts = [""]
        for v in term:
            steps = ([f"(CASE WHEN \"{v}\" = '{l}' THEN 1.0::DOUBLE ELSE 0 END)" for l in levels[v][1:]]
                     if v in levels else [f'"{v}"'])
            parts = [f"{p} * {s}" if p else s for s in steps for p in parts]
        columns += [(i, p) for p in parts]
    variables = list(dict.fromkeys(v for t in terms for v in t))
    known = " AND ".join(f'"{v}" IS NOT NULL' for v in variables + [y])
    for v in variables:  # rows of a level that is not listed do not take part
        if v in levels:
            known += f""" AND "{v}" IN ({', '.join(f"'{l}'" for l in levels[v])})"""
    CTES[f"{name}_m0"] = (f'SELECT *, "{y}"::DOUBLE AS y, ' + ", ".join(f"{s} AS x{j}" for j, (_, s) in enumerate(columns))
                         + "".join(f", {s} AS o{j}" for j, (_, s) in enumerate(columns)) + f" FROM {source} WHERE {known}")
    p = len(columns)
    for k in range(p):
        later = [f"x{j}" for j in range(k + 1, p)] + ["y"]
        ok = f"sum(x{k} * x{k}) OVER () > 1e-9 * sum(o{k} * o{k}) OVER ()"
        swaps = ", ".join(
            f"{c} - CASE WHEN {ok} THEN x{k} * (sum({c} * x{k}) OVER ()) / (sum(x{k} * x{k}) OVER ()) ELSE 0 END AS {c}" for c in later
        )
        CTES[f"{name}_m{k + 1}"] = (
            f"SELECT * REPLACE ({swaps}), CASE WHEN {ok} THEN (sum(y * x{k}) OVER ()) ** 2 / (sum(x{k} * x{k}) OVER ()) END AS ss{k} "
            f"FROM {name}_m{k}"
        )
    CTES[f"{name}_done"] = f"SELECT * FROM {name}_m{p}"
    _MODELS[name] = ([i for i, _ in columns], terms)
    return p


_MODELS: dict[str, tuple] = {}


def anova(name: str) -> str:
    """Table of a model added with :func:`orthogonal`."""
    owners, terms = _MODELS[name]
    parts = []
    for i, term in enumerate(terms):
        js = [j for j, o in enumerate(owners) if o == i]
        ss = " + ".join(f"coalesce(any_value(ss{j}), 0)" for j in js)
        df = " + ".join(f"CASE WHEN any_value(ss{j}) IS NULL THEN 0 ELSE 1 END" for j in js)
        parts.append(f"SELECT {i + 1} AS position, '{':'.join(term)}' AS term, {df} AS df, {ss} AS sum_sq FROM {name}_done")
    used = " + ".join(f"CASE WHEN any_value(ss{j}) IS NULL THEN 0 ELSE 1 END" for j in range(len(owners)))
    rest = f"SELECT count(*) - ({used}) AS rdf, sum(y * y) AS rss FROM {name}_done"
    lines = " UNION ALL ".join(parts)
    return f"""
SELECT position, term, df, sum_sq, mean_sq, f, {f_upper('f', 'df', 'rdf')} AS p FROM
 (SELECT position, term, df, sum_sq, sum_sq / df AS mean_sq, sum_sq / df / (rss / rdf) AS f, rdf
  FROM ({lines}) t, ({rest}) r WHERE df > 0)
UNION ALL SELECT {len(terms) + 1}, 'Residuals', rdf, rss, rss / rdf, NULL, NULL FROM ({rest})"""


def heavy_tail(name: str, source: str, y: str) -> None:
    """Add expressions that draw the heavy tails of ``y`` in: ``<name>`` is the source with y replaced.

    ``<name>_at`` holds the parameters, found by plain Newton steps in a recursive
    expression; it is empty where kurtosis does not exceed 3.
    """
    def score(z: str, delta: str) -> str:
        x = f"({delta} * {z} * {z})"
        steps = f"list_prepend(ln(1.0::DOUBLE + {x}), [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0])"
        miss = f"(w * exp(w) - {x})"
        halley = f"w - {miss} / (exp(w) * (w + 1.0) - (w + 2.0) * {miss} / (2.0 * w + 2.0))"
        return f"sign({z}) * sqrt(list_reduce({steps}, lambda w, i: {halley}) / {delta})"

    def det(a: list[list[str]]) -> str:
        (b, c, d), (e, f, g), (h, i, j) = a
        return f"({b} * ({f} * {j} - {g} * {i}) - {c} * ({e} * {j} - {g} * {h}) + {d} * ({e} * {i} - {f} * {h}))"

    CTES[f"{name}_values"] = f'SELECT "{y}"::DOUBLE AS v, count(*) AS t FROM {source} WHERE isfinite("{y}"::DOUBLE) GROUP BY 1'
    CTES[f"{name}_start"] = f"""
SELECT n, mean, sd, greatest((sqrt(greatest(66 * k - 162, 0)) - 6) / 66, 0.01) AS delta FROM
 (SELECT any_value(n) AS n, any_value(mean) AS mean, sqrt(sum(t * (v - mean) ** 2) / (any_value(n) - 1)) AS sd,
    sum(t * (v - mean) ** 4) * any_value(n) / sum(t * (v - mean) ** 2) ** 2 AS k
  FROM {name}_values, (SELECT sum(t) AS n, sum(t * v) / sum(t) AS mean FROM {name}_values)) WHERE k > 3"""
    slopes = ["-bz / sigma", "-bz * z / sigma", "-(u ** 3) / 2 / (1 + delta * u * u)"]
    sums = ", ".join([f"sum(t * u ** {k}) / any_value(n) AS e{k}" for k in (1, 2, 4)]
                     + [f"sum(t * {k} * u ** {k - 1} * ({s})) / any_value(n) AS e{k}{j}" for k in (1, 2, 4) for j, s in enumerate(slopes)])
    off = ["e1", "(e2 * n / (n - 1) - 1)", "(e4 / e2 ** 2 - 3)"]
    grid = [[f"e1{j}" for j in range(3)], [f"(e2{j} * n / (n - 1))" for j in range(3)],
            [f"(e4{j} / e2 ** 2 - 2 * e4 / e2 ** 3 * e2{j})" for j in range(3)]]
    moves = [f"{det([[off[i] if k == j else grid[i][k] for k in range(3)] for i in range(3)])} / {det(grid)}" for j in range(3)]
    CTES[f"{name}_steps"] = f"""
SELECT 0 AS i, n, mean AS mu, sd * (1 - 2 * least(delta, 0.4)) ** 0.75 AS sigma, delta FROM {name}_start
UNION ALL SELECT i + 1, n, mu - m0, greatest(sigma - m1, sigma / 5), greatest(delta - m2, delta / 5) FROM
 (SELECT i, n, mu, sigma, delta, {', '.join(f'{m} AS m{j}' for j, m in enumerate(moves))} FROM
  (SELECT i, any_value(n) AS n, any_value(mu) AS mu, any_value(sigma) AS sigma, any_value(delta) AS delta, {sums} FROM
   (SELECT *, exp(-u * u * delta / 2) / (1 + delta * u * u) AS bz FROM
    (SELECT *, {score('z', 'delta')} AS u FROM (SELECT *, (v - mu) / sigma AS z FROM {name}_steps, {name}_values WHERE i < 15))) GROUP BY i))"""
    CTES[f"{name}_at"] = f"SELECT n, mu, sigma, delta FROM {name}_steps WHERE i = 15"
    CTES[name] = f"""
SELECT * EXCLUDE (_mu, _sigma, _delta) REPLACE (CASE WHEN _delta IS NULL OR NOT isfinite("{y}"::DOUBLE) THEN "{y}"
  ELSE {score(f'(("{y}" - _mu) / _sigma)', '_delta')} * _sigma + _mu END AS "{y}")
FROM {source} LEFT JOIN (SELECT mu AS _mu, sigma AS _sigma, delta AS _delta FROM {name}_at) ON true"""


def coefficients(name: str, source: str, y: str, terms: list[tuple], levels: dict[str, list], keys: list[str], names: list[str]) -> str:
    """Coefficients of one model per key, by making its design columns orthogonal within each key.

    With Q = X T, the coefficients are T (Q'Q)^-1 Q'y; columns that earlier ones explain are left out.
    """
    xs = ["1.0::DOUBLE"]
    for term in terms:
        parts = [""]
        for v in term:
            steps = ([f"(CASE WHEN \"{v}\" = '{l}' THEN 1.0::DOUBLE ELSE 0 END)" for l in levels[v][1:]] if v in levels else [f'"{v}"'])
            parts = [f"{p} * {s}" if p else s for s in steps for p in parts]
        xs += parts
    size, by = len(xs), ", ".join(keys)
    known = " AND ".join(f'"{v}" IS NOT NULL' for v in [*dict.fromkeys(v for t in terms for v in t), y])
    CTES[f"{name}_c0"] = (f'SELECT {by}, "{y}"::DOUBLE AS y, ' + ", ".join(f"{x} AS x{j}, {x} AS o{j}" for j, x in enumerate(xs))
                         + f" FROM {source} WHERE {known}")
    for k in range(size):
        later = [f"x{j}" for j in range(k + 1, size)] + ["y"]
        own = f"sum(x{k} * x{k}) OVER w"
        kept = f"{own} > 1e-9 * sum(o{k} * o{k}) OVER w"
        shares = ", ".join(f"CASE WHEN {kept} THEN sum({c} * x{k}) OVER w / {own} ELSE 0 END AS r{k}_{c}" for c in later)
        swaps = ", ".join(f"{c} - r{k}_{c} * x{k} AS {c}" for c in later)
        CTES[f"{name}_c{k + 1}"] = (f"SELECT * REPLACE ({swaps}) FROM (SELECT *, {shares}, CASE WHEN {kept} THEN {own} END AS d{k} "
                                    f"FROM {name}_c{k} WINDOW w AS (PARTITION BY {by}))")
    shared = [f"r{k}_{c}" for k in range(size) for c in [f"x{j}" for j in range(k + 1, size)] + ["y"]] + [f"d{k}" for k in range(size)]
    solved = (f"SELECT {by}, sum(y * y) AS rss, count(*) AS n, " + ", ".join(f"any_value({c}) AS {c}" for c in shared)
              + "".join(f", 1.0::DOUBLE AS t{k}_{k}" for k in range(size)) + f" FROM {name}_c{size} GROUP BY {by}")
    for k in range(1, size):
        column = ", ".join(f"-({' + '.join(f'r{i}_x{k} * t{j}_{i}' for i in range(j, k))}) AS t{j}_{k}" for j in range(k))
        solved = f"SELECT *, {column} FROM ({solved})"
    used = " + ".join(f"(d{k} IS NOT NULL)::INTEGER" for k in range(size))
    CTES[f"{name}_solved"] = f"SELECT *, n - ({used}) AS rdf FROM ({solved})"
    rows = " UNION ALL ".join(
        f"SELECT {by}, {j} AS position, '{names[j]}' AS coefficient, {' + '.join(f't{j}_{k} * r{k}_y' for k in range(j, size))} AS estimate, "
        f"CASE WHEN rdf > 0 THEN sqrt(rss / rdf * ({' + '.join(f'coalesce(t{j}_{k} ** 2 / d{k}, 0)' for k in range(j, size))})) END AS std_error, rdf "
        f"FROM {name}_solved WHERE d{j} IS NOT NULL" for j in range(size))
    return f"""
SELECT * EXCLUDE (rdf), {f_upper('(t * t)', '1', 'rdf')} AS p FROM (SELECT *, estimate / nullif(std_error, 0) AS t FROM ({rows}))"""


def shapiro(source: str, value: str) -> str:
    """W and p of one sample of more than 11 values."""
    from earshot.operators import ranktests as r
    return f"""
SELECT n, W, {normal_upper('z')} AS p FROM
 (SELECT *, (ln(1 - W) - ({_poly(r.LARGE_MEAN, 'ln(n)')})) / exp({_poly(r.LARGE_SD, 'ln(n)')}) AS z FROM
  (SELECT n, (a1 * d1 + a2 * d2 + mid / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))) ** 2 / ss AS W FROM
   (SELECT *, {_poly(r.OUTER, '(1 / sqrt(n))')} + m1 / sqrt(mm) AS a1, {_poly(r.NEXT, '(1 / sqrt(n))')} + m2 / sqrt(mm) AS a2 FROM
    (SELECT any_value(n) AS n, sum(m * m) AS mm, max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, max(v) - min(v) AS d1,
       max(v) FILTER (i = n - 1) - max(v) FILTER (i = 2) AS d2, sum(m * v) FILTER (i > 2 AND i <= n - 2) AS mid,
       var_samp(v) * (count(*) - 1) AS ss
     FROM (SELECT *, {probit('pr')} AS m FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) AS i, count(*) OVER () AS n,
       (row_number() OVER (ORDER BY {value}) - 0.375::DOUBLE) / (count(*) OVER () + 0.25) AS pr FROM {source} WHERE {value} IS NOT NULL))))))"""


def midranks(source: str, value: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    both = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return (f"SELECT *, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({both}) - 1) / 2.0::DOUBLE AS mr, "
            f"count(*) OVER ({both}) AS tie, count(*) OVER ({part}) AS big_n FROM {source} WHERE {value} IS NOT NULL")


def kruskal(source: str, value: str, group: str) -> str:
    return f"""
SELECT n, df, h, CASE WHEN df = 1 THEN 2 * ({normal_upper('sqrt(h)')})
  WHEN df = 2 THEN exp(-h / 2) WHEN df = 3 THEN 2 * ({normal_upper('sqrt(h)')}) + sqrt(2 * h / pi()) * exp(-h / 2) END AS p FROM
 (SELECT big_n AS n, groups - 1 AS df, (12.0::DOUBLE * s / (big_n * (big_n + 1)) - 3.0 * (big_n + 1)) / (1 - ties / (big_n ** 3 - big_n)) AS h FROM
  (SELECT any_value(big_n)::DOUBLE AS big_n, count(*) AS groups, sum(rs * rs / c) AS s, sum(ts) AS ties FROM
   (SELECT {group}, any_value(big_n) AS big_n, count(*) AS c, sum(mr) AS rs, sum(tie ** 2 - 1) AS ts
    FROM ({midranks(source, value)}) GROUP BY {group})))"""
