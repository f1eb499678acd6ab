"""DuckDB oracle SQL for the registered queries.

Each string runs on the driver's tables registered as views. The oracle derives its inputs
straight from the base tables (for example planner facts come from the order statistics, not from
the cell round trip), so it checks the Spark shaping independently. Double outputs are rounded
exactly as ``queries.finish`` does.
"""

from __future__ import annotations

from staffwise.constants import (BAND_HIGH, BAND_LOW, CHANGE_STEPS, DAYS_PER_WEEK, OCC_ASSUMPTION_POINT_STEPS,
                                 PERCENT_STEPS_15, PRODUCTIVE_MINUTES_PER_WEEK, SL_Q2_OFFSETS, STAFFING_UPLIFT, YEAR_WEIGHTS)
from staffwise.functions.mathx import DIGITS, stable_sql
from staffwise.operators.forest import MEASURES
from staffwise.operators.lookalike import ABSOLUTE_STEPS
from staffwise.plans.pipelines import REFERENCE_YEAR, WEEK_START

ORACLE: dict[str, str] = {}


def R(expr: str, d: int = DIGITS) -> str:
    return stable_sql(expr, d)


def final(select_body: str, doubles: list[str], others: list[str]) -> str:
    """Wrap a query: round the listed double columns, pass the others."""
    cols = ", ".join([*others, *[f"{R(c)} AS {c}" for c in doubles]])
    return f"SELECT {cols} FROM ({select_body}) q"


MPP = f"(CAST({PRODUCTIVE_MINUTES_PER_WEEK} AS DOUBLE) / {DAYS_PER_WEEK})"


def D(expr: str, bits: int = 8) -> str:
    """Export precision 2^-bits, as adapters.dyadic."""
    k = f"{float(1 << bits):.1f}"
    return f"(ROUND(CAST({expr} AS DOUBLE) * {k}) / {k})"

BASE = f"""
geo AS (SELECT n_nationkey, r_name AS language,
               CASE WHEN n_nationkey % 2 = 0 THEN 'USD' ELSE 'Global' END AS usd
        FROM nation JOIN region ON n_regionkey = r_regionkey),
ok AS (SELECT o_orderkey, o_orderdate, o_totalprice, g.language, g.usd,
              CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'L3'
                   WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'L4' ELSE 'L5' END AS level
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo g ON c_nationkey = g.n_nationkey),
lf AS (SELECT CAST(l_shipdate AS DATE) AS date, language, usd, level, l_quantity, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus
       FROM lineitem JOIN ok ON l_orderkey = o_orderkey),
calls_g AS (SELECT date, language, COALESCE(lf.usd, 'Combined') AS usd, COALESCE(lf.level, 'Combined') AS level,
                   CASE WHEN l_linestatus = 'F' THEN 'OPI' ELSE 'VIDEO' END AS req_media,
                   SUM(l_quantity) AS calls,
                   CAST(SUM(CAST(ROUND(l_extendedprice * 100.0) AS BIGINT)) AS DOUBLE) AS ext,
                   CAST(SUM(CAST(ROUND(l_discount * 100.0) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS DOUBLE) AS disc,
                   SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE CAST(0.0 AS DOUBLE) END) AS ret,
                   CAST(SUM(CASE WHEN l_tax <= 0.06 THEN 1 ELSE 0 END) AS DOUBLE) AS okn,
                   CAST(COUNT(*) AS DOUBLE) AS n
            FROM lf GROUP BY 1, 2, 5, CUBE (lf.usd, lf.level)),
calls AS (SELECT date, language, usd, req_media, level, ret / 8.0 AS abns, calls,
                 {D('4.0 * disc / calls')} AS q2, {D('ext / calls / 10000.0')} AS aht,
                 {D('12.5 * ret / calls')} AS abn_pct, {D('okn / n', 12)} AS met,
                 1.0 - {D('okn / n', 12)} AS missed
          FROM calls_g),
fte AS (SELECT date, language, usd, level AS level_ix,
               CASE l_returnflag WHEN 'A' THEN 'OPI' WHEN 'N' THEN 'Hybrid' WHEN 'R' THEN 'VIDEO' END AS req_media,
               SUM(l_quantity) / 8.0 AS weekly_ftes
        FROM lf GROUP BY 1, 2, 3, 4, 5),
fte_pivot AS (SELECT date, usd, language, level_ix,
                     COALESCE(SUM(CASE WHEN req_media = 'Hybrid' THEN weekly_ftes END), 0) AS "Hybrid",
                     COALESCE(SUM(CASE WHEN req_media = 'OPI' THEN weekly_ftes END), 0) AS "OPI",
                     COALESCE(SUM(CASE WHEN req_media = 'VIDEO' THEN weekly_ftes END), 0) AS "VIDEO"
              FROM fte GROUP BY 1, 2, 3, 4),
shares AS (SELECT r_name AS language, (8 + 2 * r_regionkey) / 64.0 AS l4, (16 + 2 * r_regionkey) / 64.0 AS l5
           FROM region),
fte_split AS (SELECT p.*, CASE WHEN level_ix = 'L4' THEN COALESCE(s.l4, 0.0)
                               WHEN level_ix = 'L5' THEN COALESCE(s.l5, 0.0) ELSE 0.0 END AS pct
              FROM fte_pivot p LEFT JOIN shares s ON p.language = s.language),
fte_tot AS (SELECT date, language, usd, level_ix AS level,
                   "OPI" + ("Hybrid" - "Hybrid" * pct) AS total_opi, "VIDEO" + "Hybrid" * pct AS total_vri
            FROM fte_split),
fte_tot_shared AS (SELECT date, language, usd, level_ix AS level,
                   "OPI" + "Hybrid" * pct AS total_opi, "VIDEO" + "Hybrid" * pct AS total_vri
            FROM fte_split),
inbox AS (SELECT * FROM fte_tot WHERE usd IN ('USD', 'Global') AND level IN ('L3', 'L4', 'L5')),
spine AS (SELECT * FROM (VALUES ('Combined', 'L3'), ('Combined', 'L4'), ('Combined', 'L5'),
                                ('USD', 'Combined'), ('Global', 'Combined'), ('Combined', 'Combined')) v(usd, level)),
days AS (SELECT DISTINCT date, language FROM inbox),
comb_vals AS (
    SELECT date, language, 'Combined' AS usd, level, SUM(total_opi) AS opi,
           SUM(CASE WHEN level <> 'L3' THEN total_vri END) AS vri FROM inbox GROUP BY 1, 2, 4
    UNION ALL
    SELECT date, language, usd, 'Combined', SUM(total_opi), SUM(CASE WHEN level <> 'L3' THEN total_vri END)
    FROM inbox GROUP BY 1, 2, 3
    UNION ALL
    SELECT date, language, 'Combined', 'Combined', SUM(total_opi), SUM(CASE WHEN level <> 'L3' THEN total_vri END)
    FROM inbox GROUP BY 1, 2),
fte_comb AS (
    SELECT date, language, usd, level, total_opi, total_vri FROM fte_tot
    UNION ALL
    SELECT d.date, d.language, s.usd, s.level, COALESCE(v.opi, 0.0),
           CASE WHEN s.usd = 'Combined' AND s.level = 'L3' THEN NULL ELSE COALESCE(v.vri, 0.0) END
    FROM days d CROSS JOIN spine s
    LEFT JOIN comb_vals v ON v.date = d.date AND v.language = d.language AND v.usd = s.usd AND v.level = s.level),
pfr AS (SELECT language, o_orderdate::DATE - CAST(dayofweek(o_orderdate::DATE) AS INTEGER) AS week, usd, level,
               COUNT(*) AS cnt FROM ok GROUP BY 1, 2, 3, 4),
occ_w AS (SELECT language, week, usd, level, (176 + cnt % 32) / 256.0 AS occ_assumption FROM pfr),
occ_comb AS (
    SELECT language, week, usd, level, occ_assumption FROM occ_w
    UNION ALL
    SELECT language, week, 'Combined', level, AVG(occ_assumption) FROM occ_w
    WHERE level IN ('L4', 'L5') GROUP BY 1, 2, 4
    UNION ALL
    SELECT language, week, usd, 'Combined', AVG(occ_assumption) FROM occ_w GROUP BY 1, 2, 3
    UNION ALL
    SELECT language, week, 'Combined', 'Combined', AVG(m) FROM
        (SELECT language, week, usd, AVG(occ_assumption) AS m FROM occ_w GROUP BY 1, 2, 3) GROUP BY 1, 2),
assump AS (SELECT language, CAST(week + CAST(i AS INTEGER) AS DATE) AS date, usd, level, occ_assumption
           FROM occ_comb CROSS JOIN range(7) t(i)),
occ_g AS (SELECT date, language, COALESCE(lf.usd, 'Combined') AS usd, COALESCE(lf.level, 'Combined') AS level, CASE WHEN l_linestatus = 'F' THEN 'OPI' ELSE 'VIDEO' END AS req_media,
                 {D('0.6 + 0.03 * CAST(SUM(CAST(ROUND(l_tax * 100.0) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / SUM(l_quantity)', 12)} AS occ
          FROM lf GROUP BY 1, 2, 5, CUBE (lf.usd, lf.level)),
dm_j AS (SELECT c.*, f.total_opi, f.total_vri, a.occ_assumption, o.occ
         FROM calls c
         LEFT JOIN fte_comb f ON c.date = f.date AND c.usd = f.usd AND c.language = f.language AND c.level = f.level
         JOIN assump a ON c.date = a.date AND c.level = a.level AND c.usd = a.usd AND c.language = a.language
         JOIN occ_g o ON c.date = o.date AND c.language = o.language AND c.usd = o.usd AND c.level = o.level
                     AND c.req_media = o.req_media),
dm_i AS (SELECT * REPLACE (COALESCE(occ_assumption, AVG(occ_assumption) OVER (PARTITION BY language)) AS occ_assumption,
                           COALESCE(occ, AVG(occ) OVER (PARTITION BY language)) AS occ)
         FROM dm_j),
dm_all AS (SELECT date, language, usd, req_media, level, abns, calls, q2, aht, abn_pct, met, missed,
                  calls * aht AS demand, occ_assumption,
                  calls * aht / NULLIF({MPP} * occ_assumption, 0) AS requirement,
                  total_opi AS staffing, occ AS occupancy_rate,
                  total_opi - LAG(total_opi) OVER (PARTITION BY language, usd, req_media, level ORDER BY date)
                      AS staffing_diff
           FROM dm_i),
datamart AS MATERIALIZED (SELECT * FROM dm_all WHERE req_media = 'OPI'),
hist AS (SELECT language, req_media, usd, level, date, year(date) AS year, demand,
                staffing * {STAFFING_UPLIFT} AS staffing, staffing AS staffing_raw, calls, q2, occupancy_rate, abn_pct,
                met AS service_level, occ_assumption FROM datamart)
"""

DM_DOUBLES = ["abns", "calls", "q2", "aht", "abn_pct", "met", "missed", "demand", "occ_assumption", "requirement",
              "staffing", "occupancy_rate", "staffing_diff"]
KEYS = "language, req_media, usd, level"
KPIS = ["q2", "occupancy_rate", "abn_pct", "service_level"]


def cw(k: str) -> str:
    return f"CASE WHEN SUM(calls) > 0 THEN SUM({k} * calls) / SUM(calls) ELSE AVG({k}) END"


def with_base(body: str) -> str:
    return f"WITH {BASE}, q AS ({body}) SELECT * FROM q"


ORACLE["fte_pivot"] = "WITH " + BASE + ", x AS (SELECT 1) " + final(
    "SELECT * FROM fte_pivot", ["Hybrid", "OPI", "VIDEO"], ["date", "usd", "language", "level_ix"])
ORACLE["hybrid_split"] = "WITH " + BASE + " " + final(
    "SELECT * FROM fte_tot", ["total_opi", "total_vri"], ["date", "language", "usd", "level"])
ORACLE["hybrid_split_shared"] = "WITH " + BASE + " " + final(
    "SELECT * FROM fte_tot_shared", ["total_opi", "total_vri"], ["date", "language", "usd", "level"])
ORACLE["fte_combined"] = "WITH " + BASE + " " + final(
    "SELECT * FROM fte_comb", ["total_opi", "total_vri"], ["date", "language", "usd", "level"])
ORACLE["datamart_day"] = "WITH " + BASE + " " + final(
    "SELECT * FROM datamart", DM_DOUBLES, ["date", "language", "usd", "req_media", "level"])

VIDEO = BASE
for _opi, _video in [("total_opi - LAG(total_opi)", "total_vri - LAG(total_vri)"), ("total_opi AS staffing", "total_vri AS staffing"),
                     ("FROM dm_all WHERE req_media = 'OPI'", "FROM dm_all WHERE req_media = 'VIDEO'")]:
    assert VIDEO.count(_opi) == 1
    VIDEO = VIDEO.replace(_opi, _video)
ORACLE["weekly_kpi"] = "WITH " + BASE + " " + final(f"""
    SELECT {KEYS}, CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE) AS week,
           COALESCE(SUM(demand), 0.0) AS weekly_demand, COALESCE(SUM(demand), 0.0) / {float(DAYS_PER_WEEK)} AS daily_demand,
           {", ".join(f"{cw(k)} AS {k}" for k in KPIS)},
           AVG(staffing_raw) * {STAFFING_UPLIFT} AS staffing, MAX(staffing) AS max_staffing,
           COALESCE(SUM(demand), 0.0) / NULLIF({float(PRODUCTIVE_MINUTES_PER_WEEK)} * AVG(occ_assumption), 0)
               AS fte_requirement,
           COUNT(DISTINCT date) AS days_present
    FROM hist GROUP BY ALL""",
    ["weekly_demand", "daily_demand", *KPIS, "staffing", "max_staffing", "fte_requirement"],
    ["language", "req_media", "usd", "level", "week", "days_present"])


def _grid(mode: str) -> str:
    signed = sorted({s * d for s in CHANGE_STEPS for d in (1, -1)})
    if mode == "demand":
        rows = [(d, 0) for d in signed]
    elif mode == "staffing":
        rows = [(0, s) for s in signed]
    elif mode == "double":
        rows = [(d, s) for d in signed for s in signed]
    elif mode == "absolute":
        rows = [(10, s) for s in ABSOLUTE_STEPS]
    else:
        rows = [(10, 5)]
    vals = ", ".join(f"({float(d)}, {float(s)})" for d, s in rows)
    return f"SELECT CAST(dc AS DOUBLE) AS demand_change, CAST(sc AS DOUBLE) AS staffing_change FROM (VALUES {vals}) v(dc, sc)"


def scenario_sql(mode: str, how: str) -> str:
    ws = f"DATE '{WEEK_START}'"
    ry = REFERENCE_YEAR
    if how == "weighted":
        def wmean(k):
            num, den = "CAST(0.0 AS DOUBLE)", "CAST(0.0 AS DOUBLE)"
            for back, wt in sorted(YEAR_WEIGHTS.items()):
                y = ry - back
                num = f"({num} + CAST({wt} AS DOUBLE) * COALESCE(SUM(CASE WHEN h.year = {y} THEN h.{k} END), 0.0))"
                den = f"({den} + CAST({wt} AS DOUBLE) * CAST(COUNT(CASE WHEN h.year = {y} THEN 1 END) AS DOUBLE))"
            return f"{num} / NULLIF({den}, 0)"
        aggs = ", ".join(f"{wmean(k)} AS m_{k}" for k in KPIS)
    elif how == "unweighted":
        aggs = ", ".join(f"AVG(h.{k}) AS m_{k}" for k in KPIS)
    else:
        aggs = ", ".join(
            f"CASE WHEN SUM(h.calls) > 0 THEN SUM(h.{k} * h.calls) / SUM(h.calls) ELSE AVG(h.{k}) END AS m_{k}"
            for k in KPIS)
    body = f"""
    base AS (SELECT {KEYS}, COALESCE(SUM(demand), 0.0) AS weekly_demand,
                    COALESCE(SUM(demand), 0.0) / {float(DAYS_PER_WEEK)} AS daily_demand,
                    {", ".join(f"{cw(k)} AS {k}" for k in KPIS)}, AVG(staffing_raw) * {STAFFING_UPLIFT} AS staffing,
                    COALESCE(SUM(demand), 0.0) / NULLIF({float(PRODUCTIVE_MINUTES_PER_WEEK)} * AVG(occ_assumption), 0)
                        AS fte_requirement
             FROM hist WHERE date BETWEEN {ws} AND {ws} + 6 GROUP BY ALL),
    grid AS ({_grid(mode)}),
    gridall AS (SELECT demand_change, staffing_change, MAX(req) AS requested FROM (
                 SELECT *, TRUE AS req FROM grid UNION ALL SELECT 0.0, 0.0, FALSE) GROUP BY 1, 2),
    tgt AS (SELECT b.*, g.demand_change, g.staffing_change, g.requested,
                   b.daily_demand * (1.0 + g.demand_change / 100.0) AS new_demand,
                   {"CASE WHEN b.staffing + g.staffing_change < 0 THEN 0.0 ELSE b.staffing + g.staffing_change END"
                    if mode == "absolute" else "b.staffing * (1.0 + g.staffing_change / 100.0)"} AS new_staffing
            FROM base b CROSS JOIN gridall g),
    st AS (SELECT t.language, t.req_media, t.usd, t.level, t.demand_change, t.staffing_change,
                  COUNT(h.demand) AS n_matches, {aggs}
           FROM tgt t LEFT JOIN hist h
             ON h.language = t.language AND h.req_media = t.req_media AND h.usd = t.usd AND h.level = t.level
            AND h.demand BETWEEN {BAND_LOW} * t.new_demand AND {BAND_HIGH} * t.new_demand
            AND h.staffing BETWEEN {BAND_LOW} * t.new_staffing AND {BAND_HIGH} * t.new_staffing
           GROUP BY ALL),
    o AS (SELECT {KEYS}, {", ".join(f"m_{k} AS o_{k}" for k in KPIS)} FROM st
          WHERE demand_change = 0 AND staffing_change = 0),
    x AS (SELECT t.*, st.n_matches, {", ".join(f"st.m_{k}" for k in KPIS)},
                 {", ".join(f"o.o_{k}" for k in KPIS)}
          FROM tgt t JOIN st USING (language, req_media, usd, level, demand_change, staffing_change)
          LEFT JOIN o USING (language, req_media, usd, level))"""
    if how == "weighted":
        d = {k: f"(m_{k} - o_{k}) / NULLIF(o_{k}, 0)" for k in KPIS}

        def capped(e, hi):
            return f"CASE WHEN ({e}) IS NULL OR isnan({e}) THEN NULL ELSE LEAST({e}, {hi}) END"
        new = {"q2": f"q2 * (1 + {d['q2']})",
               "occupancy_rate": capped(f"occupancy_rate * (1 + {d['occupancy_rate']})", 1.0),
               "abn_pct": capped(f"abn_pct * (1 + {d['abn_pct']})", 100.0),
               "service_level": capped(f"service_level * (1 + {d['service_level']})", 1.0)}
    elif how == "unweighted":
        def sd(k):
            return f"CASE WHEN o_{k} IS NOT NULL AND o_{k} <> 0 THEN (m_{k} - o_{k}) / o_{k} ELSE 0.0 END"
        new = {k: f"{k} * (1 + {sd(k)})" for k in KPIS[:3]}
        new["service_level"] = "service_level"
    else:
        new = {k: f"m_{k}" for k in KPIS}
    kcols = ", ".join(f"{k}, {new[k]} AS new_{k}" for k in KPIS)
    sel = f"""SELECT {KEYS}, demand_change, staffing_change, fte_requirement, weekly_demand, daily_demand,
                     new_demand, staffing, new_staffing, {kcols}, n_matches,
                     CASE WHEN n_matches < 5 THEN 'Low' WHEN n_matches <= 10 THEN 'Moderate' ELSE 'High' END
                         AS reliability,
                     new_demand > 0 AS valid
              FROM x WHERE requested"""
    doubles = ["demand_change", "staffing_change", "fte_requirement", "weekly_demand", "daily_demand", "new_demand",
               "staffing", "new_staffing", *[c for k in KPIS for c in (k, f"new_{k}")]]
    return "WITH " + BASE + ", " + body + " " + final(
        sel, doubles, ["language", "req_media", "usd", "level", "n_matches", "reliability", "valid"])


ORACLE["lookalike_weighted"] = scenario_sql("single", "weighted")
ORACLE["lookalike_unweighted"] = scenario_sql("single", "unweighted")
ORACLE["lookalike_direct"] = scenario_sql("single", "direct")
ORACLE["lookalike_absolute"] = scenario_sql("absolute", "weighted")
ORACLE["scenario_demand"] = scenario_sql("demand", "weighted")
ORACLE["scenario_staffing"] = scenario_sql("staffing", "weighted")
ORACLE["scenario_double"] = scenario_sql("double", "weighted")


# --- planner --------------------------------------------------------------------------------------------

#: What a planner cell holds, by family, from a week's number of orders and cents.
CELL = {
    "Volume (ACTUAL)": "CAST(cnt AS DOUBLE)", "OCC Assumptions": "(176 + cnt % 32) / 256.0",
    "AHT (ACTUAL)": "floor(cents / cnt / 78.125) / 128.0", "Occupancy Rate": "(150 + cnt % 64) / 256.0",
    "Q4 Time": "CAST(cnt % 40 AS DOUBLE) + 0.5", "Staffing Requirement (ACTUAL)": "CAST(cnt * 3 AS DOUBLE)",
    "Staffing (ACTUAL/FORECASTED)": "CAST(cnt * 3 + cnt % 11 AS DOUBLE)", "STAFFING DIFFERENTIAL": "CAST(cnt % 11 - 5 AS DOUBLE)",
    "Q2 Time": "CAST(cnt % 25 AS DOUBLE) + 0.25", "Staffing Requirement (ADJUSTED FORECAST)": "CAST(cnt * 3 + 2 AS DOUBLE)",
    "Staffing Requirement Adjustment": "CAST(cnt % 7 - 3 AS DOUBLE)", "Staffing Requirement (ORIGINAL FORECAST)": "CAST(cnt * 2 + 1 AS DOUBLE)",
    "Staffing Requirement (Variance)": "CAST(cnt % 5 - 2 AS DOUBLE)"}


def sheet_facts(source: str, workbook: str, sheet: str, families, metric, usd, level) -> str:
    """Facts of one sheet: ``metric``, ``usd`` and ``level`` give SQL text for a family."""
    return " UNION ALL ".join(
        f"SELECT {workbook} AS workbook, '{sheet}' AS sheet, CAST(week AS DATE) AS week, {metric(f)} AS metric, '{f}' AS family, "
        f"{usd(f)} AS usd, {level(f)} AS level, {CELL[f]} AS value FROM {source}" for f in families)


def _opi_metric(f):
    return "usd || ' OCC Assumptions (' || level || '):'" if f == "OCC Assumptions" else f"usd || ' ' || level || ' {f}'"


def _video_metric(f):
    return "'OCC Assumptions (' || level || '):'" if f == "OCC Assumptions" else f"'Combined ' || level || ' {f}'"


def _site_metric(f):
    if f == "OCC Assumptions":
        return "'OCC Assumptions (' || site || '):'"
    return f"site || ' ' || site || ' {f}'" if f in ("Occupancy Rate", "Q4 Time") else f"'Combined ' || site || ' {f}'"


PLANNER = f"""
pweek AS (SELECT language, o_orderdate::DATE - CAST(dayofweek(o_orderdate::DATE) AS INTEGER) AS week, usd, level,
                 o_totalprice FROM ok),
pfr2 AS (SELECT language, week, usd, level, COUNT(*) AS cnt,
                SUM(CAST(ROUND(o_totalprice * 100.0) AS BIGINT)) AS cents FROM pweek GROUP BY 1, 2, 3, 4),
pf AS ({sheet_facts('pfr2', 'language', '1. Weekly Planner OPI', CELL, _opi_metric, lambda f: 'usd', lambda f: 'level')}),
pocc AS (SELECT workbook, sheet, week, usd, level, value AS occ_assumption FROM pf WHERE family = 'OCC Assumptions'),
pocc_comb AS (
    SELECT workbook, sheet, week, usd, level, occ_assumption FROM pocc
    UNION ALL SELECT workbook, sheet, week, 'Combined', level, AVG(occ_assumption) FROM pocc
    WHERE level IN ('L4', 'L5') GROUP BY 1, 2, 3, 5
    UNION ALL SELECT workbook, sheet, week, usd, 'Combined', AVG(occ_assumption) FROM pocc GROUP BY 1, 2, 3, 4
    UNION ALL SELECT workbook, sheet, week, 'Combined', 'Combined', AVG(m) FROM
        (SELECT workbook, sheet, week, usd, AVG(occ_assumption) AS m FROM pocc GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
"""
_SITE_FAMILIES = ["Volume (ACTUAL)", "AHT (ACTUAL)", "OCC Assumptions", "Occupancy Rate", "Q4 Time"]
WORKBOOKS = f"""
pvid AS (SELECT language, week, level, SUM(cnt) AS cnt, SUM(cents) AS cents FROM pfr2 WHERE level IN ('L4', 'L5') GROUP BY 1, 2, 3),
psite AS (SELECT g.language, o_orderdate::DATE - CAST(dayofweek(o_orderdate::DATE) AS INTEGER) AS week,
                 CASE WHEN o_custkey % 2 = 0 THEN 'OLY' ELSE 'BOA' END AS site, COUNT(*) AS cnt,
                 SUM(CAST(ROUND(o_totalprice * 100.0) AS BIGINT)) AS cents
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo g ON c_nationkey = g.n_nationkey GROUP BY 1, 2, 3),
vf AS ({sheet_facts('pvid', 'language', '2. Weekly Planner VRI', CELL, _video_metric,
                    lambda f: "CAST(NULL AS VARCHAR)" if f == "OCC Assumptions" else "'Combined'", lambda f: 'level')}),
csf AS ({sheet_facts('psite', "'csa ' || language", '1. Weekly Planner OPI', _SITE_FAMILIES, _site_metric,
                     lambda f: "'Combined'" if f in ("Volume (ACTUAL)", "AHT (ACTUAL)") else "CAST(NULL AS VARCHAR)",
                     lambda f: 'CAST(NULL AS VARCHAR)')}),
wf AS (SELECT * FROM pf UNION ALL SELECT * FROM vf UNION ALL SELECT * FROM csf),
vocc AS (SELECT workbook, sheet, week, 'Combined' AS usd, level, value AS occ_assumption FROM vf WHERE family = 'OCC Assumptions'),
vocc_comb AS (SELECT * FROM vocc UNION ALL SELECT workbook, sheet, week, 'Combined', 'Combined', AVG(occ_assumption) FROM vocc GROUP BY 1, 2, 3)
"""
PW = "workbook, sheet, week"


def planner_q(body: str, doubles: list[str], others: list[str], more: str = "") -> str:
    return "WITH " + BASE + ", " + PLANNER + more + " " + final(body, doubles, others)


ORACLE["planner_cells"] = planner_q("SELECT * FROM pf", ["value"],
                                    ["workbook", "sheet", "week", "metric", "family", "usd", "level"])
ORACLE["planner_select"] = planner_q("SELECT * FROM pf WHERE usd = 'Global' AND level = 'L4'", ["value"],
                                     ["workbook", "sheet", "week", "metric", "family", "usd", "level"])
ORACLE["planner_levels"] = planner_q(
    "SELECT DISTINCT workbook, sheet, usd, level FROM pf WHERE family = 'Staffing Requirement (ACTUAL)'", [],
    ["workbook", "sheet", "usd", "level"])
ORACLE["occ_mean"] = planner_q("SELECT * FROM pocc_comb", ["occ_assumption"], [PW, "usd", "level"])
ORACLE["occ_volume"] = planner_q(f"""
    SELECT {PW}, COALESCE(usd, 'Combined') AS usd,
           SUM(COALESCE(o.value, 0.0) * COALESCE(v.value, 0.0)) / NULLIF(SUM(COALESCE(v.value, 0.0)), 0) AS occ_assumption
    FROM (SELECT * FROM pf WHERE family = 'OCC Assumptions') o
    FULL JOIN (SELECT * FROM pf WHERE family = 'Volume (ACTUAL)') v USING (workbook, sheet, week, usd, level)
    WHERE level IN ('L3', 'L4', 'L5')
    GROUP BY GROUPING SETS (({PW}, usd), ({PW}))""", ["occ_assumption"], [PW, "usd"])
ORACLE["weekly_to_daily"] = planner_q("""
    SELECT workbook AS language, usd, level, occ_assumption, CAST(week + CAST(i AS INTEGER) AS DATE) AS date
    FROM pocc_comb CROSS JOIN range(7) t(i)""", ["occ_assumption"], ["language", "usd", "level", "date"])
ORACLE["weekly_to_hourly"] = planner_q("""
    SELECT workbook AS language, usd, level, occ_assumption,
           CAST(week AS TIMESTAMP) + to_hours(CAST(i AS BIGINT)) AS ts
    FROM pocc_comb CROSS JOIN range(168) t(i)""", ["occ_assumption"], ["language", "usd", "level", "ts"])
ORACLE["occ_unpivot"] = planner_q(f"""
    SELECT w.workbook, w.sheet, w.week, l.level, l.usd, l.usd || ' OCC Assumptions (' || l.level || '):' AS label,
           o.occ_assumption
    FROM (SELECT DISTINCT {PW} FROM pocc) w
    CROSS JOIN (SELECT * FROM (VALUES ('USD', 'L3'), ('USD', 'L4'), ('USD', 'L5'), ('Global', 'L3'), ('Global', 'L4'),
                                      ('Global', 'L5')) v(usd, level)) l
    LEFT JOIN pocc o ON o.workbook = w.workbook AND o.sheet = w.sheet AND o.week = w.week AND o.usd = l.usd
                    AND o.level = l.level""", ["occ_assumption"], [PW, "level", "usd", "label"])
ORACLE["label_split"] = planner_q(r"""
    SELECT metric,
           CASE WHEN regexp_matches(metric, '\([^)]*\)')
                     AND regexp_matches(regexp_extract(metric, '\(([^)]*)\)', 1), 'L3|L4|L5|Combined')
                THEN regexp_extract(metric, '\(([^)]*)\)', 1) END AS level_in_parens,
           CASE WHEN regexp_matches(metric, '\([^)]*\)') THEN
                CASE WHEN contains(metric, 'USD') THEN 'USD' WHEN contains(metric, 'Global') THEN 'Global'
                     WHEN contains(metric, 'Combined') THEN 'Combined' END END AS category
    FROM (SELECT DISTINCT metric FROM pf)""", [], ["metric", "level_in_parens", "category"])
FACT_COLS = ["workbook", "sheet", "week", "metric", "family", "usd", "level"]
ORACLE["planner_workbooks"] = planner_q("SELECT * FROM wf", ["value"], FACT_COLS, "," + WORKBOOKS)
ORACLE["planner_media"] = planner_q("""
    SELECT DISTINCT workbook, sheet, trim(substr(sheet, position('Weekly Planner' IN sheet) + 14)) AS kind,
           CASE WHEN contains(sheet, 'OPI') THEN 'OPI' ELSE 'VIDEO' END AS media FROM wf""", [],
    ["workbook", "sheet", "kind", "media"], "," + WORKBOOKS)
ORACLE["occ_video"] = planner_q("SELECT * FROM vocc_comb", ["occ_assumption"], [PW, "usd", "level"], "," + WORKBOOKS)
# the planner's statistics stand before the datamart here, whose assumptions are those of the video sheet
_own = "assump AS (SELECT language, CAST(week + CAST(i AS INTEGER) AS DATE) AS date, usd, level, occ_assumption\n           FROM occ_comb"
assert VIDEO.count(_own) == 1
ORACLE["datamart_day_video"] = "WITH " + VIDEO.replace(
    _own, (PLANNER + "," + WORKBOOKS).strip() + "," + _own.replace("SELECT language,", "SELECT workbook AS language,").replace("FROM occ_comb", "FROM vocc_comb")) \
    + " " + final("SELECT * FROM datamart", DM_DOUBLES, ["date", "language", "usd", "req_media", "level"])
GS = f"GROUPING SETS (({PW}, usd, level), ({PW}, usd), ({PW}, level), ({PW}))"
ORACLE["rollup_volume"] = planner_q(f"""
    SELECT {PW}, COALESCE(usd, 'Combined') AS usd, COALESCE(level, 'Combined') AS level, SUM(value) AS volume,
           COUNT(CASE WHEN value IS NULL THEN 1 END) AS n_missing
    FROM pf WHERE family = 'Volume (ACTUAL)' GROUP BY {GS}""", ["volume"], [PW, "usd", "level", "n_missing"])


def _weighted(fam: str) -> str:
    return f"""
    SELECT {PW}, COALESCE(usd, 'Combined') AS usd, COALESCE(level, 'Combined') AS level,
           SUM(x.value * v.value) / NULLIF(SUM(CASE WHEN x.value IS NOT NULL THEN v.value END), 0) AS weighted,
           SUM(v.value) AS volume, '{fam}' AS family
    FROM (SELECT * FROM pf WHERE family = '{fam}') x
    JOIN (SELECT * FROM pf WHERE family = 'Volume (ACTUAL)') v USING (workbook, sheet, week, usd, level)
    GROUP BY {GS}"""


ORACLE["rollup_weighted"] = planner_q(_weighted("AHT (ACTUAL)") + " UNION ALL " + _weighted("OCC Assumptions"),
                                      ["weighted", "volume"], [PW, "usd", "level", "family"])
ORACLE["rollup_staffing"] = planner_q(f"""
    SELECT {PW}, level, family, SUM(value) AS value, 'Combined' AS usd FROM pf
    WHERE family IN ('Staffing Requirement (ADJUSTED FORECAST)', 'Staffing Requirement Adjustment',
                     'Staffing Requirement (ORIGINAL FORECAST)', 'Staffing Requirement (ACTUAL)',
                     'Staffing Requirement (Variance)', 'Staffing (ACTUAL/FORECASTED)')
    GROUP BY ALL""", ["value"], [PW, "level", "family", "usd"])
_SITED = f"""
sited AS (SELECT *, CASE WHEN contains(metric, 'OLY') THEN 'OLY' WHEN contains(metric, 'BOA') THEN 'BOA' END AS site FROM csf),
rsite AS (SELECT {PW}, x.family, COALESCE(site, 'Combined') AS site,
                 SUM(x.value * v.volume) / NULLIF(SUM(CASE WHEN x.value IS NOT NULL THEN v.volume END), 0) AS weighted,
                 SUM(v.volume) AS volume, COUNT(*) AS n_sites
          FROM (SELECT * FROM sited WHERE family IN ('AHT (ACTUAL)', 'OCC Assumptions', 'Occupancy Rate', 'Q4 Time')) x
          JOIN (SELECT {PW}, site, value AS volume FROM sited WHERE family = 'Volume (ACTUAL)') v USING ({PW}, site)
          GROUP BY GROUPING SETS (({PW}, x.family, site), ({PW}, x.family)))"""
ORACLE["rollup_site"] = planner_q("SELECT * FROM rsite", ["weighted", "volume"], [PW, "family", "site", "n_sites"],
                                  "," + WORKBOOKS + "," + _SITED)
_name = "CASE WHEN family = 'OCC Assumptions' THEN usd || ' OCC Assumptions (' || level || '):' ELSE usd || ' ' || level || ' ' || family END"
_ALL = f"""
alls AS (SELECT {", ".join(FACT_COLS)}, value FROM wf
  UNION ALL SELECT {PW}, {_name}, family, usd, level, value FROM (
    SELECT {PW}, 'Volume (ACTUAL)' AS family, COALESCE(usd, 'Combined') AS usd, COALESCE(level, 'Combined') AS level, SUM(value) AS value
    FROM pf WHERE family = 'Volume (ACTUAL)' GROUP BY {GS}
    UNION ALL SELECT {PW}, family, usd, level, weighted FROM ({_weighted('AHT (ACTUAL)')})
    UNION ALL SELECT {PW}, family, usd, level, weighted FROM ({_weighted('OCC Assumptions')})
    UNION ALL SELECT {PW}, family, 'Combined', level, SUM(value) FROM pf
    WHERE family LIKE 'Staffing Requirement%' OR family = 'Staffing (ACTUAL/FORECASTED)' GROUP BY ALL)
  WHERE usd = 'Combined' OR level = 'Combined'
  UNION ALL SELECT {PW}, 'Combined Combined ' || CASE WHEN family = 'OCC Assumptions' THEN 'OCC Assumptions:' ELSE family END, family,
    'Combined', 'Combined', weighted FROM rsite WHERE site = 'Combined')"""


def _chosen(choice: str) -> str:
    a, _, b = choice.partition(" ")
    has = "contains(metric, '{}')".format
    twice = f"length(metric) - length(replace(metric, '{a}', '')) >= {2 * len(a)}"
    if not b:
        site, video, rest = has("Combined Combined" if a == "Combined" else a), "FALSE", "FALSE"
    else:
        site, video, rest = (has(choice) if a == b else "FALSE"), has(b), (twice if a == b else f"{has(a)} AND {has(b)}")
    return (f"SELECT *, '{choice}' AS choice FROM alls WHERE CASE WHEN workbook LIKE 'csa%' THEN {site} "
            f"WHEN contains(sheet, 'VRI') THEN {video} ELSE {rest} END")


ORACLE["planner_choice"] = planner_q(" UNION ALL ".join(map(_chosen, ["Global L4", "Combined L5", "Combined Combined", "OLY", "Combined"])),
                                     ["value"], [*FACT_COLS, "choice"], "," + WORKBOOKS + "," + _SITED + "," + _ALL)


# --- cleaning, dates, text ---------------------------------------------------------------------------------

GKS = "language, req_media, usd, level"
CLEAN_CALLS = """
ccalls AS (SELECT date, language, usd, req_media, level, abns,
                  CASE WHEN k % 50 = 0 THEN NULL ELSE calls END AS calls, q2,
                  CASE WHEN (k + 7) % 50 = 0 THEN NULL ELSE aht END AS aht, abn_pct, met, missed
           FROM (SELECT *, date_diff('day', DATE '1992-01-01', date) + length(language) + length(usd) + length(level) AS k
                 FROM calls))
"""
CC_DOUBLES = ["abns", "calls", "q2", "aht", "abn_pct", "met", "missed"]
CC_OTHER = ["date", "language", "usd", "req_media", "level"]


def cc_q(body, doubles=CC_DOUBLES, others=CC_OTHER):
    return "WITH " + BASE + ", " + CLEAN_CALLS + " " + final(body, doubles, others)


ORACLE["clean_numeric"] = cc_q("SELECT * FROM ccalls")
ORACLE["impute_mean"] = cc_q("""SELECT * REPLACE (COALESCE(calls, AVG(calls) OVER ()) AS calls,
                                                 COALESCE(aht, AVG(aht) OVER ()) AS aht) FROM ccalls""")
_TEXT = """CASE date_diff('day', DATE '1992-01-01', date) % 4 WHEN 0 THEN strftime(date, '%d-%m-%Y')
         WHEN 1 THEN day(date) || '/' || month(date) || '/' || year(date) WHEN 2 THEN strftime(date, '%Y-%m-%d')
         ELSE day(date) || '.' || month(date) || '.' || year(date) END"""
ORACLE["coerce_numeric"] = cc_q(f"""
    SELECT {_TEXT} AS date_text, language, usd, req_media, level, abns, CASE WHEN calls < 1000 THEN calls END AS calls, q2, aht,
           CAST(NULL AS DOUBLE) AS abn_pct FROM ccalls""", ["abns", "calls", "q2", "aht", "abn_pct"],
    ["date_text", "language", "usd", "req_media", "level"])
ORACLE["fill_zero"] = cc_q("SELECT * REPLACE (COALESCE(calls, 0.0) AS calls, COALESCE(aht, 0.0) AS aht) FROM ccalls")
ORACLE["drop_incomplete"] = cc_q("SELECT * FROM ccalls WHERE calls IS NOT NULL AND aht IS NOT NULL")
ORACLE["clean_fte"] = "WITH " + BASE + " " + final("""
    SELECT date, language, CASE WHEN usd = 'USD' THEN 'USD' ELSE 'Global' END AS usd, level AS level_ix,
           CASE WHEN product = 'Video Dedicated' THEN 'VIDEO' ELSE product END AS req_media,
           CASE WHEN (date_diff('day', DATE '1992-01-01', date) + length(agent) + length(product)) % 50 = 0 THEN NULL
                ELSE weekly_ftes END AS weekly_ftes, level
    FROM (SELECT date, language, usd, level,
                 CASE level WHEN 'L3' THEN 'L3 - Core' WHEN 'L4' THEN 'L4 - MSI' WHEN 'L5' THEN 'L5 - All Call' END AS agent,
                 CASE l_returnflag WHEN 'A' THEN 'OPI' WHEN 'N' THEN 'Hybrid' WHEN 'R' THEN 'Video Dedicated' END AS product,
                 SUM(l_quantity) / 8.0 AS weekly_ftes
          FROM lf GROUP BY 1, 2, 3, 4, 5, 6)""", ["weekly_ftes"], ["date", "language", "usd", "level_ix", "req_media", "level"])
ORACLE["clean_occ"] = "WITH " + BASE + " " + final("SELECT * FROM occ_g", ["occ"],
                                                   ["date", "language", "usd", "level", "req_media"])
ORACLE["lenient_minute"] = """
SELECT event_id, ts_text,
       date_trunc('minute', COALESCE(try_strptime(ts_text, '%d-%m-%Y %H:%M'), try_strptime(ts_text, '%Y-%m-%d %H:%M'),
                                     try_strptime(ts_text, '%d/%m/%Y %H:%M'), try_strptime(ts_text, '%m/%d/%Y %H:%M')))
           AS minute
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%d-%m-%Y %H:%M') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M')
                                         WHEN 2 THEN strftime(ts, '%d/%m/%Y %H:%M') ELSE strftime(ts, '%m/%d/%Y %H:%M') END
                 AS ts_text FROM events)"""
ORACLE["sundays"] = "WITH " + BASE + f""" SELECT *, CAST(max_date - CAST(dayofweek(max_date) AS INTEGER) AS DATE) AS sunday_on_or_before,
       CAST((max_date - 1) - CAST(dayofweek(max_date - 1) AS INTEGER) AS DATE) AS sunday_before
FROM (SELECT {GKS}, MAX(CASE WHEN dayofweek(date) = 0 THEN date END) AS latest_sunday, MAX(date) AS max_date,
             MIN(date) AS min_date, COUNT(*) AS n_days FROM calls GROUP BY ALL)"""
ORACLE["week_of_year_sunday"] = "WITH " + BASE + """ SELECT date, CAST(strftime(date, '%U') AS INTEGER) AS week_of_year,
       CAST(year(date) AS INTEGER) AS year, strftime(date, '%Y-%m-%d') AS date_text FROM (SELECT DISTINCT date FROM calls)"""
ORACLE["day_spine"] = "WITH " + BASE + " " + final(f"""
    SELECT g.language, g.req_media, g.usd, g.level, CAST(DATE '{WEEK_START}' + CAST(i AS INTEGER) AS DATE) AS date,
           d.demand, d.requirement
    FROM (SELECT DISTINCT {GKS} FROM datamart) g CROSS JOIN range(7) t(i)
    LEFT JOIN (SELECT {GKS}, date, AVG(demand) AS demand, AVG(requirement) AS requirement FROM datamart GROUP BY ALL) d
      ON d.language = g.language AND d.req_media = g.req_media AND d.usd = g.usd AND d.level = g.level
     AND d.date = DATE '{WEEK_START}' + CAST(i AS INTEGER)""", ["demand", "requirement"],
    ["language", "req_media", "usd", "level", "date"])
ORACLE["language_match"] = "WITH " + BASE + """,
    hyb AS (SELECT r_name AS language, r_regionkey AS src_order, (8 + 2 * r_regionkey) / 64.0 AS l4,
                   (16 + 2 * r_regionkey) / 64.0 AS l5
            FROM (SELECT r_name, r_regionkey FROM region UNION ALL SELECT 'ASL', MAX(r_regionkey) + 1 FROM region)),
    codes AS (SELECT DISTINCT upper(substr(language, 1, 3)) AS code FROM (SELECT language FROM calls UNION ALL SELECT language FROM hyb)),
    m AS (SELECT code, arg_min(h.language, src_order) AS matched_language, arg_min(l4, src_order) AS l4_hybrid_pct,
                 arg_min(l5, src_order) AS l5_hybrid_pct
          FROM codes JOIN hyb h ON starts_with(upper(h.language), upper(trim(code))) GROUP BY code),
    c AS (SELECT code, COUNT(*) AS n_contains FROM codes JOIN hyb h ON contains(upper(h.language), upper(trim(code)))
          GROUP BY code)
    """ + final("""SELECT m.*, c.n_contains,
                   CASE WHEN matched_language = 'ASL' THEN 'AMERICAN SIGN LANGUAGE' ELSE matched_language END AS alias
                   FROM m LEFT JOIN c USING (code)""", ["l4_hybrid_pct", "l5_hybrid_pct"],
                ["code", "matched_language", "n_contains", "alias"])


# --- features, splits ----------------------------------------------------------------------------------------

def _ladder(col: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {col} >= {float(e)} THEN '{lab}'" for e, lab in reversed(list(zip(edges, labels))))
    return f"CASE WHEN {col} IS NULL OR isnan({col}) THEN NULL {parts} ELSE NULL END"


ABN_E = [0.0, 2.0, 4.0, 6.0, 8.0]
ABN_L = ["0-2%", "2-4%", "4-6%", "6-8%", "8%+"]
Q2_E = [0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50]
Q2_L = ["0-5", "5-10", "10-15", "15-20", "20-25", "25-30", "30-35", "35-40", "40-45", "45-50", "50+"]


def _ohname(prefix, lab):
    return prefix + "_" + lab.replace("%", "").replace("+", "_plus").replace("-", "_")


def dm_q(body, doubles, others):
    return "WITH " + BASE + " " + final(body, doubles, others)


ORACLE["bucket_abn_q2"] = dm_q(f"""SELECT {GKS}, date, abn_pct, q2, {_ladder('abn_pct', ABN_E, ABN_L)} AS abn_bucket,
                                   {_ladder('q2', Q2_E, Q2_L)} AS q2_bucket FROM datamart""",
                               ["abn_pct", "q2"], ["language", "req_media", "usd", "level", "date", "abn_bucket",
                                                   "q2_bucket"])
_oh = [(_ohname("abn", lab), "ab", lab) for lab in ABN_L[1:]] + [(_ohname("q2", lab), "qb", lab) for lab in Q2_L[1:]]
ORACLE["onehot"] = dm_q(f"""SELECT {GKS}, date,
        {", ".join(f"CAST(COALESCE({c} = '{lab}', FALSE) AS INTEGER) AS {n}" for n, c, lab in _oh)}
    FROM (SELECT *, {_ladder('abn_pct', ABN_E, ABN_L)} AS ab, {_ladder('q2', Q2_E, Q2_L)} AS qb FROM datamart)""",
    [], ["language", "req_media", "usd", "level", "date", *[n for n, _, _ in _oh]])
ORACLE["ratios"] = dm_q(f"""SELECT {GKS}, date,
        CASE WHEN staffing IS NOT NULL AND staffing <> 0 THEN calls / staffing ELSE 0.0 END AS calls_per_fte,
        CASE WHEN demand IS NULL OR staffing = 0 THEN 0.0 ELSE demand / staffing END AS demand_per_fte,
        abn_pct * demand AS abandon_demand FROM datamart""",
    ["calls_per_fte", "demand_per_fte", "abandon_demand"], ["language", "req_media", "usd", "level", "date"])
ORACLE["trim_quantile"] = dm_q(f"""
    SELECT d.language, d.req_media, d.usd, d.level, d.date, d.staffing
    FROM (SELECT * FROM datamart WHERE staffing > 0) d
    JOIN (SELECT {GKS}, quantile_cont(staffing, 0.05) AS lo, quantile_cont(staffing, 0.95) AS hi
          FROM datamart WHERE staffing > 0 GROUP BY ALL) b USING (language, req_media, usd, level)
    WHERE d.staffing BETWEEN b.lo AND b.hi""", ["staffing"], ["language", "req_media", "usd", "level", "date"])
ORACLE["time_split"] = dm_q(f"""
    SELECT x.*, s.split_date, CASE WHEN x.date <= s.split_date THEN 'train' ELSE 'test' END AS part
    FROM (SELECT {GKS}, date FROM datamart) x JOIN (
        SELECT {GKS}, list(date ORDER BY date)[CAST(floor(COUNT(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) + 1] AS split_date
        FROM datamart GROUP BY ALL) s USING (language, req_media, usd, level)""", [],
    ["language", "req_media", "usd", "level", "date", "split_date", "part"])
HB = "CAST(CAST(('0x' || substr(md5(concat_ws('|', language, req_media, usd, level, CAST(date AS VARCHAR))), 1, 8)) AS BIGINT) % 5 AS INTEGER)"
ORACLE["hash_split"] = dm_q(f"""SELECT {GKS}, date, {HB} AS bucket,
        CASE WHEN {HB} = 0 THEN 'test' ELSE 'train' END AS part FROM datamart""", [],
    ["language", "req_media", "usd", "level", "date", "bucket", "part"])
ORACLE["folds"] = dm_q(f"""SELECT {GKS}, date, CAST(ntile(5) OVER (PARTITION BY {GKS} ORDER BY date) AS INTEGER) AS fold
    FROM datamart""", [], ["language", "req_media", "usd", "level", "date", "fold"])


def finalm(body: str, doubles: list[str], others: list[str], digits: int = 4) -> str:
    """Results of solved systems: fewer decimals."""
    return "SELECT " + ", ".join([*others, *[f"{R(c, digits)} AS {c}" for c in doubles]]) + f" FROM ({body}) q"


def ols_ctes(p: str, train: str, features: list[str], label: str) -> str:
    """Least squares per group as CTEs ending in ``{p}coef``: moments, the system of the standardised features,
    elimination column by column (the matrix is positive definite), and substitution from the last one back.
    A feature without spread has coefficient 0; a vanishing pivot (collinear features) gives NULL."""
    k, names = len(features), [*features, label]
    out = [f"{p}mom AS (SELECT {GKS}, CAST(COUNT(*) AS DOUBLE) AS n, " + ", ".join(
        [f"AVG({a}) AS m_{a}" for a in names] +
        [f"COVAR_POP({a}, {b}) AS c_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]) +
        f" FROM ({train}) t WHERE " + " AND ".join(f"{a} IS NOT NULL" for a in names) + " GROUP BY ALL)"]
    out.append(f"{p}sd AS (SELECT *, " + ", ".join(
        f"CASE WHEN sqrt(c_{a}_{a}) <= 1e-12 * greatest(abs(m_{a}), 1e-300) THEN NULL ELSE sqrt(c_{a}_{a}) END AS s_{a}"
        for a in features) + f" FROM {p}mom)")
    cells = [f"COALESCE(c_{features[min(i, j)]}_{features[max(i, j)]} / s_{features[i]} / s_{features[j]}, {1.0 if i == j else 0.0}) AS a_{i}_{j}"
             for i in range(k) for j in range(k)]
    right = [f"COALESCE(c_{a}_{label} / s_{a}, 0.0) AS r_{i}" for i, a in enumerate(features)]
    out.append(f"{p}e0 AS (SELECT *, {', '.join(cells + right)} FROM {p}sd)")
    for t in range(k - 1):
        pivot = f"CASE WHEN a_{t}_{t} > 1e-10 THEN a_{t}_{t} END"
        new = [f"a_{i}_{j} - a_{i}_{t} / ({pivot}) * a_{t}_{j} AS a_{i}_{j}" for i in range(t + 1, k) for j in range(t + 1, k)]
        new += [f"r_{i} - a_{i}_{t} / ({pivot}) * r_{t} AS r_{i}" for i in range(t + 1, k)]
        out.append(f"{p}e{t + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {p}e{t})")
    for i in reversed(range(k)):
        rest = "".join(f" - a_{i}_{j} * x_{j}" for j in range(i + 1, k))
        out.append(f"{p}x{i} AS (SELECT *, (r_{i}{rest}) / CASE WHEN a_{i}_{i} > 1e-10 THEN a_{i}_{i} END AS x_{i} "
                   f"FROM {p}{f'x{i + 1}' if i + 1 < k else f'e{k - 1}'})")
    bs = [f"x_{i} / COALESCE(s_{a}, 1.0) AS b_{a}" for i, a in enumerate(features)]
    out.append(f"{p}coef AS (SELECT {GKS}, n, {', '.join(bs)}, m_{label}" + "".join(
        f" - x_{i} / COALESCE(s_{a}, 1.0) * m_{a}" for i, a in enumerate(features)) + f" AS intercept FROM {p}x0)")
    return ",\n".join(out)


def pred(features: list[str], value=lambda f: f) -> str:
    return "intercept" + "".join(f" + b_{f} * ({value(f)})" for f in features)


def half_even(expr: str, digits: int) -> str:
    """Ties of the decimal text of a double go to the even digit, as the query's rounding does."""
    x = f"(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)) * {10 ** digits})"
    up = f"CASE WHEN {x} - floor({x}) > 0.5 OR ({x} - floor({x}) = 0.5 AND floor({x}) % 2 <> 0) THEN 1 ELSE 0 END"
    return f"(CAST(floor({x}) + {up} AS DOUBLE) / {10.0 ** digits})"


def errors(label: str, p: str = "pred") -> str:
    return (f"COUNT(*) AS n_eval, AVG(abs({label} - {p})) AS mae, AVG(({label} - {p}) * ({label} - {p})) AS mse, "
            f"1.0 - AVG(({label} - {p}) * ({label} - {p})) / NULLIF(VAR_POP({label}), 0) AS r2")


_det = "(c_q2_q2 * c_abn_pct_abn_pct - c_q2_abn_pct * c_q2_abn_pct)"
_b1 = f"((c_q2_sl * c_abn_pct_abn_pct - c_abn_pct_sl * c_q2_abn_pct) / NULLIF({_det}, 0))"
_b2 = f"((c_abn_pct_sl * c_q2_q2 - c_q2_sl * c_q2_abn_pct) / NULLIF({_det}, 0))"
ORACLE["ols_two_feature"] = dm_q(f"""
    WITH hs AS (SELECT {GKS}, date, q2, abn_pct, met AS sl, {HB} AS bucket FROM datamart),
    g AS (SELECT {GKS}, COUNT(*) AS n, AVG(q2) AS m_q2, AVG(abn_pct) AS m_abn_pct, AVG(sl) AS m_sl,
                 COVAR_POP(q2, q2) AS c_q2_q2, COVAR_POP(q2, abn_pct) AS c_q2_abn_pct,
                 COVAR_POP(abn_pct, abn_pct) AS c_abn_pct_abn_pct, COVAR_POP(q2, sl) AS c_q2_sl, COVAR_POP(abn_pct, sl) AS c_abn_pct_sl
          FROM hs WHERE bucket <> 0 AND q2 IS NOT NULL AND abn_pct IS NOT NULL AND sl IS NOT NULL GROUP BY ALL),
    coef AS (SELECT {GKS}, CAST(n AS BIGINT) AS n_train,
                    m_sl - {_b1} * m_q2 - {_b2} * m_abn_pct AS intercept, {_b1} AS b_q2, {_b2} AS b_abn_pct FROM g),
    t AS (SELECT h.*, c.intercept + c.b_q2 * h.q2 + c.b_abn_pct * h.abn_pct AS pred
          FROM hs h JOIN coef c USING (language, req_media, usd, level) WHERE h.bucket = 0),
    m AS (SELECT {GKS}, {errors('sl')} FROM t GROUP BY ALL)
    SELECT * FROM coef LEFT JOIN m USING (language, req_media, usd, level)""",
    ["intercept", "b_q2", "b_abn_pct", "mae", "mse", "r2"], ["language", "req_media", "usd", "level", "n_train", "n_eval"])

GK = ["language", "req_media", "usd", "level"]
USING = f"USING ({GKS})"
WEEK = f"date BETWEEN DATE '{WEEK_START}' AND DATE '{WEEK_START}' + 6"


def held_out(rows: str, features: list[str], label: str) -> str:
    """CTEs ``coef`` (with the accuracy on the held-out part) of a model fitted on the 80 % of ``rows`` by hash."""
    return f"""hs AS (SELECT *, {HB} AS bucket FROM ({rows}) r),
    {ols_ctes('f', 'SELECT * FROM hs WHERE bucket <> 0', features, label)},
    scored AS (SELECT h.*, {pred(features, lambda f: 'h.' + f)} AS pred FROM hs h JOIN fcoef {USING} WHERE bucket = 0),
    coef AS (SELECT * FROM fcoef LEFT JOIN (SELECT {GKS}, {errors(label)} FROM scored GROUP BY ALL) {USING})"""


def model_q(ctes: str, body: str, doubles: list[str], others: list[str]) -> str:
    return "WITH " + BASE + ", " + ctes + " " + finalm(body, doubles, others)


def steps(name: str, values: list[int]) -> str:
    return f"(VALUES {', '.join(f'({float(v)})' for v in values)}) grid({name})"


_SL = held_out(f"SELECT {GKS}, date, COALESCE(q2, 0.0) AS q2, COALESCE(abn_pct, 0.0) AS abn_pct, COALESCE(met, 0.0) AS sl FROM datamart",
               ["q2", "abn_pct"], "sl")
ORACLE["sl_sensitivity"] = model_q(_SL, f"""
    SELECT {GKS}, q2_change, w_q2 + q2_change AS q2, w_abn AS abn_pct,
           {half_even('(intercept + b_q2 * (w_q2 + q2_change) + b_abn_pct * w_abn)', 4)} AS predicted_sl, n_eval, mae, r2
    FROM (SELECT {GKS}, AVG(q2) AS w_q2, AVG(abn_pct) AS w_abn FROM datamart WHERE {WEEK} GROUP BY ALL) JOIN coef {USING}
    CROSS JOIN (SELECT CAST(q2_change AS DOUBLE) AS q2_change FROM {steps('q2_change', SL_Q2_OFFSETS)})""",
    ["q2_change", "q2", "abn_pct", "predicted_sl", "mae", "r2"], [*GK, "n_eval"])

_REQ = ["occ_assumption", "staffing", "demand", "occupancy_rate"]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ["date", "met", "q2", "aht", "demand", "occ_assumption", "requirement", "staffing",
                                                       "occupancy_rate", "staffing_diff", "abn_pct", "calls"])
_LIFTED = f"SELECT * REPLACE (staffing * {STAFFING_UPLIFT} AS staffing) FROM datamart"
_REQMODEL = held_out(f"SELECT * FROM ({_LIFTED}) WHERE {_COMPLETE}", _REQ, "requirement") + f""",
    w AS (SELECT {GKS}, AVG(occ_assumption) AS w_occ, AVG(staffing) AS w_staff, SUM(demand) / 7.0 AS w_demand, AVG(occupancy_rate) AS w_rate
          FROM ({_LIFTED}) WHERE {WEEK} GROUP BY ALL)"""
_P = "intercept + b_occ_assumption * ({occ}) + b_staffing * w_staff + b_demand * ({demand}) + b_occupancy_rate * w_rate"
_pd = _P.format(occ="w_occ", demand="w_demand * (1 + demand_change / 100.0)")
ORACLE["fte_demand_grid"] = model_q(_REQMODEL, f"""
    SELECT {GKS}, demand_change, w_demand * (1 + demand_change / 100.0) AS demand, {_pd} AS prediction,
           CAST(trunc({_pd}) AS BIGINT) AS fte, n_eval, mae, r2
    FROM w JOIN coef {USING} CROSS JOIN (SELECT CAST(demand_change AS DOUBLE) AS demand_change FROM {steps('demand_change', PERCENT_STEPS_15)})""",
    ["demand_change", "demand", "prediction", "mae", "r2"], [*GK, "fte", "n_eval"])
_occ = "least(greatest(w_occ + occ_change / 100.0, 0.0), 1.0)"
ORACLE["fte_occ_grid"] = model_q(_REQMODEL, f"""
    SELECT {GKS}, occ_change, {_occ} AS occ_assumption, {_P.format(occ=_occ, demand='w_demand')} AS prediction,
           CAST(trunc({_P.format(occ=_occ, demand='w_demand')}) AS BIGINT) AS fte
    FROM w JOIN coef {USING} CROSS JOIN (SELECT CAST(occ_change AS DOUBLE) AS occ_change FROM {steps('occ_change', OCC_ASSUMPTION_POINT_STEPS)})""",
    ["occ_change", "occ_assumption", "prediction"], [*GK, "fte"])

_WF = ["demand", "q2", "occupancy_rate", "occ_assumption"]
_WROWS = f"SELECT {GKS}, date, {', '.join(_WF)}, requirement FROM datamart WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in [*_WF, "requirement"])
_WMODEL = f"""wr AS ({_WROWS}),
    wsplit AS (SELECT {GKS}, list(date ORDER BY date)[CAST(floor(COUNT(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) + 1] AS split_date FROM wr GROUP BY ALL),
    wparts AS (SELECT wr.*, CASE WHEN date <= split_date THEN 'train' ELSE 'test' END AS part FROM wr JOIN wsplit {USING}),
    {ols_ctes('f', "SELECT * FROM wparts WHERE part = 'train'", _WF, 'requirement')}"""
ORACLE["accuracy_log"] = model_q(_WMODEL, f"""
    SELECT {GKS}, part, {errors('requirement')} FROM (
        SELECT p.*, {pred(_WF, lambda f: 'p.' + f)} AS pred FROM wparts p JOIN fcoef {USING}) GROUP BY ALL""",
    ["mae", "mse", "r2"], [*GK, "part", "n_eval"])
ORACLE["stored_model"] = ORACLE["accuracy_log"]  # scaling and storing a model change no prediction
_DAYS = f"""{_WMODEL},
    wk AS (SELECT {GKS}, date, {', '.join(_WF)}, requirement FROM datamart WHERE {WEEK}),
    daily AS (SELECT {GKS}, date, AVG(demand) AS demand, AVG(requirement) AS actual FROM wk GROUP BY ALL),
    means AS (SELECT {GKS}, AVG(q2) AS q2, AVG(occupancy_rate) AS occupancy_rate, AVG(occ_assumption) AS occ_assumption FROM wk GROUP BY ALL),
    fweek AS (SELECT {GKS}, change, date, COALESCE(d.demand, 0.0) AS day_demand, COALESCE(d.demand, 0.0) * (1 + change / 100.0) AS new_demand,
                     actual, {pred(_WF, lambda f: 'COALESCE(d.demand, 0.0) * (1 + change / 100.0)' if f == 'demand' else 'm.' + f)} AS prediction
              FROM (SELECT m.*, CAST(DATE '{WEEK_START}' + CAST(i AS INTEGER) AS DATE) AS date FROM means m CROSS JOIN range(7) t(i)) m
              LEFT JOIN daily d USING ({GKS}, date) JOIN fcoef {USING}
              CROSS JOIN (SELECT CAST(change AS DOUBLE) AS change FROM {steps('change', PERCENT_STEPS_15)}))"""
ORACLE["fte_week"] = model_q(_DAYS, "SELECT * FROM fweek", ["change", "day_demand", "new_demand", "actual", "prediction"], [*GK, "date"])
ORACLE["fte_week_totals"] = model_q(_DAYS, f"""
    SELECT {GKS}, change, AVG(day_demand) AS daily_demand, AVG(actual) AS daily_actual, AVG(prediction) AS daily_predicted,
           AVG(actual) * 7 AS weekly_actual, AVG(prediction) * 7 AS weekly_predicted,
           (AVG(prediction) - AVG(actual)) / NULLIF(AVG(actual), 0) * 100 AS change_pct FROM fweek GROUP BY ALL""",
    ["change", "daily_demand", "daily_actual", "daily_predicted", "weekly_actual", "weekly_predicted", "change_pct"], GK)

_KF = ["q2", "abn_pct", "occ_assumption", "staffing", "occupancy_rate"]
_kv = {f: f"w.{f}" if f == "staffing" else f"w.{f} * (1 + change / 100.0)" for f in _KF}
ORACLE["kpi_per_fte"] = model_q(f"""hs AS (SELECT *, {HB} AS bucket FROM ({_LIFTED}) r),
    {ols_ctes('f', 'SELECT * FROM hs WHERE bucket <> 0', _KF, 'requirement')},
    w AS (SELECT {GKS}, median(calls) AS calls, median(staffing) AS staffing, AVG(q2) AS q2, AVG(abn_pct) AS abn_pct,
                 AVG(occ_assumption) AS occ_assumption, AVG(occupancy_rate) AS occupancy_rate FROM ({_LIFTED}) WHERE {WEEK} GROUP BY ALL)""", f"""
    SELECT {GKS}, change, {half_even('COALESCE(w.calls * (1 + change / 100.0) / NULLIF(w.staffing, 0), 0.0)', 2)} AS calls_per_fte,
           {pred(_KF, _kv.get)} AS prediction, {half_even(pred(_KF, _kv.get), 2)} AS fte, {half_even(_kv['q2'], 2)} AS q2,
           {half_even(_kv['abn_pct'], 2)} AS abn_pct, {half_even(_kv['occupancy_rate'] + ' * 100', 2)} AS occupancy_pct,
           {half_even(_kv['occ_assumption'] + ' * 100', 2)} AS occ_assumption_pct
    FROM w JOIN fcoef {USING} CROSS JOIN (SELECT CAST(change AS DOUBLE) AS change FROM {steps('change', PERCENT_STEPS_15)})""",
    ["change", "calls_per_fte", "prediction", "fte", "q2", "abn_pct", "occupancy_pct", "occ_assumption_pct"], GK)

ORACLE["standardized"] = dm_q(f"""
    SELECT {GKS}, date, {', '.join(f'COALESCE(({f} - AVG({f}) OVER g) / NULLIF(STDDEV_POP({f}) OVER g, 0), 0.0) AS {f}' for f in _WF)}
    FROM (SELECT * FROM datamart WHERE {' AND '.join(f'{f} IS NOT NULL' for f in _WF)}) WINDOW g AS (PARTITION BY {GKS})""", _WF, [*GK, "date"])

_RATIOS = """abn_pct * demand AS abandon_demand, CASE WHEN staffing IS NOT NULL AND staffing <> 0 THEN calls / staffing ELSE 0.0 END AS calls_per_fte,
    CASE WHEN demand IS NULL OR staffing = 0 THEN 0.0 ELSE demand / staffing END AS demand_per_fte"""
ORACLE["features_filled"] = dm_q(f"""
    SELECT {GKS}, date, {', '.join(f'COALESCE({f}, AVG({f}) OVER (PARTITION BY {GKS})) AS {f}' for f in MEASURES)}
    FROM (SELECT *, {_RATIOS} FROM datamart)""", MEASURES, [*GK, "date"])

_edges = f"""
    r AS (SELECT {GKS}, date, abn_pct FROM datamart WHERE {' AND '.join(f'{f} IS NOT NULL' for f in ('q2', 'demand', 'staffing', 'requirement',
                                                                                                   'occ_assumption', 'abn_pct'))}),
    nn AS (SELECT {GKS}, least(COUNT(DISTINCT abn_pct), 5) AS k FROM r GROUP BY ALL),
    raw AS (SELECT {GKS}, any_value(k) AS k, {', '.join(f'quantile_cont(abn_pct, [{", ".join(str(i / n) for i in range(n + 1))}]) AS q{n}' for n in range(1, 6))}
            FROM r JOIN nn {USING} GROUP BY ALL),
    e AS (SELECT {GKS}, list_sort(list_distinct(list_transform(CASE k {' '.join(f'WHEN {n} THEN q{n}' for n in range(1, 6))} END,
                 lambda x: {stable_sql('x', 4)}))) AS edges FROM raw),
    b AS (SELECT r.*, len(edges) - 1 AS n_buckets, edges, CASE WHEN len(edges) >= 2
                 THEN len(list_filter(edges[2:len(edges) - 1], lambda x: x <= abn_pct)) END AS bucket FROM r JOIN e {USING}),
    l AS (SELECT *, CASE WHEN bucket IS NULL THEN NULL WHEN bucket = n_buckets - 1 THEN printf('%.2f', {stable_sql('edges[bucket + 1]', 2)}) || '%+'
                    ELSE printf('%.2f', {stable_sql('edges[bucket + 1]', 2)}) || '%-' || printf('%.2f', {stable_sql('edges[bucket + 2]', 2)}) || '%' END AS label
          FROM b)"""
ORACLE["quantile_buckets"] = "WITH " + BASE + ", " + _edges + " " + final(f"""
    SELECT {GKS}, date, abn_pct, CAST(n_buckets AS INTEGER) AS n_buckets, CAST(bucket AS INTEGER) AS bucket, label,
           CASE WHEN label IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY {GKS} ORDER BY label) - 1 AS INTEGER) END AS code FROM l""",
    ["abn_pct"], [*GK, "date", "n_buckets", "bucket", "label", "code"])

# --- activity --------------------------------------------------------------------------------------------------

EV = """ev AS (SELECT user_id AS "user", event_type AS tool, ts FROM events),
sess_f AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(LAG(ts) OVER w) > 195000000
                          THEN 1 ELSE 0 END AS nw
           FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY ts)),
sess_g AS (SELECT *, SUM(nw) OVER (PARTITION BY "user" ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM sess_f),
sess AS (SELECT "user", MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS n_events,
                (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6 AS total_seconds, COUNT(DISTINCT tool) AS n_tools,
                string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools_used
         FROM sess_g GROUP BY "user", sid)"""
ORACLE["sessions"] = "WITH " + EV + " " + final("SELECT * FROM sess", ["total_seconds"],
                                                ['"user"', "session_start", "session_end", "n_events", "n_tools",
                                                 "tools_used"])
ORACLE["session_summary"] = "WITH " + EV + " " + final("""
    SELECT s."user", COUNT(*) AS n_sessions, SUM(total_seconds) AS total_seconds, MAX(session_end) AS ended_at,
           CAST(SUM(n_events) AS BIGINT) AS n_events, MAX(t.n_tools) AS n_tools
    FROM sess s JOIN (SELECT "user", COUNT(DISTINCT tool) AS n_tools FROM ev GROUP BY 1) t USING ("user")
    GROUP BY s."user\"""", ["total_seconds"], ['"user"', "n_sessions", "ended_at", "n_events", "n_tools"])
ORACLE["tool_dwell"] = "WITH " + EV + """,
    tf AS (SELECT *, CASE WHEN LAG(tool) OVER w IS NULL OR tool <> LAG(tool) OVER w THEN 1 ELSE 0 END AS nw
           FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY ts, tool)),
    tg AS (SELECT *, SUM(nw) OVER (PARTITION BY "user" ORDER BY ts, tool ROWS UNBOUNDED PRECEDING) AS vid FROM tf),
    tv AS (SELECT "user", vid, MIN(tool) AS tool, MIN(ts) AS started, MAX(ts) AS last FROM tg GROUP BY 1, 2)
    """ + final("""SELECT "user", tool, started,
        (epoch_us(COALESCE(LEAD(started) OVER (PARTITION BY "user" ORDER BY vid), last)) - epoch_us(started)) / 1e6
            AS seconds FROM tv""", ["seconds"], ['"user"', "tool", "started"])
ORACLE["sessions_stream"] = ORACLE["sessions"]  # the stream gives the sessions of the batch

# the hour-wise datamart: the same chain by hour, its assumptions joined left
HOUR = BASE
for _day, _hour in [
    ("CAST(l_shipdate AS DATE) AS date", "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS BIGINT)) AS date"),
    ("CAST(week + CAST(i AS INTEGER) AS DATE) AS date", "CAST(week AS TIMESTAMP) + to_hours(CAST(i AS BIGINT)) AS date"),
    ("CROSS JOIN range(7) t(i)", "CROSS JOIN range(168) t(i)"),
    ("         JOIN assump a", "         LEFT JOIN assump a"),
]:
    assert HOUR.count(_day) == 1
    HOUR = HOUR.replace(_day, _hour)
ORACLE["datamart_hour"] = "WITH " + HOUR + " " + final(
    f"SELECT * REPLACE (staffing * {STAFFING_UPLIFT} AS staffing), date AS ts FROM datamart", DM_DOUBLES,
    ["ts", "language", "usd", "req_media", "level"])

# results that go through a file and back are those of the query that wrote them
for _stored, _of in [("calls_csv", "clean_numeric"), ("fte_csv", "clean_fte"), ("occ_csv", "clean_occ"),
                     ("datamart_stored", "datamart_day"), ("report_csv", "scenario_double")]:
    ORACLE[_stored] = ORACLE[_of]
_s = "CAST(floor(seconds) AS BIGINT)"
ORACLE["usage_log"] = f"""SELECT *, printf('%d:%02d:%02d', {_s} // 3600, {_s} % 3600 // 60, {_s} % 60) AS duration
    FROM ({ORACLE['tool_dwell']})"""
