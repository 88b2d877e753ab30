"""The same queries as plain SQL, to be run by DuckDB on the same tables."""

from __future__ import annotations

import datetime

import numpy as np

from epilattice.functions.places import TERRITORIES
from epilattice.operators.renewal import serial_interval
from epilattice.operators.variants import EFFECTIVENESS, TRANSMISSIBILITY

SQL: dict[str, str] = {}

# Every rounded value is shifted by 3.71e-10 first, on both sides, so that exact ties are not left to
# the last bit of each engine.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}

ALL_WEEKS = [datetime.date(1995, 1, 1) + datetime.timedelta(days=7 * k) for k in range(345)]


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (body, needs)


def check(name: str, body: str, *needs: str) -> None:
    order: list[str] = []

    def visit(v: str) -> None:
        for dep in VIEWS[v][1]:
            visit(dep)
        if v not in order:
            order.append(v)

    for n in needs:
        visit(n)
    ctes = ", ".join(f"{v} AS ({VIEWS[v][0]})" for v in order)
    SQL[name] = f"WITH {ctes} {body}" if ctes else body


def week(d: str) -> str:
    return f"(CAST({d} AS DATE) + 3 - CAST(dayofweek(CAST({d} AS DATE) + 3) AS INTEGER))"


def month(d: str) -> str:
    first = f"CAST(date_trunc('month', {d}) AS DATE)"
    after = f"CAST({first} + INTERVAL 1 MONTH AS DATE)"
    return f"(CASE WHEN {d} - {first} < {after} - {d} THEN {first} ELSE {after} END)"


def strict(agg: str, x: str, over: str = "") -> str:
    tail = f" OVER ({over})" if over else ""
    return f"(CASE WHEN count(*) FILTER (WHERE ({x}) IS NULL){tail} = 0 THEN {agg}({x}){tail} END)"


def r6(*pairs: str) -> str:
    """Rounded columns, each 'expression AS name' or a bare name."""
    out = []
    for p in pairs:
        e, _, n = p.rpartition(" AS ")
        out.append(f"round(CAST({e or n} AS DOUBLE) + 3.71e-10, 8) AS {n}")
    return ", ".join(out)


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


# Views

view("geo", "SELECT n_nationkey AS fips, n_name AS name, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey")
view(
    "geo_neighbors",
    "SELECT n_nationkey AS fips, (n_nationkey + 1) % 25 AS neighb FROM nation WHERE n_nationkey % 8 <> 0 "
    "UNION ALL SELECT n_nationkey, (n_nationkey + 24) % 25 FROM nation WHERE n_nationkey % 8 <> 0",
)
view("population", "SELECT c_nationkey AS fips, CAST(count(*) * 1000 AS BIGINT) AS pop FROM customer GROUP BY 1")
view("household", "SELECT c_nationkey AS fips, round(1 + avg(c_acctbal) / 5000, 3) AS hh_size FROM customer GROUP BY 1")
view(
    "reports",
    "SELECT o_orderkey, c_nationkey AS fips, CAST(o_orderdate AS DATE) AS date, o_orderstatus, o_orderpriority, o_totalprice "
    "FROM orders JOIN customer ON o_custkey = c_custkey",
)
view("lines", "SELECT r.*, l.* FROM lineitem l JOIN reports r ON l.l_orderkey = r.o_orderkey", "reports")
view("daily_new", "SELECT fips, date, count(*) AS cases FROM reports GROUP BY 1, 2", "reports")
view(
    "cases_daily",
    "SELECT date, fips, CAST(sum(cases) OVER (PARTITION BY fips ORDER BY date) AS BIGINT) "
    "- CASE WHEN day(date) = 17 THEN 3 ELSE 0 END AS cases FROM daily_new",
    "daily_new",
)
view(
    "edge_days",
    "SELECT fips AS o, s_nationkey AS d, date, sum(l_quantity) AS visits FROM lines JOIN supplier ON l_suppkey = s_suppkey "
    "GROUP BY 1, 2, 3",
    "lines",
)
view(
    "edges",
    f"SELECT *, {week('date')} AS week, sum(visits) OVER (PARTITION BY o, {week('date')}) AS total FROM edge_days",
    "edge_days",
)
view("weekly_edges", "SELECT week, o, d, sum(visits) / max(total) AS p FROM edges GROUP BY 1, 2, 3", "edges")
NAMES = ["Alpha", "Delta", "Iota", "undefined", "Other"]


def by_priority(labels) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in enumerate(labels, 1))
    return f"CASE left(o_orderpriority, 1) {cases} END"


view(
    "genomes",
    f"""SELECT CAST(l_shipdate AS DATE) AS collection_date,
    CASE WHEN l_linenumber = 7 THEN 'Canada' ELSE 'USA' END AS country, state,
    {by_priority(NAMES)} AS word, CASE WHEN l_returnflag = 'R' THEN 'BA.1' ELSE 'B.1' END AS pango
    FROM lines JOIN geo USING (fips)""",
    "lines",
    "geo",
)
view(
    "vax_long",
    f"""SELECT date, fips, {by_priority(["Partial", "Complete", "Booster", "Partial Coverage", "Complete Coverage"])} AS kind,
    o_totalprice / 4000 AS cases, CAST(100 AS DOUBLE) AS popn FROM reports""",
    "reports",
)
view(
    "poi_weeks",
    f"""SELECT fips, {week('l_shipdate')} AS date,
    sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) AS i, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS o,
    avg(CASE WHEN l_returnflag <> 'N' THEN l_linenumber END) AS di, avg(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS dout
    FROM lines GROUP BY 1, 2""",
    "lines",
)
view(
    "poi_visits",
    "SELECT *, max(i) OVER (PARTITION BY fips) AS im, max(o) OVER (PARTITION BY fips) AS om FROM poi_weeks",
    "poi_weeks",
)
view(
    "weekly_means",
    f"SELECT {week('date')} AS week, fips, avg(l_quantity) AS n_contact, count(*) AS n_sample FROM lines GROUP BY 1, 2",
    "lines",
)
view(
    "contact_fit",
    "SELECT week, fips, n_contact / 7 AS fit, 1 / sqrt(n_sample) AS se_fit FROM weekly_means",
    "weekly_means",
)
view(
    "sero_rounds",
    """SELECT state, CAST(date_trunc('month', date) AS DATE) AS first, count(*) AS n,
    avg(CASE WHEN o_orderstatus = 'F' THEN 1.0e0 ELSE 0.0e0 END) AS share
    FROM reports JOIN geo USING (fips) GROUP BY 1, 2""",
    "reports",
    "geo",
)
view(
    "survey",
    """SELECT *, CASE WHEN n % 13 = 0 THEN 666e0 ELSE 100 * share END AS raw,
    CASE WHEN month(first) = 6 THEN n * 1000 END AS pop FROM sero_rounds""",
    "sero_rounds",
)
view(
    "sero_fit",
    f"""SELECT {week('date')} AS week, state, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0e0 ELSE 0.0e0 END) AS mean_pred
    FROM reports JOIN geo USING (fips) GROUP BY 1, 2""",
    "reports",
    "geo",
)
view(
    "draws",
    """SELECT 'mult[' || CAST((k - 1) % 5 + 1 AS VARCHAR) || ',' || CAST((k - 1) // 5 + 1 AS VARCHAR) || ']' AS variable,
    (k - 1) % 5 + 1 AS i1, (k - 1) // 5 + 1 AS i2, CAST(embedding[k] AS DOUBLE) AS value
    FROM embeddings, generate_series(1, 64) g(k) WHERE k <= len(embedding)""",
)
view("calendar", "SELECT DISTINCT week FROM weekly_means", "weekly_means")

# Scans and sinks

check("csv_typed_scan", "SELECT o_orderkey, fips, date, o_orderstatus, round(o_totalprice + 3.71e-10, 8) AS o_totalprice FROM reports", "reports")
check("csv_projected_scan", "SELECT l_orderkey, l_linenumber, round(l_quantity + 3.71e-10, 8) AS l_quantity, l_returnflag AS flag FROM lineitem")
check(
    "tsv_clean_names",
    """SELECT state AS site, strftime(first, '%b %-d') || ' - ' || strftime(first + 13, '%b %-d, %Y') AS date_range_of_specimen_collection,
    round(raw + 3.71e-10, 8) AS rate_cumulative_prevalence, n AS n_cumulative_prevalence, round(CAST(pop AS DOUBLE) + 3.71e-10, 8) AS catchment_population FROM survey""",
    "survey",
)
check("headerless_scan", "SELECT fips, o_orderkey AS record FROM reports", "reports")
check(
    "utf16_regions",
    "SELECT c_custkey, c_mktsegment, 'Region ' || n_regionkey AS \"Region\" FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
EDGE = "o AS origin_county_fips, d AS destination_county_fips"
check("weekly_csv_files", f"SELECT {EDGE}, round(p + 3.71e-10, 8) AS prop_population, week FROM weekly_edges", "weekly_edges")
check(
    "parquet_week_range",
    f"SELECT {EDGE}, round(p + 3.71e-10, 8) AS prop_population, week FROM weekly_edges WHERE week BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'",
    "weekly_edges",
)
check("parquet_round_trip", f"SELECT week, fips, {r6('n_contact')}, n_sample FROM weekly_means", "weekly_means")
check(
    "week_number_slices",
    f"""SELECT {EDGE}, round(sum(visits) / max(total) + 3.71e-10, 8) AS p,
    date - CAST(isodow(date) AS INTEGER) AS week FROM edges GROUP BY o, d, date - CAST(isodow(date) AS INTEGER)""",
    "edges",
)
check(
    "upserted_edges",
    f"""SELECT {EDGE}, week, round(avg(p) + 3.71e-10, 8) AS prop_population FROM (
    SELECT o, d, week, p FROM weekly_edges WHERE week < DATE '1999-01-01'
    UNION ALL SELECT o, d, week, p * 0.5 FROM weekly_edges WHERE week >= DATE '1998-01-01') GROUP BY o, d, week""",
    "weekly_edges",
)
view("sparse_edges", "SELECT * FROM weekly_edges WHERE weekofyear(week) % 9 <> 4", "weekly_edges")
check(
    "asof_edges",
    f"""SELECT c.week, {EDGE}, round(p + 3.71e-10, 8) AS prop_population FROM (
    SELECT c.week, max(s.week) AS source FROM calendar c JOIN (SELECT DISTINCT week FROM sparse_edges) s ON s.week <= c.week GROUP BY 1) c
    JOIN sparse_edges e ON e.week = c.source""",
    "sparse_edges",
    "calendar",
)
check(
    "fallback_edges",
    f"""SELECT c.week, {EDGE}, round(p + 3.71e-10, 8) AS prop_population FROM (
    SELECT week, CASE WHEN week IN (SELECT week FROM few) THEN week ELSE DATE '1996-01-07' END AS source FROM calendar) c
    JOIN few e ON e.week = c.source""".replace("few", "sparse_edges"),
    "sparse_edges",
    "calendar",
)
SQL["asof_partitions"] = SQL["asof_edges"]
check(
    "fallback_partitions",
    f"""SELECT c.week, {EDGE}, round(p + 3.71e-10, 8) AS prop_population FROM (
    SELECT week, CASE WHEN week IN (SELECT week FROM sparse_edges) THEN week ELSE DATE '1996-01-07' END AS source FROM calendar WHERE year(week) = 1997) c
    JOIN sparse_edges e ON e.week = c.source""",
    "sparse_edges",
    "calendar",
)
check(
    "upserted_versions",
    f"""SELECT {EDGE}, week, round(avg(p) + 3.71e-10, 8) AS prop_population FROM (
    SELECT o, d, week, p FROM weekly_edges WHERE week < DATE '1999-01-01'
    UNION ALL SELECT o, d, week, p * 0.5e0 FROM weekly_edges WHERE week >= DATE '1998-01-01'
    UNION ALL SELECT o, d, week, p * 3e0 FROM weekly_edges WHERE year(week) = 1996) GROUP BY o, d, week""",
    "weekly_edges",
)
check(
    "directory_union",
    """SELECT c_nationkey AS fips, round(c_acctbal + 3.71e-10, 8) AS balance, c_mktsegment AS segment, NULL AS name, NULL AS state FROM customer
    UNION ALL SELECT s_nationkey, round(s_acctbal + 3.71e-10, 8), NULL, NULL, NULL FROM supplier
    UNION ALL SELECT fips, NULL, NULL, name, state FROM geo""",
    "geo",
)
check(
    "union_of_shapes",
    """SELECT c_nationkey AS fips, round(c_acctbal + 3.71e-10, 8) AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_nationkey, round(s_acctbal + 3.71e-10, 8), NULL FROM supplier""",
)

# Projections and filters

check(
    "recoded_population",
    """SELECT fips, CAST(pop AS BIGINT) AS pop, CASE fips WHEN 103 THEN 'AFRICA' WHEN 104 THEN 'AMERICA' WHEN 200 THEN 'UNIT' ELSE g.state END AS state
    FROM (SELECT CASE fips WHEN 3 THEN 103 WHEN 4 THEN 104 WHEN 7 THEN 200 WHEN 8 THEN 200 WHEN 9 THEN 200 ELSE fips END AS fips, sum(pop) AS pop
    FROM population GROUP BY 1) LEFT JOIN geo g USING (fips)""",
    "population",
    "geo",
)
check(
    "split_reporting_units",
    """SELECT week, coalesce(t, fips) AS fips, n_sample FROM weekly_means LEFT JOIN
    (VALUES (7, 2282), (7, 2105), (8, 2060), (8, 2164)) m(u, t) ON u = fips""",
    "weekly_means",
)
check(
    "excluded_places",
    """SELECT o_orderkey, fips FROM (SELECT o_orderkey, CASE WHEN (o_custkey % 25) % 6 <> 0 THEN o_custkey % 25 END AS fips FROM orders)
    WHERE fips IS NULL OR fips NOT IN (1, 2, 3)""",
)
check("allowed_origins", "SELECT DISTINCT o AS fips FROM edges JOIN geo ON fips = o WHERE o NOT IN (5, 6)", "edges", "geo")
check(
    "city_override",
    f"""SELECT week, fips, n_covid, city, CASE WHEN city = 1 THEN 8419000 ELSE pop END AS pop FROM (
    SELECT {week('date')} AS week, CASE WHEN name = 'NATION_3' THEN 36061 ELSE fips END AS fips,
    CAST(trunc(avg(cases)) AS BIGINT) AS n_covid, max(CASE WHEN name = 'NATION_3' THEN 1 ELSE 0 END) AS city
    FROM cases_daily JOIN geo USING (fips) GROUP BY 1, 2) LEFT JOIN population USING (fips)""",
    "cases_daily",
    "geo",
    "population",
)
check(
    "city_cumulative",
    f"""SELECT {week('date')} AS week, CASE WHEN name = 'NATION_3' THEN 36061 ELSE fips END AS fips,
    CAST(trunc(avg(cases)) AS BIGINT) AS n_covid FROM cases_daily JOIN geo USING (fips) GROUP BY 1, 2""",
    "cases_daily",
    "geo",
)
check(
    "sentinels_and_clamps",
    f"""SELECT c_custkey, {r6('r AS rate', 'CASE WHEN r < 0 THEN 0 ELSE r END AS floored', 'CASE WHEN r > 50 THEN 50 ELSE r END AS capped',
    'CASE WHEN r <= 50 THEN r END AS cut', 'CASE WHEN r BETWEEN 0 AND 50 THEN r END AS inside', 'coalesce(r, 0.9e0) AS filled')},
    CASE WHEN r > 10 THEN 'high' WHEN r <= 10 THEN 'low' END AS label, round(r / nullif(CASE WHEN r < 0 THEN 0 ELSE r END, 0) + 3.71e-10, 8) AS share
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 100 END AS r FROM customer)""",
)
check(
    "large_pairs",
    f"SELECT {EDGE}, date, round(visits + 3.71e-10, 8) AS num_visits FROM edges WHERE visits > 40 QUALIFY count(*) OVER (PARTITION BY o, d) > 5",
    "edges",
)
check(
    "null_duplicates",
    """SELECT k, bg, c_custkey FROM (SELECT c_custkey % 400 AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS bg, c_custkey FROM customer)
    QUALIFY NOT (count(*) OVER (PARTITION BY k) > 1 AND bg IS NULL)""",
)
check(
    "well_observed_places",
    """SELECT week, fips, n_sample FROM weekly_means WHERE n_sample >= 8
    QUALIFY count(*) OVER (PARTITION BY fips) / (SELECT count(DISTINCT week) FROM weekly_means WHERE n_sample >= 8)::DOUBLE > 0.35""",
    "weekly_means",
)
check(
    "corrected_cells",
    "SELECT week, fips, CASE WHEN n_sample = 3 THEN 300 ELSE n_sample END AS n_sample FROM weekly_means",
    "weekly_means",
)

# Joins

check(
    "full_join_null_keys",
    """SELECT coalesce(a.k, b.k) AS k, orders, customers FROM
    (SELECT CASE WHEN (o_custkey % 30) % 7 <> 0 THEN o_custkey % 30 END AS k, count(*) AS orders FROM orders GROUP BY 1) a FULL JOIN
    (SELECT CASE WHEN (c_custkey % 40) % 9 <> 0 THEN c_custkey % 40 END AS k, count(*) AS customers FROM customer GROUP BY 1) b
    ON a.k IS NOT DISTINCT FROM b.k""",
)
check(
    "members_and_others",
    """SELECT fips, count(*) AS n FROM reports WHERE fips IN (SELECT fips FROM geo_neighbors) GROUP BY 1
    UNION ALL SELECT fips, 0 FROM geo WHERE fips NOT IN (SELECT fips FROM geo_neighbors)""",
    "reports",
    "geo",
    "geo_neighbors",
)
check(
    "cases_at_both_ends",
    """SELECT e.week, o AS i, d AS j, a.n_sample AS cases_i, b.n_sample AS cases_j FROM weekly_edges e
    LEFT JOIN weekly_means a ON a.fips = o AND a.week = e.week LEFT JOIN weekly_means b ON b.fips = d AND b.week = e.week""",
    "weekly_edges",
    "weekly_means",
)
check(
    "positional_pairs",
    """SELECT a.fips, week AS week_a, n_sample, date AS date_b, cases FROM
    (SELECT *, row_number() OVER (PARTITION BY fips ORDER BY week) AS n FROM weekly_means) a LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY fips ORDER BY date) AS n FROM daily_new) b ON a.fips = b.fips AND a.n = b.n""",
    "weekly_means",
    "daily_new",
)
check(
    "versions_apart",
    f"SELECT fips, week, {r6('n_contact AS old', 'n_contact + 0.5 AS new', '-0.5 AS difference')} FROM weekly_means WHERE month(week) = 3",
    "weekly_means",
)

# Aggregation

check(
    "strict_and_skip",
    f"""SELECT k, {r6(strict('sum', 'x') + ' AS sum_strict', 'coalesce(sum(x), 0) AS sum_skip', strict('avg', 'x') + ' AS mean_strict',
    'avg(x) AS mean_skip', strict('stddev_samp', 'x') + ' AS sd_strict',
    'CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND w IS NULL) = 0 THEN sum(x * w) / sum(CASE WHEN x IS NOT NULL THEN w END) END AS mean_weighted',
    'sqrt(avg(x * x)) AS rms')}, CAST(trunc(avg(x)) AS INTEGER) AS mean_int, count(*) AS n FROM (
    SELECT o_custkey % 300 AS k, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice / 1000 END AS x,
    CASE WHEN o_orderkey % 70 <> 0 THEN o_orderkey % 7 + 1 END AS w FROM orders) GROUP BY k""",
)
check(
    "group_shares",
    """SELECT week, fips, n_sample, CAST(sum(n_sample) OVER (PARTITION BY week) AS BIGINT) AS total,
    round(n_sample / sum(n_sample) OVER (PARTITION BY week) + 3.71e-10, 8) AS share FROM weekly_means""",
    "weekly_means",
)
check(
    "distinct_counts",
    f"SELECT fips, count(DISTINCT {week('date')}) AS weeks, min({week('date')}) AS first, max({week('date')}) AS last FROM reports GROUP BY 1",
    "reports",
)
view("with_month", f"SELECT *, {month('week')} AS month FROM weekly_edges", "weekly_edges")
view("month_resid", "SELECT *, avg(p) OVER (PARTITION BY month, d) AS mp FROM with_month", "with_month")
view(
    "residuals",
    "SELECT *, mp - p AS resid, " + div("(mp - p) - avg(mp - p) OVER (PARTITION BY d)", "stddev_samp(mp - p) OVER (PARTITION BY d)")
    + " AS z FROM month_resid",
    "month_resid",
)
check(
    "edge_residuals",
    f"SELECT week, {EDGE}, month, {r6('p AS prop_population', 'mp AS p', 'resid', 'z AS z_resid')} FROM residuals",
    "residuals",
)
OVER = ", ".join("avg(CASE WHEN {0} > %d THEN 1.0e0 WHEN {0} <= %d THEN 0.0e0 END) AS over_%d" % (k, k, k) for k in (3, 2, 1))
check(
    "residual_shares",
    "SELECT round(over_3 + 3.71e-10, 8) AS over_3, round(over_2 + 3.71e-10, 8) AS over_2, round(over_1 + 3.71e-10, 8) AS over_1, sides FROM ("
    f"SELECT {OVER.format('abs(z)')}, 2 AS sides FROM residuals UNION ALL SELECT {OVER.format('z')}, 1 AS sides FROM residuals)",
    "residuals",
)
SUMMARY = "avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper"
view("summaries", f"SELECT variable, i1, i2, {SUMMARY} FROM draws GROUP BY 1, 2, 3", "draws")
check("draw_summaries", f"SELECT variable, {r6('mean', 'sd', 'lower', 'upper')} FROM summaries", "summaries")
check(
    "draws_by_place",
    f"""SELECT fips, week, 'mult' AS variable, {r6('mean', 'sd', 'lower', 'upper')} FROM summaries
    LEFT JOIN (SELECT fips, row_number() OVER (ORDER BY fips) AS n FROM geo) a ON a.n = i1
    LEFT JOIN (SELECT week, row_number() OVER (ORDER BY week) AS n FROM calendar) b ON b.n = i2""",
    "summaries",
    "geo",
    "calendar",
)

# Windows

check("daily_steps", "SELECT date, fips, cases, cases - lag(cases) OVER (PARTITION BY fips ORDER BY date) AS new FROM cases_daily", "cases_daily")
view("gappy", "SELECT fips, week, CASE WHEN n_sample % 3 = 0 THEN n_sample END AS x FROM weekly_means", "weekly_means")
DOWN = "last_value({} IGNORE NULLS) OVER (PARTITION BY {} ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
UP = "first_value({} IGNORE NULLS) OVER (PARTITION BY {} ORDER BY {} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def down(x: str, by: str = "fips", order: str = "week") -> str:
    return DOWN.format(x, by, order)


def up(x: str, by: str = "fips", order: str = "week") -> str:
    return UP.format(x, by, order)


check(
    "filled_series",
    f"SELECT fips, week, x, {down('x')} AS down, coalesce({down('x')}, {up('x')}) AS down_up, coalesce({up('x')}, {down('x')}) AS up_down FROM gappy",
    "gappy",
)


def rolling(x: str, by: str, before: int, after: int) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY week ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"CASE WHEN count({x}) {w} = {before + after + 1} THEN avg({x}) {w} END"


check(
    "rolling_means",
    f"SELECT fips, week, {r6('x', rolling('x', 'fips', 1, 1) + ' AS centred', rolling('x', 'fips', 0, 2) + ' AS ahead')} "
    "FROM (SELECT fips, week, CASE WHEN n_sample % 5 <> 0 THEN n_contact END AS x FROM weekly_means)",
    "weekly_means",
)
check(
    "group_scores",
    f"""SELECT fips, week, state, {r6('coalesce(x, m) AS x', div('x - m', 's') + ' AS z', div('x', 'm') + ' AS relative')} FROM (
    SELECT *, avg(x) OVER (PARTITION BY state) AS m, stddev_samp(x) OVER (PARTITION BY state) AS s FROM (
    SELECT fips, week, state, CASE WHEN n_sample % 4 <> 0 THEN n_contact END AS x FROM weekly_means JOIN geo USING (fips)))""",
    "weekly_means",
    "geo",
)
check(
    "time_indexed",
    """SELECT fips, week, CAST(dense_rank() OVER (ORDER BY week) AS INTEGER) AS t,
    (SELECT CAST(count(DISTINCT week) AS INTEGER) FROM weekly_means) AS t_max FROM weekly_means""",
    "weekly_means",
)
check(
    "sampled_place",
    """SELECT fips, week, n_sample FROM weekly_means
    WHERE fips = (SELECT arg_min(fips, md5('seed|' || fips)) FROM (SELECT DISTINCT fips FROM weekly_means))""",
    "weekly_means",
)
check("reference_weeks", "SELECT DISTINCT week FROM weekly_means WHERE fips = 1 AND week >= DATE '1996-01-28'", "weekly_means")

# Shape

check(
    "dense_panel",
    """SELECT fips, week, n_sample FROM (SELECT DISTINCT fips FROM weekly_means) CROSS JOIN calendar LEFT JOIN weekly_means USING (fips, week)""",
    "weekly_means",
    "calendar",
)
view(
    "state_weeks",
    "SELECT state, fips, week, n_sample FROM weekly_means JOIN geo USING (fips) WHERE month(week) <> fips % 12 + 1",
    "weekly_means",
    "geo",
)
check(
    "dense_within_states",
    """SELECT state, fips, week, n_sample FROM (SELECT DISTINCT state, fips FROM state_weeks) JOIN (SELECT DISTINCT state, week FROM state_weeks)
    USING (state) LEFT JOIN state_weeks USING (state, fips, week)""",
    "state_weeks",
)
check(
    "status_columns",
    "SELECT fips, date, " + ", ".join(f"nullif(count(*) FILTER (WHERE o_orderstatus = '{s}'), 0) AS \"{s}\"" for s in "FOP")
    + " FROM reports GROUP BY 1, 2",
    "reports",
)
check(
    "week_columns",
    "SELECT fips, " + ", ".join(
        f"max(CASE WHEN week = DATE '{d}' THEN n_sample END) AS w{str(d).replace('-', '_')}" for d in ALL_WEEKS
    ) + " FROM weekly_means GROUP BY 1",
    "weekly_means",
)
check(
    "long_measures",
    """SELECT fips, week, 'n_contact' AS name, round(n_contact + 3.71e-10, 8) AS value FROM weekly_means
    UNION ALL SELECT fips, week, 'n_sample', CAST(n_sample AS DOUBLE) FROM weekly_means""",
    "weekly_means",
)
check(
    "nested_series",
    "SELECT fips, CAST(count(*) OVER (PARTITION BY fips) AS INTEGER) AS weeks, week, n_sample FROM weekly_means",
    "weekly_means",
)
check(
    "key_value_edges",
    "SELECT o AS fips, date, d AS dest, CAST(trunc(visits) AS DOUBLE) AS n FROM edge_days",
    "edge_days",
)
check("union_without_repeats", "SELECT DISTINCT fips, week FROM weekly_means", "weekly_means")

# Scalars

check(
    "text_functions",
    f"""SELECT c_custkey, c_name AS second, '' AS absent, lower(c_mktsegment) AS first, c_name || ' / ' || c_custkey AS tail,
    {r6("CAST(regexp_extract(c_name, '[0-9]+') AS DOUBLE) AS number", '1 / (1 + exp(-(c_acctbal / 5000))) AS logit',
    '(c_acctbal * 1.1e0 - c_acctbal * 0.9e0) / 3.92e0 AS se', 'sqrt(abs(c_acctbal)) AS root')} FROM customer""",
)
INSTANT = "CAST(CAST(day AS TIMESTAMP) + to_hours(day(day)) + INTERVAL 84 HOUR AS DATE)"
FIRST_MONDAY = "(make_date(year(day), 1, 1) + CAST((8 - isodow(make_date(year(day), 1, 1))) % 7 AS INTEGER))"
check(
    "date_functions",
    f"""SELECT day, {week('day')} AS week, {INSTANT} - CAST(dayofweek({INSTANT}) AS INTEGER) AS week_of_instant, {month('day')} AS month,
    day + 21 AS later, CAST(floor((day - DATE '1995-01-01') / 7.0e0) AS INTEGER) AS weeks,
    {FIRST_MONDAY} + CAST(7 * (month(day) - 1) - 1 AS INTEGER) AS numbered, day AS parsed
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)""",
)

# Incidence

EXCLUDED = ", ".join(map(str, TERRITORIES))
view(
    "steps",
    f"""SELECT fips, {week('date')} AS week, cases - lag(cases) OVER (PARTITION BY fips ORDER BY date) AS new
    FROM cases_daily WHERE fips NOT IN ({EXCLUDED})""",
    "cases_daily",
)
view("step_weeks", "SELECT fips, week, CAST(coalesce(sum(new), 0) AS BIGINT) AS cases FROM steps GROUP BY 1, 2", "steps")
view(
    "incidence",
    """SELECT fips, week, greatest(coalesce(cases, 0), 0) AS cases FROM (SELECT DISTINCT fips FROM step_weeks)
    CROSS JOIN (SELECT DISTINCT week FROM step_weeks) LEFT JOIN step_weeks USING (fips, week)""",
    "step_weeks",
)
check("weekly_incidence", "SELECT fips, week, cases FROM incidence", "incidence")
check(
    "incidence_per_capita",
    "SELECT fips, week, cases, pop, state, round(cases / CAST(pop AS DOUBLE) + 3.71e-10, 8) AS mean_incidence FROM incidence LEFT JOIN population USING (fips) LEFT JOIN geo USING (fips)",
    "incidence",
    "population",
    "geo",
)
view(
    "mean_weeks",
    f"SELECT fips, {week('date')} AS week, CAST(trunc(avg(cases)) AS BIGINT) AS cases FROM cases_daily WHERE fips NOT IN ({EXCLUDED}) GROUP BY 1, 2",
    "cases_daily",
)
view(
    "mean_steps",
    """SELECT fips, week, greatest(coalesce(cases - lag(cases) OVER (PARTITION BY fips ORDER BY week), 0), 0) AS cases FROM
    (SELECT DISTINCT fips FROM mean_weeks) CROSS JOIN (SELECT DISTINCT week FROM mean_weeks) LEFT JOIN mean_weeks USING (fips, week)""",
    "mean_weeks",
)
check("incidence_from_mean", "SELECT fips, week, cases FROM mean_steps WHERE week < DATE '2000-01-01'", "mean_steps")
view("city_days", f"SELECT fips, {week('date')} AS week, sum(cases) AS cases FROM daily_new WHERE fips BETWEEN 1 AND 5 GROUP BY 1, 2", "daily_new")
view(
    "city_weeks",
    """SELECT fips, week, CAST(cases AS BIGINT) AS cases FROM (SELECT DISTINCT fips FROM city_days) CROSS JOIN (SELECT DISTINCT week FROM city_days)
    LEFT JOIN city_days USING (fips, week)""",
    "city_days",
)
check("city_weekly_sum", "SELECT fips, week, cases FROM city_weeks", "city_weeks")
check(
    "combined_reports",
    "SELECT fips, week, cases FROM mean_steps UNION SELECT fips, week, cases FROM city_weeks",
    "mean_steps",
    "city_weeks",
)

# Mobility and coupling


def cleaned(cap: float, where: str, policy: str) -> str:
    kept = "" if policy == "strict" else "ELSE p"
    return f"""SELECT o, d, week, {div('value', strict('sum', 'value', 'PARTITION BY o, week'))} AS prop FROM (
    SELECT o, d, week, total * CASE WHEN z > {cap} THEN m + {cap} * s WHEN z < -{cap} THEN m - {cap} * s WHEN z IS NOT NULL THEN p {kept} END AS value FROM (
    SELECT *, {div('p - m', 's')} AS z FROM (
    SELECT o, d, week, total, visits / total AS p, avg(visits / total) OVER (PARTITION BY o, d) AS m,
    stddev_samp(visits / total) OVER (PARTITION BY o, d) AS s, count(*) OVER (PARTITION BY o, d) AS n FROM edges WHERE visits > 10 {where})
    WHERE n > 3))"""


view("cleaned", "SELECT DISTINCT * FROM (" + cleaned(3, "", "strict") + ") WHERE prop > 1e-4", "edges")
check("clean_edges", f"SELECT {EDGE}, week, round(prop + 3.71e-10, 8) AS prop_population FROM cleaned", "cleaned")
check(
    "clean_edges_skip",
    f"SELECT {EDGE}, week, round(prop + 3.71e-10, 8) AS prop_population FROM (" + cleaned(1.5, "AND week > DATE '1996-06-30'", "skip") + ") WHERE prop > 1e-4",
    "edges",
)
view(
    "long_pairs",
    """SELECT *, CAST(floor((week - (SELECT min(week) FROM weekly_edges)) / 7.0e0) AS INTEGER) + 1 AS week_index FROM with_month
    QUALIFY count(*) OVER (PARTITION BY o, d) > 60""",
    "with_month",
)
view(
    "z_pairs",
    f"SELECT *, {div('p - avg(p) OVER (PARTITION BY o, d)', 'stddev_samp(p) OVER (PARTITION BY o, d)')} AS z FROM long_pairs",
    "long_pairs",
)
check(
    "edge_standardise",
    f"""SELECT week, {EDGE}, week_index, month,
    {r6('p AS prop_population', 'z', strict('avg', 'z', 'PARTITION BY month, d') + ' AS month_mean', rolling('z', 'o, d', 1, 1) + ' AS ma')} FROM z_pairs""",
    "z_pairs",
)
check(
    "edge_scaled",
    f"""SELECT week, {EDGE}, week_index, month, {r6('p AS prop_population', 'month_mean', 'ma', 'fit', 'bg',
    'p * (fit * bg) AS scaled', 'month_mean * (fit * bg) AS scaled_month', 'ma * (fit * bg) AS scaled_ma')}
    FROM (SELECT *, avg(p) OVER (PARTITION BY month, d) AS month_mean, {rolling('p', 'o, d', 1, 1)} AS ma FROM long_pairs) e
    LEFT JOIN (SELECT week, fips AS o, fit FROM contact_fit) c USING (week, o)
    LEFT JOIN (SELECT fips AS d, pop / 50000.0e0 AS bg FROM population) b USING (d)""",
    "long_pairs",
    "contact_fit",
    "population",
)
check(
    "endpoint_universe",
    "SELECT DISTINCT fips FROM contact_fit WHERE fips % 6 <> 0 AND fips % 7 <> 0",
    "contact_fit",
)


def product(edges: str, known: str, missing_self: bool) -> dict[str, tuple[str, tuple[str, ...]]]:
    """A A^T by a join, with loops of unknown weight where asked for."""
    loops = (
        "UNION ALL SELECT week, n, n, NULL FROM (SELECT week, o AS n, d FROM kept UNION ALL SELECT week, d, o FROM kept) "
        "GROUP BY 1, 2 HAVING count(*) FILTER (WHERE n = d) = 0"
    )
    return (
        f"""SELECT week, i, j, {strict('sum', 'v * w')} AS s, max(own) AS own FROM (
        SELECT a.week, a.o AS i, b.o AS j, a.v AS v, b.v AS w, CASE WHEN a.o = b.o AND a.d = a.o THEN a.v END AS own FROM full_edges a JOIN full_edges b ON a.week = b.week AND a.d = b.d)
        GROUP BY 1, 2, 3""".replace(
            "full_edges",
            f"""(WITH kept AS (SELECT e.week, o, d, sum(v) AS v FROM ({edges}) e JOIN ({known}) a ON a.week = e.week AND a.fips = o
            JOIN ({known}) b ON b.week = e.week AND b.fips = d GROUP BY 1, 2, 3) SELECT week, o, d, v FROM kept {loops if missing_self else ''})""",
        )
    )


view(
    "rates",
    "SELECT week, fips, fit, hh_size, se_fit * se_fit AS var FROM contact_fit JOIN household USING (fips)",
    "contact_fit",
    "household",
)
WEEKLY = "SELECT week, o, d, p AS v FROM weekly_edges"
view("product_null", product(WEEKLY, "SELECT week, fips FROM rates", True), "weekly_edges", "rates")
view("product_zero", product(WEEKLY, "SELECT week, fips FROM rates", False), "weekly_edges", "rates")


def coupled(source: str, rates: str = "rates") -> str:
    return f"""SELECT week, i, j, mean FROM (SELECT p.week, i, j, fit * s + CASE WHEN i = j THEN hh_size * coalesce(own, 0) * coalesce(own, 0) ELSE 0 END AS mean
    FROM {source} p JOIN {rates} r ON r.week = p.week AND r.fips = i) WHERE mean > 1e-4"""


for name, source in (("coupling_by_week", "product_null"), ("coupling_blocks", "product_zero")):
    check(name, f"SELECT week, i, j, round(mean + 3.71e-10, 8) AS mean FROM ({coupled(source)})", source)
check(
    "coupling_variance",
    "SELECT p.week, i, j, round(var * s * s + 3.71e-10, 8) AS var FROM product_null p JOIN rates r ON r.week = p.week AND r.fips = i WHERE s IS NOT NULL",
    "product_null",
)

# Variants and vaccination


def shares(where: str) -> str:
    return f"""SELECT *, CAST(sum(n) OVER (PARTITION BY state, week) AS BIGINT) AS n_total, n / sum(n) OVER (PARTITION BY state, week) AS p FROM (
    SELECT state, {week('collection_date')} AS week, lower(CASE WHEN pango = 'BA.1' THEN 'Omicron' WHEN word IN ('undefined', 'Other') THEN 'other'
    ELSE word END) AS lineage, count(*) AS n FROM genomes WHERE country = 'USA' {where} GROUP BY 1, 2, 3)"""


view("lineages", shares(""), "genomes")
check(
    "lineage_shares",
    f"SELECT state, week, lineage, n, n_total, {r6('p')} FROM ("
    + shares("AND collection_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'") + ")",
    "genomes",
)
view(
    "collapsed",
    """SELECT *, CAST(sum(n) OVER (PARTITION BY week, state) AS BIGINT) AS n_total, n / sum(n) OVER (PARTITION BY week, state) AS p FROM (
    SELECT week, state, CASE WHEN lineage IN ('alpha', 'delta', 'omicron') THEN lineage ELSE 'other' END AS lineage,
    CAST(sum(n) AS BIGINT) AS n FROM lineages GROUP BY 1, 2, 3)""",
    "lineages",
)
check("collapsed_lineages", f"SELECT week, state, lineage, n, n_total, {r6('p')} FROM collapsed", "collapsed")


def multiplier(known: dict) -> str:
    return f"""SELECT state, week, {strict('sum', 'p * m')} AS beta_mult FROM lineages
    LEFT JOIN ({values(known.items(), 'lineage, m')}) t USING (lineage) GROUP BY 1, 2"""


check(
    "transmissibility",
    f"SELECT state, week, round(CAST(beta_mult AS DOUBLE) + 3.71e-10, 8) AS beta_mult FROM ({multiplier({k: x for k, x in TRANSMISSIBILITY.items() if k != 'iota'})})",
    "lineages",
)
view("multiplier", multiplier(TRANSMISSIBILITY), "lineages")
check(
    "multiplier_by_state_code",
    "SELECT CASE WHEN state = 'ASIA' THEN state ELSE left(state, 2) END AS state, week, round(CAST(beta_mult AS DOUBLE) + 3.71e-10, 8) AS beta_mult FROM multiplier",
    "multiplier",
)
EFFECT = values([(k, EFFECTIVENESS["partial"][k], EFFECTIVENESS["complete"][k]) for k in EFFECTIVENESS["partial"]], "lineage, ep, ec")
view(
    "effect",
    f"SELECT week, state, CASE WHEN count(*) = count(p * ep) THEN sum(p * CAST(ep AS DOUBLE)) END AS partial, CASE WHEN count(*) = count(p * ec) THEN sum(p * CAST(ec AS DOUBLE)) END AS complete FROM collapsed LEFT JOIN ({EFFECT}) USING (lineage) GROUP BY 1, 2",
    "collapsed",
)
check("vaccine_effectiveness", f"SELECT week, state, {r6('partial', 'complete')} FROM effect", "effect")


def coverage(where: str) -> str:
    return f"""SELECT week, fips, avg(CASE WHEN kind LIKE 'Partial%' THEN share END) AS part, avg(CASE WHEN kind NOT LIKE 'Partial%' THEN share END) AS comp FROM (
    SELECT {week('date')} AS week, fips, kind, CASE WHEN kind LIKE '%Coverage' THEN cases * 1e-2 ELSE cases / popn END AS share FROM vax_long {where})
    WHERE share <= 1 GROUP BY 1, 2"""


view("coverage", coverage(""), "vax_long")
check(
    "vaccination_coverage",
    f"SELECT week, fips, {r6('part AS Partial', 'comp AS Complete')}, name, state FROM ({coverage('WHERE date < DATE ' + repr('2000-01-01'))}) JOIN geo USING (fips)",
    "vax_long",
    "geo",
)
check("partial_coverage", f"SELECT week, fips, {r6('part - comp AS Partial', 'comp AS Complete')} FROM coverage", "coverage")


def lagged_coverage(unit: str) -> str:
    return f"""SELECT week + 14 AS week, fips, comp AS complete, CASE WHEN comp > part THEN comp WHEN comp <= part THEN part END - comp AS partial FROM (
    SELECT week, {unit} AS fips, avg(comp) * 1e-2 AS comp, avg(part) * 1e-2 AS part FROM (
    SELECT {week('date')} AS week, fips, avg(CASE WHEN kind = 'Complete Coverage' THEN cases END) AS comp,
    avg(CASE WHEN kind = 'Partial Coverage' THEN cases END) AS part FROM vax_long WHERE kind LIKE '%Coverage' GROUP BY 1, 2) GROUP BY 1, 2)"""


check(
    "coverage_lagged",
    f"SELECT week, fips, {r6('complete', 'partial')} FROM ({lagged_coverage('CASE WHEN fips IN (7, 8) THEN 2998 ELSE fips END')})",
    "vax_long",
)
view("lagged", lagged_coverage("fips"), "vax_long")

# Serology and immunity

view(
    "rounds",
    f"""SELECT state, {week('first + 13')} AS week, CASE WHEN raw NOT IN (666, 777) THEN raw * 1e-2 END AS rate, n,
    raw * n AS mean_sero, raw * n * 1.1e0 AS upper, raw * n * 0.9e0 AS lower, pop FROM survey""",
    "survey",
)
view(
    "prepared",
    f"""SELECT state, week, rate, mean_sero, upper, lower, n, coalesce({up('pop', 'state')}, {down('pop', 'state')}) AS pop,
    CAST(dense_rank() OVER (ORDER BY week) AS INTEGER) AS t, (upper - lower) / 3.92e0 AS se, CAST(trunc(rate * n) AS BIGINT) AS success
    FROM (SELECT DISTINCT state FROM rounds) CROSS JOIN (SELECT DISTINCT week FROM rounds) LEFT JOIN rounds USING (state, week)""",
    "rounds",
)
check(
    "serosurvey_prepare",
    f"SELECT state, week, {r6('rate', 'mean_sero', 'upper', 'lower')}, n, pop, t, {r6('se')}, success FROM prepared",
    "prepared",
)
check(
    "state_sero_counts",
    f"""SELECT state, week, pop, {r6('rate * 100 AS mean_sero', 'n / 1000.0e0 AS suspected_covid_cases')},
    CAST(trunc((rate * 100) * pop / 100) AS BIGINT) AS mean_sero_int FROM prepared WHERE n IS NOT NULL AND rate IS NOT NULL AND state <> 'ASIA'""",
    "prepared",
)
check(
    "serosurvey_few_rounds",
    f"""SELECT * FROM (WITH short AS (
        SELECT state, t, CASE WHEN here THEN mean_sero END AS mean_sero, CASE WHEN here THEN success END AS success, CASE WHEN here THEN n END AS n
        FROM (SELECT *, t % 4 = 0 AND mean_sero IS NOT NULL AND t <= 4 * (2 + 2 * list_position(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], state)) AS here FROM prepared)
    ), sized AS (
        SELECT state, CAST(count(mean_sero) AS INTEGER) AS rounds, CAST(CASE WHEN count(mean_sero) > 10 THEN 5 ELSE greatest(count(mean_sero) - 3, 1) END AS INTEGER) AS size FROM short GROUP BY 1
    ), shares AS (
        SELECT state, count(*) AS fitted_rounds, sum(success) / CAST(sum(n) AS DOUBLE) AS share FROM short WHERE success IS NOT NULL AND n > 0 GROUP BY 1
    )
    SELECT state, rounds, size, fitted_rounds, {r6('share', 'share AS mean_fit', '0 AS constant', 'CASE WHEN size >= 2 THEN 0 END AS line', 'CASE WHEN size >= 3 THEN 0 END AS parabola')}
    FROM sized LEFT JOIN shares USING (state))""",
    "prepared",
)


def poststratified(dropped: str) -> str:
    return f"""SELECT *, {div('level', div('n_cases_state', 'pop_state'))} AS r, {div('level', div('n_cases_state', 'pop_state'))} * n_covid / pop AS p_immune FROM (
    SELECT *, CAST(coalesce(sum(n_covid) OVER g, 0) AS BIGINT) AS n_cases_state, CAST(sum(pop) OVER g AS BIGINT) AS pop_state,
    sum(mean_pred * pop) OVER g / sum(CASE WHEN mean_pred IS NOT NULL THEN pop END) OVER g AS level FROM (
    SELECT {week('date')} AS week, fips, CAST(trunc(avg(cases)) AS BIGINT) AS n_covid FROM cases_daily WHERE fips NOT IN ({dropped}) GROUP BY 1, 2)
    JOIN (SELECT fips, state FROM geo) USING (fips) JOIN population USING (fips) LEFT JOIN sero_fit USING (week, state)
    WINDOW g AS (PARTITION BY week, state)) WHERE mean_pred IS NOT NULL"""


check(
    "poststratify",
    f"SELECT week, fips, n_covid, state, pop, {r6('mean_pred')}, n_cases_state, pop_state, {r6('r', 'p_immune')} FROM ({poststratified('4, ' + EXCLUDED)})",
    "cases_daily",
    "geo",
    "population",
    "sero_fit",
)
view("post", poststratified("2997, " + EXCLUDED), "cases_daily", "geo", "population", "sero_fit")
view(
    "sigma_inputs",
    f"""SELECT week, fips, inc, coalesce(comp, 0) AS comp, coalesce(part, 0) AS part, coalesce(sero, 0) AS sero, se FROM (
    SELECT week, fips, inc, comp, part, {down('sero')} AS sero, {down('se')} AS se FROM (
    SELECT week, fips, {div('cases', 'pop')} AS inc, comp, part - comp AS part, p_immune AS sero, p_immune * (1 - p_immune) AS se
    FROM incidence LEFT JOIN (SELECT fips, pop FROM population) USING (fips) LEFT JOIN coverage USING (week, fips)
    LEFT JOIN (SELECT week, fips, p_immune FROM post) USING (week, fips)))""",
    "incidence",
    "population",
    "coverage",
    "post",
)
SIGMA = "inc + 0.8e0 * sero + comp + part - (0.8e0 * sero * comp + 0.8e0 * sero * part)"
VAR = "se * se * 0.64e0 * (1 + comp * comp + part * part)"
view("sigma", f"SELECT week, fips, least({SIGMA}, 1) + 0 * inc AS mean_sigma, sqrt({VAR}) AS se_sigma FROM sigma_inputs", "sigma_inputs")
check("immunity_share", f"SELECT week, fips, {r6('mean_sigma', 'se_sigma')} FROM sigma", "sigma")
view(
    "county_draws",
    f"""SELECT week, fips, mean, ((mean + 0.5e0 / (n + 1)) - (mean - 1e0 / (n + 1))) / 3.92e0 AS se FROM (
    SELECT {week('date')} AS week, fips, avg(CASE WHEN status = 'F' THEN 1e0 ELSE 0e0 END) AS mean, count(*) AS n FROM (
    SELECT c_nationkey AS fips, o_orderdate AS date, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2) WHERE n % 5 <> 0""",
)
# Both series are carried forward for themselves; then the state decides. The second source stays unknown before its first value.
view(
    "prevalence_series",
    f"""SELECT week, fips, state, inc, comp, part, {down('s_mean')} AS s_mean, {down('s_se')} AS s_se, {down('m_mean')} AS m_mean, {down('m_se')} AS m_se FROM (
    SELECT week, fips, state, {div('cases', 'pop')} AS inc, comp, part - comp AS part, p_immune AS s_mean, p_immune * (1 - p_immune) AS s_se, mean AS m_mean, se AS m_se
    FROM incidence LEFT JOIN (SELECT fips, pop FROM population) USING (fips) LEFT JOIN (SELECT fips, state FROM geo) USING (fips) LEFT JOIN coverage USING (week, fips)
    LEFT JOIN (SELECT week, fips, p_immune FROM post) USING (week, fips) LEFT JOIN county_draws USING (week, fips))""",
    "incidence",
    "population",
    "geo",
    "coverage",
    "post",
    "county_draws",
)
view(
    "prevalence_taken",
    """SELECT week, fips, inc, coalesce(comp, 0) AS comp, coalesce(part, 0) AS part,
    CASE WHEN model THEN m_mean WHEN state = 'EUROPE' THEN NULL ELSE coalesce(s_mean, 0) END AS sero,
    CASE WHEN model THEN m_se WHEN state <> 'EUROPE' THEN s_se END AS se,
    CASE WHEN model THEN 'model' WHEN state <> 'EUROPE' AND s_mean IS NOT NULL THEN 'survey' END AS source
    FROM (SELECT *, m_mean IS NOT NULL AND (state = 'EUROPE' OR (state = 'ASIA' AND week <= DATE '1995-06-18')) AS model FROM prevalence_series)""",
    "prevalence_series",
)
check("prevalence_sources", f"SELECT week, fips, {r6('sero AS mean_sero', 'se AS se_sero')}, source FROM prevalence_taken", "prevalence_taken")
check("immunity_two_sources", f"SELECT week, fips, {r6(f'least({SIGMA}, 1) + 0 * inc + 0 * sero AS mean_sigma', f'sqrt({VAR}) AS se_sigma')} FROM prevalence_taken", "prevalence_taken")
view(
    "sigma_mixed",
    f"""SELECT week, fips, inc, comp * coalesce(ec, 0.9e0) AS comp, part * coalesce(ep, 0.66e0) AS part, sero, se FROM (
    SELECT week, fips, inc, state, coalesce(comp, 0) AS comp, coalesce(part, 0) AS part, coalesce({down('sero')}, 0) AS sero, {down('se')} AS se FROM (
    SELECT week, fips, {div('cases', 'pop')} AS inc, state, l.complete AS comp, l.partial AS part, p_immune AS sero, p_immune * (1 - p_immune) AS se
    FROM incidence LEFT JOIN (SELECT fips, pop FROM population) USING (fips) LEFT JOIN (SELECT fips, state FROM geo) USING (fips) LEFT JOIN lagged l USING (week, fips)
    LEFT JOIN (SELECT week, fips, p_immune FROM post) USING (week, fips))) LEFT JOIN (SELECT week, state, partial AS ep, complete AS ec FROM effect) USING (week, state)""",
    "incidence",
    "population",
    "geo",
    "lagged",
    "post",
    "effect",
)
check(
    "immunity_effective",
    f"""SELECT week, coalesce(t, fips) AS fips, {r6(f'CASE WHEN {SIGMA} <= 1 THEN {SIGMA} END AS mean_sigma', f'sqrt(inc * inc / 100 + {VAR}) AS se_sigma')}
    FROM sigma_mixed LEFT JOIN (VALUES (7, 21), (7, 22)) m(u, t) ON u = fips""",
    "sigma_mixed",
)
check(
    "sigma_breakdown",
    f"""SELECT week, fips, {r6('complete', 'partial', 'CASE WHEN sero BETWEEN 0 AND 1 THEN sero END AS mean_sero', 'incidence', 'mean_sigma')} FROM (
    SELECT week, fips, mean_sigma, {down('complete')} AS complete, {down('partial')} AS partial, {down('p_immune')} AS sero, {div('cases', 'pop')} AS incidence
    FROM sigma LEFT JOIN lagged USING (week, fips) LEFT JOIN incidence USING (week, fips) LEFT JOIN (SELECT fips, pop FROM population) USING (fips)
    LEFT JOIN (SELECT week, fips, p_immune FROM post) USING (week, fips))""",
    "sigma",
    "lagged",
    "incidence",
    "population",
    "post",
)

# Reproduction

view(
    "r_ij",
    """SELECT o AS i, d AS j, e.week, e.p * ((1 - n_contact / 99) * coalesce(bg, 1) * coalesce(beta_mult, 1)) AS "R" FROM weekly_edges e
    LEFT JOIN (SELECT week, fips, n_contact, state FROM weekly_means JOIN geo USING (fips) WHERE n_sample % 11 <> 0) s ON s.week = e.week AND s.fips = d
    LEFT JOIN (SELECT fips, pop / 49000.0e0 AS bg FROM population WHERE fips % 9 <> 0) b ON b.fips = d
    LEFT JOIN multiplier m ON m.week = e.week AND m.state = s.state WHERE d <> 5""",
    "weekly_edges",
    "weekly_means",
    "geo",
    "population",
    "multiplier",
)
check("pair_reproduction", 'SELECT i, j, week, round("R" + 3.71e-10, 8) AS "mean_R" FROM r_ij', "r_ij")
check("total_reproduction", 'SELECT i, week, round(coalesce(sum("R"), 0) + 3.71e-10, 8) AS "R" FROM r_ij GROUP BY 1, 2', "r_ij")


def risk(source: str, least: int) -> str:
    return f"""SELECT j, week, round(own + imported / cases_j + 3.71e-10, 8) AS "Ri", cases_j FROM (
    SELECT j, r.week, max(CASE WHEN i = j THEN "R" END) AS own, coalesce(sum(CASE WHEN i <> j THEN "R" * cases END), 0) AS imported
    FROM {source} r LEFT JOIN incidence c ON c.fips = i AND c.week = r.week GROUP BY 1, 2)
    JOIN (SELECT fips AS j, week, cases AS cases_j FROM incidence) USING (j, week) WHERE cases_j > {least}"""


check("import_risk_of_shares", risk("r_ij", 0), "r_ij", "incidence")
check(
    "import_risk_variance",
    """SELECT j, week, round(own + imported / (cases_j::DOUBLE * cases_j) + 3.71e-10, 8) AS "var_Ri", cases_j FROM (
    SELECT j, r.week, max(CASE WHEN i = j THEN "R" * "R" / 100 END) AS own,
    coalesce(sum(CASE WHEN i <> j THEN ("R" * "R" / 100) * (cases::DOUBLE * cases) END), 0) AS imported
    FROM r_ij r LEFT JOIN incidence c ON c.fips = i AND c.week = r.week GROUP BY 1, 2)
    JOIN (SELECT fips AS j, week, cases AS cases_j FROM incidence) USING (j, week) WHERE cases_j > 1""",
    "r_ij",
    "incidence",
)
WEIGHTS = values([(s, w) for s, w in enumerate(serial_interval()) if s], "s, w")


def renewal(where: str) -> str:
    return f"""SELECT fips, week, t, cases, n, (1 + sc) / (0.2e0 + sl) AS "Rt", (1 + sc) / (0.2e0 + sl) / sqrt(1 + sc) AS sd FROM (
    SELECT *, count(*) OVER f AS n, sum(cases) OVER f AS sc, sum(lam) OVER f AS sl FROM (
    SELECT a.fips, a.week, a.t, a.cases, coalesce(sum(CAST(w AS DOUBLE) * b.cases), 0) AS lam
    FROM numbered a LEFT JOIN ({WEIGHTS}) ON true LEFT JOIN numbered b ON b.fips = a.fips AND b.t = a.t - s GROUP BY 1, 2, 3, 4)
    WINDOW f AS (PARTITION BY fips ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE n = 7 AND t >= 5""".replace(
        "numbered", f"(SELECT fips, week, cases, row_number() OVER (PARTITION BY fips ORDER BY week) AS t FROM incidence {where})"
    )


view("rt", renewal(""), "incidence")
check("renewal_rt", 'SELECT fips, week, round("Rt" + 3.71e-10, 8) AS "Rt", round(sd + 3.71e-10, 8) AS "Rt_sd", CAST(cases AS DOUBLE) AS incidence FROM rt', "rt")
check(
    "renewal_rt_reference",
    f"""SELECT fips, b.week, round("Rt" + 3.71e-10, 8) AS "Rt", round(sd + 3.71e-10, 8) AS "Rt_sd", CAST(b.cases AS DOUBLE) AS incidence FROM ({renewal("WHERE week > DATE '1996-04-01'")}) a
    JOIN (SELECT fips, week, cases, row_number() OVER (PARTITION BY fips ORDER BY week) AS t FROM incidence) b USING (fips, t)""",
    "incidence",
)
view(
    "estimates",
    f"""SELECT fips, {week('date')} AS week, avg(l_quantity / 25) AS "Rt", avg(l_discount * 20) AS "Ri", count(*) AS cases_j FROM lines GROUP BY 1, 2""",
    "lines",
)
view("risk", 'SELECT fips, week, CASE WHEN cases_j % 5 <> 0 THEN "Ri" END AS "Ri", cases_j FROM estimates', "estimates")
check(
    "bias_ratios",
    """SELECT fips, round(ri + 3.71e-10, 8) AS "R_risk", round(rt + 3.71e-10, 8) AS "Rt", round(rt / nullif(ri, 0) + 3.71e-10, 8) AS bg FROM (
    SELECT fips, avg("Ri") AS ri, avg("Rt") AS rt FROM risk FULL JOIN rt USING (fips, week)
    WHERE cases > 1 AND week > DATE '1996-12-01' AND week < DATE '1999-02-01' GROUP BY 1)""",
    "risk",
    "rt",
)
view("gappy_bias", "SELECT fips, pop / 50000.0e0 AS bg FROM population WHERE fips % 4 <> 1 AND fips < 20", "population")


def imputed(second: bool, observed: str) -> str:
    """First pass, state mean, optional second pass, the set's common value, state mean."""
    around = """(SELECT DISTINCT CASE WHEN fips IN (0, 1, 2) THEN 1 ELSE fips END AS fips, neighb FROM geo_neighbors)"""
    missing = f"(SELECT fips FROM geo WHERE fips NOT IN (SELECT fips FROM {observed} WHERE bg IS NOT NULL))"
    first = f"""(SELECT a.fips, avg(k.bg) AS bg FROM {around} a LEFT JOIN (SELECT CASE WHEN fips IN (0, 1, 2) THEN 1 ELSE fips END AS neighb, bg FROM {observed}) k
    USING (neighb) WHERE a.fips IN {missing} GROUP BY 1)"""
    full = f"""(SELECT fips, coalesce(bg, avg(bg) OVER (PARTITION BY state)) AS bg FROM (
    SELECT * FROM (SELECT * FROM {observed} UNION ALL SELECT * FROM {first}) QUALIFY NOT (count(*) OVER (PARTITION BY fips) > 1 AND bg IS NULL))
    LEFT JOIN geo USING (fips))"""
    if second:
        again = f"""(SELECT a.fips, avg(k.bg) AS bg FROM {around} a LEFT JOIN (SELECT CASE WHEN fips IN (0, 1, 2) THEN 1 ELSE fips END AS neighb, bg FROM {full}) k
        USING (neighb) WHERE a.fips IN (SELECT fips FROM {first} WHERE bg IS NULL) GROUP BY 1 HAVING avg(k.bg) IS NOT NULL)"""
        full = f"(SELECT * FROM {full} WHERE fips NOT IN (SELECT fips FROM {again}) UNION ALL SELECT * FROM {again})"
    return f"""SELECT fips, round(coalesce(bg, avg(bg) OVER (PARTITION BY state)) + 3.71e-10, 8) AS bg FROM (SELECT fips, state FROM geo) LEFT JOIN (
    SELECT fips, CASE WHEN fips IN (0, 1, 2) THEN (SELECT max(bg) FROM {full} WHERE fips = 1) ELSE bg END AS bg FROM {full}) USING (fips)"""


check("neighbor_impute", imputed(False, "gappy_bias"), "gappy_bias", "geo_neighbors", "geo")
check(
    "neighbor_impute_second",
    imputed(True, "(SELECT * FROM gappy_bias WHERE fips < 12)"),
    "gappy_bias",
    "geo_neighbors",
    "geo",
)
check(
    "state_fill",
    """SELECT fips, round(coalesce(bg, avg(bg) OVER (PARTITION BY state)) + 3.71e-10, 8) AS bg FROM (
    SELECT DISTINCT fips FROM weekly_means UNION SELECT fips FROM gappy_bias) LEFT JOIN gappy_bias USING (fips) JOIN geo USING (fips)""",
    "weekly_means",
    "gappy_bias",
    "geo",
)

# Venues

POI_NAMES = (
    "i AS raw_visitor_counts_Indoors", "o AS raw_visitor_counts_Outdoor", "im AS indoor_max_2019",
    "om AS outdoor_max_2019", "di AS median_dwell_Indoors", "dout AS median_dwell_Outdoor",
)
check(
    "poi_prepare",
    f"""SELECT fips, date, {r6(*POI_NAMES)} FROM (
    SELECT fips, date, i, o, di, dout, coalesce({up('im', 'fips', 'date')}, {down('im', 'fips', 'date')}) AS im, om FROM (
    SELECT fips, date, avg(i) AS i, avg(o) AS o, max(im) AS im, max(om) AS om, avg(di) AS di, avg(dout) AS dout FROM (
    SELECT fips, date, i, o, CASE WHEN month(date) = 5 THEN im END AS im, om, di, dout FROM poi_visits WHERE year(date) <= 1998
    UNION ALL SELECT fips, date, i, o + 1, CASE WHEN month(date) = 5 THEN im END, om, di, dout FROM poi_visits WHERE year(date) >= 1998) GROUP BY 1, 2))""",
    "poi_visits",
)
view(
    "poi",
    """SELECT fips, date, CASE WHEN fips % 2 = 1 THEN coalesce(i, 5) ELSE i END AS i, CASE WHEN fips % 2 = 1 THEN coalesce(o, 5) ELSE o END AS o,
    im, om, di, dout FROM poi_visits""",
    "poi_visits",
)
view(
    "small",
    """SELECT fips FROM geo WHERE fips NOT IN (SELECT fips FROM poi GROUP BY 1
    HAVING bool_and(coalesce(i >= 1 AND o >= 1 AND im >= 100 AND om >= 100, false)))""",
    "geo",
    "poi",
)
check("small_sample_places", "SELECT fips FROM small", "small")
POOL = "avg(i) AS ni, avg(o) AS no, avg(im) AS di, avg(om) AS dout"
view(
    "pool",
    f"""SELECT *, {div(div('ni', 'di'), div('no', 'dout'))} AS r FROM (
    SELECT n.fips, date, {POOL} FROM (SELECT DISTINCT fips, neighb FROM geo_neighbors) n JOIN poi p ON p.fips = n.neighb WHERE n.fips IN (SELECT fips FROM small) GROUP BY 1, 2
    UNION ALL SELECT a.fips, date, {POOL} FROM geo a JOIN geo b ON a.state = b.state JOIN poi p ON p.fips = b.fips
    WHERE a.fips NOT IN (SELECT fips FROM geo_neighbors) AND b.fips NOT IN (SELECT fips FROM geo_neighbors) AND a.fips IN (SELECT fips FROM small) GROUP BY 1, 2)""",
    "geo_neighbors",
    "poi",
    "geo",
    "small",
)
check(
    "neighbor_pool",
    f"SELECT fips, date, {r6('ni AS num_indoor', 'no AS num_outdoor', 'di AS denom_indoor', 'dout AS denom_outdoor', 'r')} FROM pool",
    "pool",
)


def centred(own: str, where: str) -> str:
    return f"""SELECT date, fips, round({div('r', 'm')} + 3.71e-10, 8) AS r FROM (SELECT *, avg(r) OVER (PARTITION BY fips) AS m FROM (
    SELECT date, fips, {own} AS r FROM poi WHERE fips NOT IN (SELECT fips FROM small) UNION ALL SELECT date, fips, r FROM pool)) {where}"""


check("indoor_outdoor", centred(div(div("i", "im"), div("o", "om")), ""), "poi", "small", "pool")
check(
    "indoor_outdoor_dwell",
    centred(div(div("i * di", "im"), div("o * dout", "om")), f"WHERE {div('r', 'm')} IS NOT NULL"),
    "poi",
    "small",
    "pool",
)
view(
    "contact_small",
    "SELECT fips FROM geo WHERE fips NOT IN (SELECT fips FROM poi_visits GROUP BY 1 HAVING bool_and(coalesce(i >= 1 AND o >= 1 AND im >= 1 AND om >= 1, false)))",
    "geo",
    "poi_visits",
)
view(
    "contact_pool",
    VIEWS["pool"][0].replace("JOIN poi p", "JOIN poi_visits p").replace("FROM small", "FROM contact_small"),
    "geo_neighbors",
    "poi_visits",
    "geo",
    "contact_small",
)
view(
    "contacts_scaled",
    f"""SELECT week, fips, r * fit AS fit, se AS se_fit FROM (
    SELECT week, fips, r, {down('fit')} AS fit, {down('se_fit')} AS se FROM (
    SELECT date AS week, fips, {div('r', 'm')} AS r FROM (SELECT *, avg(r) OVER (PARTITION BY fips) AS m FROM (
    SELECT date, fips, {div(div('i', 'im'), div('o', 'om'))} AS r FROM poi_visits WHERE fips NOT IN (SELECT fips FROM contact_small)
    UNION ALL SELECT date, fips, r FROM contact_pool))) LEFT JOIN contact_fit USING (week, fips)) WHERE r IS NOT NULL AND fit IS NOT NULL""",
    "poi_visits",
    "contact_small",
    "contact_pool",
    "contact_fit",
)
check("contact_rates", f"SELECT week, fips, {r6('fit', 'se_fit')} FROM contacts_scaled", "contacts_scaled")

# The whole chain: scaled contacts, edges of the last known week, sigma on the dense incidence

view("rates_scaled", "SELECT week, fips, fit, hh_size FROM contacts_scaled JOIN household USING (fips)", "contacts_scaled", "household")
view(
    "edges_asof",
    """SELECT c.week, o, d, prop FROM (
    SELECT c.week, max(s.week) AS source FROM (SELECT DISTINCT week FROM incidence) c JOIN (SELECT DISTINCT week FROM cleaned) s ON s.week <= c.week GROUP BY 1) c
    JOIN cleaned e ON e.week = c.source""",
    "incidence",
    "cleaned",
)
view("product_asof", product("SELECT week, o, d, prop AS v FROM edges_asof", "SELECT week, fips FROM rates_scaled", True), "edges_asof", "rates_scaled")
view(
    "r_full",
    f"""SELECT i, j, c.week, mean * ((1 - mean_sigma) * coalesce(beta_mult, 1)) AS "R" FROM ({coupled('product_asof', 'rates_scaled')}) c
    LEFT JOIN (SELECT week, fips, mean_sigma, state FROM sigma JOIN geo USING (fips)) s ON s.week = c.week AND s.fips = j
    LEFT JOIN multiplier m ON m.week = c.week AND m.state = s.state WHERE j <> 36005""",
    "product_asof",
    "rates_scaled",
    "sigma",
    "geo",
    "multiplier",
)
check("import_risk", risk("r_full", 2), "r_full", "incidence")

view("risk_of_chain", risk("r_full", 2).replace("round(own + imported / cases_j + 3.71e-10, 8)", "own + imported / cases_j"), "r_full", "incidence")
check(
    "chain_bias",
    f"""SELECT fips, {r6('round(ri, 6) AS "R_risk"', 'round(rt, 6) AS "Rt"', 'round(rt / nullif(ri, 0), 6) AS bg')} FROM (
    SELECT fips, avg("Ri") AS ri, avg("Rt") AS rt FROM (SELECT j AS fips, week, "Ri" FROM risk_of_chain) FULL JOIN rt USING (fips, week) WHERE cases > 1 GROUP BY 1)""",
    "risk_of_chain",
    "rt",
)

# Diagnostics

check(
    "estimates_joined",
    f"""SELECT fips, week, {r6('a."Rt" AS "Rt"', 'b."Ri" AS "Ri"')}, b.cases_j FROM
    (SELECT fips, week, CASE WHEN cases_j % 3 <> 0 THEN "Rt" END AS "Rt" FROM estimates) a FULL JOIN risk b USING (fips, week)""",
    "estimates",
    "risk",
)
check(
    "shifted_estimates",
    f"""SELECT a.fips, a.week, {r6('a."Ri" AS "Ri"')}, a.cases_j, {r6('b."Rt" AS "Rt"')} FROM (SELECT fips, week + 21 AS week, "Ri", cases_j FROM risk) a
    LEFT JOIN estimates b USING (fips, week)""",
    "risk",
    "estimates",
)


def z(x: str, by: str) -> str:
    return div(f"{x} - avg({x}) OVER (PARTITION BY {by})", f"stddev_samp({x}) OVER (PARTITION BY {by})")


BOTH = r6('"Rt" AS "Rt"', '"Ri" AS "Ri"')
check("z_estimates", f"SELECT fips, week, {BOTH}, cases_j, {r6(z('\"Rt\"', 'fips') + ' AS \"z_Rt\"', z('\"Ri\"', 'fips') + ' AS \"z_Ri\"')} FROM estimates", "estimates")
check(
    "forecast_errors",
    f"""SELECT fips, {r6('sum(a) AS sse_model', 'sum(b) AS sse_naive', 'sum(c) AS sse_moving')} FROM (
    SELECT fips, ("Ri" - "Rt") ** 2 AS a, ("Rt" - lag("Rt") OVER (PARTITION BY fips ORDER BY week)) ** 2 AS b, ("Rt" - {rolling('"Rt"', 'fips', 0, 2)}) ** 2 AS c
    FROM estimates WHERE "Rt" < 1.8 AND "Ri" < 1.8) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1""",
    "estimates",
)


def residual(source: str, by: str, extra: str = "") -> str:
    resid = '"Rt" - "Ri"'
    return f"""SELECT fips, week, {BOTH}, cases_j{extra}, {r6('resid', z('resid', by) + ' AS z_resid')} FROM (SELECT *, {resid} AS resid FROM ({source}))"""


check(
    "residuals_by_state",
    residual("SELECT * FROM estimates JOIN (SELECT fips, state FROM geo) USING (fips) WHERE cases_j > 5", "state", ", state"),
    "estimates",
    "geo",
)
SCALED = 'SELECT fips, week, "Rt", ' + div('"Ri"', 'avg("Ri") OVER (PARTITION BY fips)') + ' AS "Ri", cases_j{} FROM {}'
check("residuals_scaled", residual(SCALED.format("", "estimates WHERE cases_j > 5"), "fips"), "estimates")
check(
    "residuals_of_steps",
    residual(
        f"""SELECT fips, week, {div('step', 'avg(step) OVER (PARTITION BY fips)')} AS "Rt", "Ri", cases_j FROM (
        SELECT *, "Rt" - lag("Rt") OVER (PARTITION BY fips ORDER BY week) AS step FROM (
        SELECT fips, week, "Rt" + (week - DATE '1990-01-01') / 1000 AS "Rt", "Ri", cases_j FROM estimates))""",
        "fips",
    ),
    "estimates",
)
check(
    "residuals_by_region",
    residual(SCALED.format(", 'R' || (fips % 3) AS region", "estimates WHERE fips % 4 <> 0"), "region", ", region"),
    "estimates",
)
view(
    "granger",
    """SELECT fips, n, f, n - 3 AS v, atan(sqrt(f / (n - 3))) AS th FROM (SELECT fips, n, (n - 3) * r * r / (1 - r * r) AS f FROM (
    SELECT fips, n, (yx - yz * xz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM (
    SELECT fips, count(*) AS rows_, CAST(count(x) AS INTEGER) AS n, corr(y, x) AS yx, corr(y, z) FILTER (WHERE x IS NOT NULL) AS yz, corr(x, z) AS xz FROM (
    SELECT fips, "Rt" AS y, lag("Ri") OVER w AS x, lag("Rt") OVER w AS z FROM estimates WINDOW w AS (PARTITION BY fips ORDER BY week)) GROUP BY 1)
    WHERE rows_ > 25))""",
    "estimates",
)
view(
    "granger_p",
    """SELECT fips, n, f, greatest(0, 1 - CASE WHEN v % 2 = 1 THEN 2 / pi() * (th + CASE WHEN v = 1 THEN 0 ELSE sin(th) * cos(th) * s END) ELSE sin(th) * s END) AS p FROM (
    SELECT fips, n, f, v, th, sum(CASE WHEN v % 2 = 1 THEN exp(m * ln(4) + 2 * lgamma(m + 1) - lgamma(2 * m + 2)) ELSE exp(lgamma(2 * m + 1) - 2 * lgamma(m + 1) - m * ln(4)) END
    * cos(th) ** (2 * m)) AS s FROM granger, generate_series(0, 600) g(m) WHERE m <= CASE WHEN v % 2 = 1 THEN greatest((v - 3) // 2, 0) ELSE (v - 2) // 2 END GROUP BY 1, 2, 3, 4, 5)""",
    "granger",
)
check("granger_tests", 'SELECT fips, n, round(f + 3.71e-10, 8) AS "F", round(p + 3.71e-10, 8) AS p FROM granger_p', "granger_p")
check("granger_share", "SELECT round(avg(CASE WHEN p < 0.3 THEN 1.0e0 ELSE 0.0e0 END) + 3.71e-10, 8) AS share, count(p) AS n FROM granger_p", "granger_p")
check(
    "estimate_correlation",
    'SELECT state, count(*) AS n, round(corr("Ri", "Rt") + 3.71e-10, 8) AS rho FROM estimates JOIN geo USING (fips) GROUP BY 1',
    "estimates",
    "geo",
)
check(
    "linear_trend",
    """SELECT fips, CAST(regr_count("Rt", "Ri") AS BIGINT) AS n, round(regr_slope("Rt", "Ri") + 3.71e-10, 8) AS slope,
    round(regr_intercept("Rt", "Ri") + 3.71e-10, 8) AS intercept, round(regr_r2("Rt", "Ri") + 3.71e-10, 8) AS r2 FROM estimates GROUP BY 1""",
    "estimates",
)

# A smooth of equal weights on a full calendar is one matrix for all places


def spline_values(steps: int, knots: int) -> np.ndarray:
    """The cubic basis by truncated powers: fourth differences of cubes, not the recursion that the library uses."""
    t, h = np.arange(1.0, steps + 1), (steps - 1) / (knots - 3)
    return np.stack([sum(c * np.maximum((t - 1) / h - (j - 3 + k), 0) ** 3 for k, c in enumerate((1, -4, 6, -4, 1))) / 6 for j in range(knots)], axis=1)


def rough(gram: np.ndarray, penalty: float, ridge: float = 0.0) -> np.ndarray:
    d = np.diff(np.eye(len(gram)), n=2, axis=0)
    return penalty * np.trace(gram) / len(gram) * (d.T @ d + ridge * np.eye(len(gram)))


def smoother(steps: int, knots: int, penalty: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The matrix from values to fits, that of the fit's variance for a unit of noise, and its trace."""
    basis = spline_values(steps, knots)
    gram = basis.T @ basis
    inverse = np.linalg.inv(gram + rough(gram, penalty))
    return basis @ inverse @ basis.T, np.einsum("ij,jk,ik->i", basis, inverse, basis), float(np.trace(inverse @ gram))


def joint_smoother(steps: int, members: int, wide: int, narrow: int, ridge: float, group_penalty: float, entity_penalty: float):
    """Matrices from the sum over a group's members to its trend, and from what the trend leaves to a deviation."""
    trend, own = spline_values(steps, wide), spline_values(steps, narrow)
    gram, own_gram, cross = trend.T @ trend, own.T @ own, trend.T @ own
    own_inverse = np.linalg.inv(own_gram + rough(own_gram, entity_penalty, ridge))
    whole = members * (gram - cross @ own_inverse @ cross.T) + rough(members * gram, group_penalty)
    return trend @ np.linalg.solve(whole, trend.T - cross @ own_inverse @ own.T), own @ own_inverse @ own.T


SMOOTHER, UNIT_VARIANCE, FREEDOM = smoother(80, 12, 0.5)
check(
    "spline_fixed_penalty",
    f"""SELECT * FROM (WITH dense AS (
        SELECT fips, t, coalesce(y, 0) AS y FROM (SELECT fips, t FROM geo, range(1, 81) AS r(t)) LEFT JOIN (
        SELECT fips, 12 * (year(date) - 1995) + month(date) AS t, CAST(count(*) AS DOUBLE) AS y FROM reports GROUP BY 1, 2) USING (fips, t)
    ), matrix AS ({values([(i + 1, j + 1, float(SMOOTHER[i, j])) for i in range(80) for j in range(80)], 'i, j, s')}
    ), unit AS ({values([(i + 1, float(x)) for i, x in enumerate(UNIT_VARIANCE)], 'i, u')}
    ), fitted AS (SELECT fips, i, sum(CAST(s AS DOUBLE) * y) AS fit FROM dense JOIN matrix ON j = t GROUP BY 1, 2
    ), noise AS (SELECT fips, sum(y * y) - 2 * sum(y * fit) + sum(fit * fit) AS rss FROM fitted JOIN dense USING (fips) WHERE i = t GROUP BY 1)
    SELECT fips, CAST(i AS INTEGER) AS t, {r6('round(fit, 5) AS fit', f'round(sqrt(CAST(u AS DOUBLE) * rss / (80 - {FREEDOM!r})), 5) AS se_fit')} FROM fitted JOIN unit USING (i) JOIN noise USING (fips))""",
    "geo",
    "reports",
)

QUARTERS = 27
TRENDS = {n: joint_smoother(QUARTERS, n, 10, 6, 0.5, 0.3, 0.8) for n in (4, 5)} | {1: (smoother(QUARTERS, 8, 0.3)[0], np.zeros((QUARTERS, QUARTERS)))}
check(
    "panel_fixed_penalty",
    f"""SELECT * FROM (WITH dense AS (
        SELECT CASE WHEN fips = 3 THEN 'ALONE' ELSE state END AS state, fips, t, coalesce(y, 0) AS y FROM (SELECT fips, state, t FROM geo, range(1, 28) AS r(t)) LEFT JOIN (
        SELECT fips, (12 * (year(date) - 1995) + month(date) - 1) // 3 + 1 AS t, CAST(count(*) AS DOUBLE) AS y FROM reports WHERE date < DATE '2001-09-01' GROUP BY 1, 2) USING (fips, t)
    ), matrix AS ({values([(n, i + 1, j + 1, float(f[i, j]), float(h[i, j])) for n, (f, h) in TRENDS.items() for i in range(QUARTERS) for j in range(QUARTERS)], 'members, i, j, f, h')}
    ), groups AS (SELECT state, count(DISTINCT fips) AS members FROM dense GROUP BY 1
    ), sums AS (SELECT state, t, sum(y) AS y FROM dense GROUP BY 1, 2
    ), trend AS (SELECT state, i, sum(CAST(f AS DOUBLE) * y) AS fit FROM sums JOIN groups USING (state) JOIN matrix m ON m.members = groups.members AND j = t GROUP BY 1, 2
    ), own AS (
        SELECT d.state, d.fips, m.i, sum(CAST(h AS DOUBLE) * (d.y - r.fit)) AS fit FROM dense d JOIN trend r ON r.state = d.state AND r.i = d.t
        JOIN groups g ON g.state = d.state JOIN matrix m ON m.members = g.members AND m.j = d.t GROUP BY 1, 2, 3)
    SELECT own.state, fips, CAST(own.i AS INTEGER) AS t, {r6('round(own.fit + trend.fit, 5) AS fit')} FROM own JOIN trend ON trend.state = own.state AND trend.i = own.i)""",
    "geo",
    "reports",
)
