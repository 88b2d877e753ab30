"""Domain operators on hand-made rows, one per special case."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilattice.operators import (
    bias,
    coupling,
    diagnostics,
    immunity,
    incidence,
    mobility,
    renewal,
    reproduction,
    serology,
    smoothing,
    variants,
    venues,
)

SUNDAY = datetime.date(2021, 1, 3)


def week(k):
    return SUNDAY + datetime.timedelta(7 * k)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_weekly_incidence(table):
    """Corrections net inside a week, a negative week is zero, absent weeks are zero, codes drop."""
    d = lambda k: SUNDAY + datetime.timedelta(k)
    df = table(
        [(1, d(0), 10), (1, d(1), 15), (1, d(2), 12), (1, d(7), 9), (2, d(0), 5), (72001, d(0), 9), (None, d(0), 4)],
        "fips int, date date, cases long",
    )
    got = rows(incidence.weekly_incidence(df))
    assert got == [(1, week(0), 2), (1, week(1), 0), (2, week(0), 0), (2, week(1), 0)]
    assert rows(incidence.weekly_incidence(df.union(df).repartition(7))) == got


def test_merged_population_is_added_first(table):
    cases = table([(2998, SUNDAY, 1), (2998, SUNDAY + datetime.timedelta(1), 4)], "fips int, date date, cases long")
    pop = table([(2282, 579.0), (2105, 2148.0)], "fips int, pop double")
    geo = table([(1, "AL")], "fips int, state string")
    got = incidence.weekly_incidence(cases, population=pop, geo=geo).collect()
    assert [(r.cases, r.pop, r.state) for r in got] == [(3, 2727, "AK")]


EDGE = "origin_county_fips int, destination_county_fips int, date date, num_visits double, origin_total_num_visits double"


def daily_edges(pair, visits, total=100.0):
    return [(*pair, week(k), float(x), total) for k, x in enumerate(visits)]


def test_clean_edges_null_policy(table):
    """A pair without spread poisons its origin-weeks under 'strict' only."""
    data = daily_edges((1, 1), [20, 30, 40, 50]) + daily_edges((1, 2), [20, 20, 20, 20]) + daily_edges((2, 1), [11, 12, 13, 14])
    df = table(data, EDGE)
    strict = mobility.clean_edges(df)
    assert {r.origin_county_fips for r in strict.collect()} == {2}
    skip = mobility.clean_edges(df, null_policy="skip")
    assert {r.origin_county_fips for r in skip.collect()} == {1, 2}
    sums = skip.groupBy("origin_county_fips", "week").agg(F.sum("prop_population").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)


def test_clean_edges_filters(table):
    data = daily_edges((1, 2), [20, 30, 40]) + daily_edges((1, 3), [5, 6, 7, 8]) + daily_edges((1, 4), [20, 30, 40, 50])
    got = mobility.clean_edges(table(data, EDGE)).collect()
    assert {r.destination_county_fips for r in got} == {4}
    allowed = table([(1,), (2,)], "fips int")
    assert mobility.clean_edges(table(data, EDGE), allowed, min_obs=2).select("destination_county_fips").distinct().collect()[0][0] == 2


def test_clean_edges_deals_rows_twice(table):
    """By pair and by origin and week; neither the statistics nor the removal of repeats deals rows again."""
    df = table(daily_edges((1, 2), [20, 30, 40, 50]), EDGE)
    assert len(re.findall(r"Exchange hashpartitioning", mobility.clean_edges(df)._jdf.queryExecution().executedPlan().toString())) == 2


def test_clean_edges_repeats(table):
    """Equal rows of a week count in the statistics and collapse at the end only."""
    data = daily_edges((1, 2), [20, 30, 40, 50]) * 2 + daily_edges((1, 3), [10.5, 12, 14, 18])
    kept = mobility.clean_edges(table(data, EDGE), dedupe=False)
    assert kept.count() == 12 and mobility.clean_edges(table(data, EDGE)).count() == 8
    sums = kept.groupBy("week").agg(F.sum("prop_population").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)
    assert mobility.clean_edges(table([], EDGE)).count() == 0


def test_winsorised(table):
    visits = [20.0 + k % 3 for k in range(30)] + [95.0]
    p = np.array(visits) / 100
    top = p.mean() + 3 * p.std(ddof=1)
    data = daily_edges((1, 1), visits) + daily_edges((1, 2), [30.0 + k % 2 for k in range(31)])
    got = mobility.clean_edges(table(data, EDGE)).filter(F.col("week") == week(30)).filter("destination_county_fips = 1").first()
    assert abs(got.prop_population - top / (top + 0.30)) < 1e-12


def dense_coupling(a, c, hh, stored):
    n = len(a)
    out = {}
    for i in range(n):
        for j in range(n):
            ks = [k for k in range(n) if stored[i, k] and stored[j, k]]
            if ks:
                s = sum(a[i, k] * a[j, k] for k in ks)
                out[i, j] = c[i] * s + (hh[i] * a[i, i] ** 2 if i == j else 0)
    return out


@pytest.mark.parametrize("blocks", [(256, 4096), (3, 4), (1, 1)])
@pytest.mark.parametrize("loops", ["all", "some"])
def test_coupling_equals_dense_product(spark, blocks, loops):
    rng = np.random.default_rng(3)
    n = 9
    stored = rng.random((n, n)) < 0.4
    np.fill_diagonal(stored, True)
    if loops == "some":
        stored[2, 2] = stored[5, 5] = False
    a = np.where(stored, rng.random((n, n)), 0)
    a[stored & np.eye(n, dtype=bool)] += 0.5
    edges = spark.createDataFrame(
        [(week(0), i, k, float(a[i, k])) for i in range(n) for k in range(n) if stored[i, k]],
        "week date, origin_county_fips int, destination_county_fips int, prop_population double",
    )
    c, hh = rng.random(n) + 1, rng.random(n) + 1
    contact = spark.createDataFrame([(week(0), i, float(c[i])) for i in range(n)], "week date, fips int, fit double")
    household = spark.createDataFrame([(i, float(hh[i])) for i in range(n)], "fips int, hh_size double")
    expect = dense_coupling(a, c, hh, stored)
    zero = coupling.coupling(edges, contact, household, 0, 0, *blocks)
    got = {(r.i, r.j): r["mean"] for r in zero.collect()}
    assert got.keys() == {k for k, x in expect.items() if x > 0}
    assert all(abs(got[k] - expect[k]) < 1e-12 for k in got)
    null = {(r.i, r.j) for r in coupling.coupling(edges, contact, household, 0, "null", *blocks).collect()}
    used = stored.any(0) | stored.any(1)
    lost = {k for k in range(n) if used[k] and not stored[k, k]}
    touched = {(i, j) for i, j in expect if any((i == m and (stored[j, m] or j == m)) or (j == m and (stored[i, m] or i == m)) for m in lost)}
    assert null == set(got) - touched


def test_repeated_edges_are_added(table):
    edges = table(
        [(week(0), 1, 1, 0.2), (week(0), 1, 1, 0.3)],
        "week date, origin_county_fips int, destination_county_fips int, prop_population double",
    )
    contact = table([(week(0), 1, 2.0)], "week date, fips int, fit double")
    got = coupling.coupling(edges, contact, table([(1, 3.0)], "fips int, hh_size double")).collect()
    assert abs(got[0]["mean"] - (2 * 0.25 + 3 * 0.25)) < 1e-12


def test_lineages(table):
    g = table(
        [
            (SUNDAY, "North America / USA / Ohio", "VOC Alpha x", "B.1"),
            (SUNDAY, "North America / USA / Ohio", "VOC Alpha x", "BA.1"),
            (SUNDAY, "North America / USA / Ohio", "", "B.1"),
            (SUNDAY, "North America / USA / Ohio", "VOC Alpha x", None),
            (SUNDAY, "North America / Canada / Ohio", "VOC Alpha x", "B.1"),
            (SUNDAY, "North America / USA", "VOC Alpha x", "B.1"),
        ],
        "collection_date date, location string, variant string, pango_lineage string",
    )
    shares = variants.lineage_shares(g)
    assert {r.lineage: r.p for r in shares.collect()} == {"alpha": 0.25, "omicron": 0.25, "other": 0.25, None: 0.25}
    assert variants.transmissibility_multiplier(shares).first().beta_mult is None
    known = shares.filter(F.col("lineage").isNotNull())
    assert abs(variants.transmissibility_multiplier(known).first().beta_mult - (1.5 + 4.65 + 1) / 4) < 1e-12


def test_genomes_are_read_once(spark):
    """Totals that nobody uses do not bring back the records: they are no part of the plan once they are counted."""
    state = F.element_at(F.array(F.lit("Ohio"), F.lit("nan"), F.lit("Utah")), (F.col("id") % 3 + 1).cast("int"))
    name = F.element_at(F.array(F.lit("Alpha"), F.lit("Mu")), (F.col("id") % 2 + 1).cast("int"))
    records = spark.range(12).select(
        F.lit(SUNDAY).cast("date").alias("collection_date"), F.concat(F.lit("North America / USA / "), state).alias("location"),
        F.concat(F.lit("VOC "), name, F.lit(" x")).alias("variant"), F.lit("B.1").alias("pango_lineage"),
    )
    collapsed = variants.collapse_lineages(variants.lineage_shares(records))
    assert "Range" not in collapsed._jdf.queryExecution().optimizedPlan().toString()
    assert rows(collapsed.select("state", "lineage", "n", "n_total")) == [(s, x, 2, 4) for s in ("Ohio", "Utah") for x in ("alpha", "other")]


def test_lineages_of_odd_records(table):
    """Records without a state or with a name that stands for none are left out; missing and repeated values are counted."""
    ohio = "North America / USA / Ohio"
    g = table(
        [
            *2 * [(SUNDAY, ohio, None, "B.1")],
            *2 * [(None, ohio, "VOC Alpha x", "BA.1")],
            (SUNDAY, None, "VOC Alpha x", "B.1"),
            (SUNDAY, "North America / USA / nan", "VOC Alpha x", "B.1"),
            (SUNDAY, "North America / USA / ", "VOC Alpha x", "B.1"),
            (SUNDAY, "North America / USA / Southwest", "VOC Alpha x", "B.1"),
            (SUNDAY, f"{ohio} / Stark", "VOC Alpha x", "B.1"),
        ],
        "collection_date date, location string, variant string, pango_lineage string",
    )
    shares = variants.lineage_shares(g)
    got = {(r.state, r.week, r.lineage, r.n, r.n_total) for r in shares.collect()}
    assert got == {("Ohio", SUNDAY, None, 2, 3), ("Ohio", SUNDAY, "alpha", 1, 3), ("Ohio", None, "omicron", 2, 2)}
    assert shares.count() == 3
    assert variants.lineage_shares(g.limit(0)).collect() == []


def test_immunity_of_nothing_is_zero(table):
    inc = table([(week(0), 1, 0.0), (week(0), 2998, 0.1), (week(1), 1, None)], "week date, fips int, mean_incidence double")
    cov = table([(week(0), 2, 0.1, 0.1)], "week date, fips int, complete double, partial double")
    sero = table([(week(0), 2, 0.1)], "week date, fips int, p_immune double")
    got = rows(immunity.immunity(inc, cov, sero).select("fips", "week", "mean_sigma"))
    assert got == [(1, week(0), 0.0), (1, week(1), None), (2105, week(0), 0.1), (2282, week(0), 0.1)]


def test_immunity_carries_seroprevalence(table):
    inc = table([(week(k), 1, 0.0) for k in range(3)], "week date, fips int, mean_incidence double")
    cov = table([(week(1), 1, 0.5, 0.9)], "week date, fips int, complete double, partial double")
    sero = table([(week(0), 1, 0.5)], "week date, fips int, p_immune double")
    got = [r.mean_sigma for r in immunity.immunity(inc, cov, sero).orderBy("week").collect()]
    assert np.allclose(got, [0.4, min(1, 0.4 + 1.4 - 0.4 * 1.4), 0.4])
    cut = [r.mean_sigma for r in immunity.immunity(inc, cov, sero, cap="null").orderBy("week").collect()]
    assert np.allclose(cut[0], 0.4) and cut[1] is None


R = "i int, j int, week date, mean_R double"


def test_import_risk(table):
    r = table([(1, 1, SUNDAY, 0.5), (2, 1, SUNDAY, 0.2), (1, 2, SUNDAY, 0.9), (2, 1, SUNDAY, 0.2), (3, 3, SUNDAY, 0.7), (4, 1, SUNDAY, 0.3)], R)
    cases = table([(1, SUNDAY, 20), (2, SUNDAY, 40), (3, SUNDAY, 10)], "fips int, week date, cases long")
    got = rows(reproduction.import_risk(r, cases).select("j", "Ri", "cases_j"))
    assert got[0][0] == 1 and abs(got[0][1] - 0.9) < 1e-12
    assert got[1] == (2, None, 40)
    assert len(got) == 2


def test_import_risk_of_a_diagonal(table):
    r = table([(k, k, SUNDAY, 0.1 * k) for k in range(1, 5)], R)
    cases = table([(k, SUNDAY, 50) for k in range(1, 5)], "fips int, week date, cases long")
    assert np.allclose([x.Ri for x in reproduction.import_risk(r, cases).orderBy("j").collect()], [0.1, 0.2, 0.3, 0.4])


def test_serial_interval():
    w = renewal.serial_interval()
    assert np.allclose(w[:5], [0, 0.082631, 0.170212, 0.148394, 0.122420], atol=1e-6)
    assert abs(sum(w) - 1) < 1e-10 and abs(sum(k * x for k, x in enumerate(w)) - 5.5) < 1e-8
    assert abs(sum(w[41:]) - 6.4e-5) < 1e-6


def brute_rt(cases):
    w = renewal.serial_interval(length=len(cases))
    lam = [sum(w[s] * cases[t - s] for s in range(1, t + 1)) for t in range(len(cases))]
    out = {}
    for t in range(1, len(cases) - 6):
        shape = 1 + sum(cases[t : t + 7])
        mean = shape / (0.2 + sum(lam[t : t + 7]))
        out[t + 3] = (mean, mean / shape**0.5)
    return out


def test_renewal(table):
    rng = np.random.default_rng(1)
    cases = [int(x) for x in rng.poisson(30, 60)]
    df = table([(1, week(k), x) for k, x in enumerate(cases)] + [(2, week(k), 100) for k in range(80)], "fips int, week date, cases long")
    got = renewal.renewal_rt(df).orderBy("fips", "week").collect()
    expect = brute_rt(cases)
    mine = {(r.week - SUNDAY).days // 7: (r.Rt, r.Rt_sd) for r in got if r.fips == 1}
    assert mine.keys() == expect.keys()
    assert all(np.allclose(mine[k], expect[k], rtol=1e-10) for k in mine)
    assert abs([r.Rt for r in got if r.fips == 2][-1] - 1.001) < 2e-3


def test_renewal_alignment(table):
    df = table([(1, week(k), 20 + k % 5) for k in range(40)], "fips int, week date, cases long")
    start = week(4).isoformat()
    window = renewal.renewal_rt(df, start=start).orderBy("week").collect()
    reference = renewal.renewal_rt(df, start=start, align="reference").orderBy("week").collect()
    assert [r.Rt for r in window] == [r.Rt for r in reference]
    assert (window[0].week - reference[0].week).days == 35


def test_neighbor_impute(table):
    geo = table([(k, f"n{k}", "A" if k < 4 else "B") for k in range(1, 7)], "fips int, name string, state string")
    values = table([(1, 1.0), (2, 3.0), (5, 8.0)], "fips int, bg double")
    around = table([(3, 1), (3, 2), (4, 6), (6, 4)], "fips int, neighb int")
    got = dict(rows(bias.neighbor_impute(values, around, geo, collapse=[], collapse_key=0)))
    assert got == {1: 1.0, 2: 3.0, 3: 2.0, 4: 8.0, 5: 8.0, 6: 8.0}
    city = dict(rows(bias.neighbor_impute(values, around, geo, collapse=[1, 2], collapse_key=1)))
    assert city[2] == 1.0 and city[3] == 2.0


def test_venues(table):
    cols = f"fips int, date date, {venues.IN} double, {venues.OUT} double, {venues.IN_MAX} double, {venues.OUT_MAX} double, {venues.IN_DWELL} double, {venues.OUT_DWELL} double"
    raw = table(
        [(1, week(0), 200.0, 100.0, 400.0, 400.0, 1.0, 2.0), (1, week(1), 300.0, 100.0, None, None, 1.0, 2.0), (2, week(0), 50.0, 100.0, 400.0, 400.0, 1.0, 1.0)],
        cols,
    )
    poi = venues.poi_prepare(raw)
    geo = table([(1, "a", "S"), (2, "b", "S"), (3, "c", "S")], "fips int, name string, state string")
    around = table([(2, 1), (1, 2)], "fips int, neighb int")
    assert rows(venues.small_sample_set(poi, geo)) == [(2,), (3,)]
    got = {(r.fips, r.date): r.r for r in venues.indoor_outdoor_ratio(poi, around, geo).collect()}
    assert np.allclose([got[1, week(0)], got[1, week(1)]], [0.8, 1.2])
    assert np.allclose([got[2, week(0)], got[2, week(1)]], [0.8, 1.2])


def test_granger_equals_least_squares(table):
    rng = np.random.default_rng(2)
    n = 40
    x, y = rng.normal(size=n), rng.normal(size=n)
    df = table([(1, week(k), float(y[k]), float(x[k])) for k in range(n)], "fips int, week date, Rt double, Ri double")
    got = diagnostics.granger(df).first()
    full = np.column_stack([np.ones(n - 1), y[:-1], x[:-1]])
    rss = [((y[1:] - m @ np.linalg.lstsq(m, y[1:], rcond=None)[0]) ** 2).sum() for m in (full[:, :2], full)]
    assert got.n == n - 1 and abs(got.F - (rss[0] - rss[1]) / (rss[1] / (n - 4))) < 1e-9


def test_forecast_errors(table):
    rt = [1.0, 2.0, 4.0, 3.0]
    df = table([(1, week(k), x, 1.0) for k, x in enumerate(rt)], "fips int, week date, Rt double, Ri double")
    got = diagnostics.compare_forecasts(df).first()
    assert np.allclose([got.sse_model, got.sse_naive, got.sse_moving], [1.0, 1.0, 1.0])


def test_spline_recovers_a_smooth_curve(spark, table):
    t = np.arange(1, 101)
    y = np.sin(t / 15)
    df = table([(k, int(a), float(b + k)) for k in (1, 2) for a, b in zip(t, y) if (a + k) % 4], "k int, t int, y double")
    got = smoothing.spline_smooth(df, "k", "t", "y", knots=15).orderBy("k", "t").collect()
    assert len(got) == 200
    assert max(abs(r.fit - (np.sin(r.t / 15) + r.k)) for r in got) < 0.01


def test_spline_equals_dense_solve(table):
    rng = np.random.default_rng(4)
    t, y, w = np.arange(20.0), rng.normal(size=20), rng.random(20) + 0.5
    df = table([(1, int(a), float(b), float(c)) for a, b, c in zip(t, y, w)], "k int, t int, y double, w double")
    got = [r.fit for r in smoothing.spline_smooth(df, "k", "t", "y", knots=8, penalty=0.5, weight="w").orderBy("t").collect()]
    b = smoothing.cubic_basis(t, 0, 19, 8)
    assert np.allclose(b.sum(1), 1)
    gram = b.T @ np.diag(w) @ b
    beta = np.linalg.solve(gram + 0.5 * np.trace(gram) / 8 * smoothing.roughness(8), b.T @ (w * y))
    assert np.allclose(got, b @ beta, atol=1e-8)


def test_binomial_smooth(table):
    t = np.arange(1, 31)
    p = 1 / (1 + np.exp(-(t - 15) / 6))
    df = table([("A", int(a), int(round(1000 * b)), 1000) for a, b in zip(t, p)], "state string, t int, s int, n int")
    got = smoothing.binomial_smooth(df, "state", "t", "s", "n", knots=6).orderBy("t").collect()
    assert max(abs(r.fit - x) for r, x in zip(got, p)) < 0.02


@pytest.mark.parametrize("size", range(1, 10))
def test_basis_of_every_size(size):
    x = np.linspace(2, 9, 50)
    b = smoothing.spline_basis(x, 2, 9, size)
    assert b.shape == (50, size) and np.allclose(b.sum(1), 1) and (b >= -1e-12).all()
    for power in range(min(size, 4)):
        beta = np.linalg.lstsq(b, x**power, rcond=None)[0]
        assert np.allclose(b @ beta, x**power)


def test_banded_solve_equals_dense_solve():
    rng = np.random.default_rng(5)
    full = np.stack([b.T @ b + 0.1 * np.eye(7) for b in (smoothing.spline_basis(rng.random(30), 0, 1, 7) for _ in range(6))]).reshape(2, 3, 7, 7)
    a = np.stack([smoothing.bands(m) for m in full.reshape(6, 7, 7)]).reshape(2, 3, smoothing.BAND, 7)
    right, lower = rng.normal(size=(2, 3, 7, 2)), smoothing.banded_cholesky(a)
    assert np.allclose(smoothing.banded_solve(lower, right), np.linalg.solve(full, right))
    assert np.allclose(smoothing.banded_product(a, right[..., 0]), (full @ right)[..., 0])


def test_series_of_one_batch_do_not_touch(table, monkeypatch):
    """Alone, together, or in slices of a batch: the same fits, also for a series with a single value."""
    rng = np.random.default_rng(6)
    rows = [(k, t, float(rng.normal())) for k in range(7) for t in range(1, 25) if k < 6 or t == 3]
    whole = {(r.k, r.t): (r.fit, r.se_fit) for r in smoothing.spline_smooth(table(rows, "k int, t int, y double"), "k", "t", "y").collect()}
    monkeypatch.setattr(smoothing, "BATCH_CELLS", 1)
    sliced = {(r.k, r.t): (r.fit, r.se_fit) for r in smoothing.spline_smooth(table(rows, "k int, t int, y double"), "k", "t", "y").collect()}
    one = [(k, t, y) for k, t, y in rows if k == 2]
    alone = {(r.k, r.t): (r.fit, r.se_fit) for r in smoothing.spline_smooth(table(one, "k int, t int, y double"), "k", "t", "y").collect()}
    assert len(whole) == 7 * 24 and np.allclose([whole[key] for key in sorted(whole)], [sliced[key] for key in sorted(whole)])
    assert np.allclose([whole[key] for key in sorted(alone)], [alone[key] for key in sorted(alone)])
    assert all(np.isfinite(whole[6, t][0]) for t in range(1, 25))


def test_binomial_smooth_with_sizes_of_its_own(table):
    """Without penalty the score equations hold: what is left of the successes is orthogonal to the basis."""
    rng, sizes = np.random.default_rng(7), {"A": 1, "B": 2, "C": 3, "D": 5, "E": 7}
    rows = [(k, t, int(rng.binomial(200, 0.2 + 0.01 * t)), 200) for k in sizes for t in range(1, 31) if (t + len(k)) % 3]
    df = table(rows, "k string, t int, s int, n int")
    got = smoothing.binomial_smooth(df, "k", "t", "s", "n", penalty=0.0, sizes=table(list(sizes.items()), "k string, size int")).collect()
    fit = {(r.k, r.t): r.fit for r in got}
    seen = np.array(sorted({r[1] for r in rows}), float)
    assert len(got) == 5 * len(seen)
    for k, size in sizes.items():
        mine = [(t, s, n) for key, t, s, n in rows if key == k]
        left = np.array([s - n * fit[k, t] for t, s, n in mine])
        assert np.abs(smoothing.spline_basis(np.array([t for t, _, _ in mine], float), seen.min(), seen.max(), size).T @ left).max() < 1e-6


def test_few_rounds_take_fewer_functions(table, day):
    rows = [(s, day("2021-01-03") + datetime.timedelta(weeks=t), t, 5.0 if t <= r else None, 20 + t if t <= r else None, 100 if t <= r else None) for s, r in (("A", 2), ("B", 4), ("C", 7), ("D", 10), ("E", 11)) for t in range(1, 13)]
    df = table(rows, "state string, week date, t int, mean_sero double, success int, n int")
    sizes = {r.state: (r.rounds, r["size"]) for r in serology.basis_sizes(df).collect()}
    assert sizes == {"A": (2, 1), "B": (4, 1), "C": (7, 4), "D": (10, 7), "E": (11, 5)}
    fit = serology.serosurvey_smooth(df, penalty=0.0)
    assert fit.count() == 5 * 12
    assert {round(r.mean_pred, 9) for r in fit.filter("state = 'B'").collect()} == {round((21 + 22 + 23 + 24) / 400, 9)}


def test_panel_smooth_is_dense(table):
    data = [("A", k, t, 5.0 + k + 0.1 * t, 10.0) for k in (1, 2) for t in range(1, 31) if not (k == 2 and t % 5 == 0)]
    df = table(data, "state string, fips int, t int, y double, w double")
    got = smoothing.panel_smooth(df, "state", "fips", "t", "y", "w", 8, 6)
    assert got.count() == 60
    worst = got.select(F.max(F.abs(F.col("fit") - (5 + F.col("fips") + 0.1 * F.col("t"))))).first()[0]
    assert worst < 0.15


def dense_panel(rows, group_knots, entity_knots, ridge, group_penalty, entity_penalty):
    """The joint problem of one group as a dense matrix: fits by (entity, step), and the least sum."""
    entities, t = sorted({r[1] for r in rows}), np.array([r[2] for r in rows], float)
    y, w = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    steps = np.array(sorted({r[2] for r in rows}), float)
    trend = lambda at: smoothing.spline_basis(at, steps.min(), steps.max(), group_knots)
    own = lambda at: smoothing.spline_basis(at, steps.min(), steps.max(), entity_knots)
    size = group_knots + len(entities) * entity_knots
    design, penalty = np.zeros((len(rows), size)), np.zeros((size, size))
    design[:, :group_knots] = trend(t)
    gram = trend(t).T @ (w[:, None] * trend(t))
    penalty[:group_knots, :group_knots] = group_penalty * np.trace(gram) / group_knots * smoothing.roughness(group_knots)
    for e, name in enumerate(entities):
        mine, at = np.array([r[1] == name for r in rows]), slice(group_knots + e * entity_knots, group_knots + (e + 1) * entity_knots)
        design[mine, at] = own(t[mine])
        gram = own(t[mine]).T @ (w[mine, None] * own(t[mine]))
        penalty[at, at] = entity_penalty * np.trace(gram) / entity_knots * smoothing.roughness(entity_knots, ridge)
    beta = np.linalg.solve(design.T @ (w[:, None] * design) + penalty, design.T @ (w * y))
    least = float((w * (y - design @ beta) ** 2).sum() + beta @ penalty @ beta)
    fits = {(name, int(step)): float(trend(np.array([step]))[0] @ beta[:group_knots] + own(np.array([step]))[0] @ beta[group_knots + e * entity_knots :][:entity_knots]) for e, name in enumerate(entities) for step in steps}
    return fits, least


@pytest.mark.parametrize("counts", [{"A": 1, "B": 3, "C": 12}])
def test_panel_smooth_solves_trend_and_deviations_together(table, monkeypatch, counts):
    """One entity alone, up to ten, and more than ten; entities with gaps; batches of one row."""
    rng = np.random.default_rng(8)
    rows = []
    for g, n in counts.items():
        for k in range(n):
            rows += [(g, f"{g}{k}", t, float(3 + np.sin(t / 5) + 0.3 * k + 0.2 * rng.normal()), float(rng.integers(1, 30))) for t in range(1, 31) if (t + k) % 7 or t in (1, 30)]
    df = table(rows, "state string, fips string, t int, y double, w double")
    given = {"group_knots": 9, "entity_knots": 6, "ridge": 0.5, "group_penalty": 0.3, "entity_penalty": 0.8}
    found = smoothing.panel_smooth(df, "state", "fips", "t", "y", "w", alone_knots=8, **given)
    monkeypatch.setattr(smoothing, "BATCH_CELLS", 1)
    sliced = smoothing.panel_smooth(df, "state", "fips", "t", "y", "w", alone_knots=8, **given)
    got = {(r.state, r.fips, r.t): r.fit for r in found.collect()}
    assert np.allclose([got[key] for key in sorted(got)], [r.fit for r in sliced.orderBy("state", "fips", "t").collect()])
    for g in ("B", "C"):
        fits, _ = dense_panel([r for r in rows if r[0] == g], 9, 6, 0.5, 0.3, 0.8)
        mine = {(f, t): fit for (s, f, t), fit in got.items() if s == g}
        assert mine.keys() == fits.keys() and np.allclose([mine[key] for key in fits], list(fits.values()), atol=1e-7)
    alone = smoothing.spline_smooth(df.filter("state = 'A'"), "fips", "t", "y", 8, 0.3, "w")
    assert np.allclose([got["A", "A0", r.t] for r in alone.collect()], [r.fit for r in alone.collect()])


def test_serosurvey(table):
    names = list(serology.SURVEY_COLUMNS)
    data = [("S", "Jul 1 - Jul 14, 2020", 10.0, 5.0, 6.0, 4.0, 50, 900), ("S", "Aug 1 - Aug 14, 2020", 666.0, 5.0, 6.0, 4.0, 50, None)]
    df = table(data, ", ".join(f"`{n}` {t}" for n, t in zip(names, ["string", "string", *["double"] * 4, "int", "int"])))
    got = serology.serosurvey_prepare(df).orderBy("week").collect()
    assert [(r.t, r.success, r["pop"]) for r in got] == [(1, 5, 900), (2, None, 900)]
    assert abs(got[0].se - 2 / 3.92) < 1e-12 and got[0].week == datetime.date(2020, 7, 12)
