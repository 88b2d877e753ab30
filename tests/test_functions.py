"""Missing values, calendar, text, codes and closed-form statistics."""

import datetime
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from epilattice.functions import dates, nulls, places, stats, text


def one(df):
    return df.first()


def test_strict_and_skip(spark, table):
    df = table([(1, 2.0), (1, None), (2, 3.0), (2, 4.0), (3, None)], "k int, x double")
    rows = {
        r.k: r
        for r in df.groupBy("k")
        .agg(
            nulls.strict_sum(F.col("x")).alias("strict"),
            nulls.skip_sum(F.col("x"), 0.0).alias("skip"),
            nulls.strict_sd(F.col("x")).alias("sd"),
        )
        .collect()
    }
    assert rows[1].strict is None and rows[1].skip == 2.0
    assert rows[2].strict == 7.0 and abs(rows[2].sd - math.sqrt(0.5)) < 1e-12
    assert rows[3].strict is None and rows[3].skip == 0.0


def test_unknown_condition_gives_null(table):
    df = table([(None,), (5,), (1,)], "x int")
    got = [r.v for r in df.select(nulls.if_else(F.col("x") > 3, F.lit("a"), F.lit("b")).alias("v")).collect()]
    assert got == [None, "a", "b"]


def test_weighted_mean(table):
    df = table([(1.0, 1), (3.0, 3), (None, None)], "x double, w int")
    assert one(df.agg(nulls.weighted_mean(F.col("x"), F.col("w")).alias("m"))).m == 2.5
    bad = table([(1.0, None), (3.0, 3)], "x double, w int")
    assert one(bad.agg(nulls.weighted_mean(F.col("x"), F.col("w")).alias("m"))).m is None


def test_clamps_and_nan(table):
    df = table([(float("nan"),), (None,), (2.0,), (-1.0,)], "x double")
    got = [tuple(r) for r in df.select(nulls.nullif_nan(F.col("x")).alias("x")).select(
        "x", nulls.cap_at(F.col("x"), 1.0), nulls.floor_at(F.col("x"), 0.0), nulls.null_outside(F.col("x"), 0.0, 1.0)
    ).collect()]
    assert got == [(None,) * 4, (None,) * 4, (2.0, 1.0, 2.0, None), (-1.0, -1.0, 0.0, None)]


def nearest_sunday(d):
    return min((d + datetime.timedelta(k) for k in range(-3, 4)), key=lambda x: (x.weekday() != 6, x))


def test_week_of_every_day(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2021-12-31')) AS d")
    for r in days.select("d", dates.week_of(F.col("d")).alias("w")).collect():
        assert r.w == nearest_sunday(r.d)


def test_month_rounding(table, day):
    cases = {"2021-01-16": "2021-01-01", "2021-01-17": "2021-02-01", "2021-02-15": "2021-03-01", "2021-02-14": "2021-02-01"}
    df = table([(day(k),) for k in cases], "d date").select("d", dates.month_of(F.col("d")).alias("m"))
    assert {r.d.isoformat(): r.m.isoformat() for r in df.collect()} == cases


def test_week_numbers_and_parsing(table, day):
    df = table([(2021, 2, "Jul 14, 2020", "nonsense")], "y int, w int, a string, b string")
    r = one(
        df.select(
            dates.week_from_number(F.col("y"), F.col("w")).alias("week"),
            dates.parse_month_day_year(F.col("a")).alias("a"),
            dates.parse_month_day_year(F.col("b")).alias("b"),
        )
    )
    assert (r.week, r.a, r.b) == (day("2021-01-10"), day("2020-07-14"), None)


def test_text(table):
    df = table([("North America / USA / Ohio", "VOC Alpha x", "mult[3,12]", None)], "a string, b string, c string, d string")
    r = one(
        df.select(
            text.piece(F.col("a"), "/", 4, 3).alias("state"),
            text.piece(F.col("a"), "/", 5, 5).alias("absent"),
            text.piece(F.col("d"), "/", 5, 5).alias("missing"),
            text.piece(F.col("b"), " ", 3, 2).alias("lineage"),
            text.parse_number(F.col("c")).alias("number"),
        )
    )
    assert tuple(r) == ("Ohio", "", None, "Alpha", 3.0)
    assert text.snake_case("Pango lineage") == "pango_lineage"
    assert text.snake_case("Rate (%) [Cumulative Prevalence]") == "rate_cumulative_prevalence"


def test_places(table):
    df = table([(2270, "x"), (2282, "y"), (2998, "z"), (None, "u")], "fips int, v string")
    assert [r.c for r in df.select(places.merged(F.col("fips")).alias("c")).collect()] == [2158, 2998, 2998, None]
    assert sorted(r.fips for r in places.split_units(df.filter("fips = 2998")).collect()) == [2105, 2282]
    assert [r.v for r in places.without(df, [2270]).collect()] == ["y", "z", "u"]
    assert len(places.TERRITORIES) == len(set(places.TERRITORIES)) == 68


def beta_tail(f, df):
    """P(F > f) by numeric integration of the t density."""
    t, n = math.sqrt(f), 200_000
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = t / n
    area = sum(c * (1 + ((k + 0.5) * h) ** 2 / df) ** (-(df + 1) / 2) for k in range(n)) * h
    return 1 - 2 * area


def test_f_tail(table):
    cases = [(3.84, 1), (4.0, 2), (0.5, 3), (4.0, 7), (2.5, 30), (7.0, 141)]
    df = table(cases, "f double, d int").select("f", "d", stats.f_upper_tail(F.col("f"), F.col("d")).alias("p"))
    for r in df.collect():
        assert abs(r.p - beta_tail(r.f, r.d)) < 1e-7


@settings(max_examples=10, deadline=None)
@given(st.floats(0.01, 30), st.integers(1, 60))
def test_f_tail_is_a_probability(spark, f, d):
    p = spark.range(1).select(stats.f_upper_tail(F.lit(f), F.lit(d)).alias("p")).first().p
    assert 0 <= p <= 1
