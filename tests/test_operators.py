"""Joins, panels, shapes, quantiles and file sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilattice.operators import joins, panel, quantiles, reshape
from epilattice.session import scratch_path, settle
from epilattice.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_null_keys_meet(table):
    a = table([(1, "a"), (None, "b")], "k int, x string")
    b = table([(None, "c"), (2, "d")], "k int, y string")
    assert rows(joins.natural_join(a, b, ["k"], "full"), "k") == [(None, "b", "c"), (1, "a", None), (2, None, "d")]
    assert rows(joins.attach(a, b, ["k"])) == rows(joins.natural_join(a, b, ["k"]))


def test_surprise_key_fails(table):
    a = table([(1, 1)], "k int, week int")
    with pytest.raises(ValueError):
        joins.natural_join(a, a, ["k"])


def test_hot_key_is_spread(spark):
    """Two thirds of equal rows in one group still join exactly once each."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 != 0, 7).otherwise(F.col("id")).alias("k"), F.lit(1.5).alias("x"))
    got = joins.with_group_stats(df, ["k"], n=F.count(F.lit(1)), m=F.avg("x"))
    assert got.count() == 3000
    assert got.filter("k = 7").agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()[:] == (2000, 2000, 2000)


def test_result_does_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("x"))
    one = rows(panel.z_score(df.coalesce(1), "x", ["k"]))
    many = rows(panel.z_score(df.repartition(13), "x", ["k"]))
    assert np.allclose(one, many)


def test_complete(table, day):
    d1, d2 = day("2021-01-03"), day("2021-01-10")
    df = table([(1, d1, 5), (2, d2, 6)], "fips int, week date, cases int")
    assert rows(panel.complete(df, ["fips"], "week")) == [(1, d1, 5), (1, d2, None), (2, d1, None), (2, d2, 6)]
    grouped = df.withColumn("state", F.col("fips"))
    assert panel.complete(grouped, ["fips"], "week", within=["state"]).count() == 2


def test_fill_and_rolling(table):
    df = table([(1, 1, None), (1, 2, 3.0), (1, 3, None), (1, 4, 5.0), (2, 1, 9.0)], "k int, t int, x double")
    by, order = ["k"], ["t"]
    got = rows(
        df.select(
            "k", "t",
            panel.filled_down("x", by, order).alias("d"),
            panel.filled_down_up("x", by, order).alias("du"),
            panel.filled_up_down("x", by, order).alias("ud"),
            panel.rolling_mean("t", by, order, 1, 1).alias("c"),
            panel.rolling_mean("x", by, order, 0, 1).alias("h"),
        ),
        "k", "t",
    )
    assert got == [
        (1, 1, None, 3.0, 3.0, None, None), (1, 2, 3.0, 3.0, 3.0, 2.0, None), (1, 3, 3.0, 3.0, 5.0, 3.0, None),
        (1, 4, 5.0, 5.0, 5.0, None, None), (2, 1, 9.0, 9.0, 9.0, None, None),
    ]


def test_null_duplicates_and_group_sizes(table):
    df = table([(1, None), (1, 2.0), (2, None)], "k int, bg double")
    assert rows(panel.drop_null_duplicates(df, ["k"], "bg")) == [(1, 2.0), (2, None)]
    assert rows(panel.keep_large_groups(df, ["k"], 1)) == [(1, None), (1, 2.0)]


def test_shapes(table):
    df = table([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "k int, n string, v double")
    wide = reshape.widen(df, ["k"], "n", "v", ["a", "b"])
    assert rows(wide) == [(1, 1.0, 2.0), (2, 3.0, None)]
    long = reshape.lengthen(wide, ["k"], ["a", "b"], "n", "v").filter("v is not null")
    assert rows(long) == rows(df)
    assert rows(reshape.unnest(reshape.nest(df, ["k"], ["n", "v"]))) == rows(df)
    pairs = table([(5, "13: 4, 17: 2")], "o int, s string")
    assert rows(reshape.explode_pairs(pairs, "s", "d", "n")) == [(5, 13, 4.0), (5, 17, 2.0)]


def test_quantiles_are_exact(spark):
    """Large groups go through the bracket, with copies and a hot group."""
    rng = np.random.default_rng(5)
    data = [(0, float(x)) for x in rng.normal(size=3000)] + [(1, float(x)) for x in rng.integers(0, 4, 1500)] + [(2, 1.0), (2, 2.0)]
    df = spark.createDataFrame(data, "k int, x double").repartition(5)
    got = {r.k: r for r in quantiles.group_quantiles(df, ["k"], "x", {"lower": 0.025, "upper": 0.975}).collect()}
    for k in (0, 1, 2):
        values = [x for g, x in data if g == k]
        assert np.allclose([got[k].lower, got[k].upper], np.quantile(values, [0.025, 0.975]))


def test_typed_csv(spark, table, day):
    path = scratch_path(spark, "typed")
    df = table([(1, "a", day("2021-01-03"), None), (2, "NA", None, 2.5)], "i int, c string, d date, x double")
    sinks.write_csv(df, path)
    got = rows(readers.read_csv(spark, path, "icDd"))
    assert got == [(1, "a", day("2021-01-03"), None), (2, None, None, 2.5)]
    assert readers.read_csv(spark, path, "i--d").columns == ["i", "x"]
    assert [f.dataType.simpleString() for f in readers.compact_schema("iD-", ["a", "b", "c"])] == ["int", "date"]


def test_utf16_with_windows_line_ends(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"Region{k}.csv").write_bytes(f"id\tname\r\n{k}\tx{k}\r\n".encode("utf-16-le"))
    got = rows(readers.read_regions(spark, str(tmp_path / "Region*.csv"), "ic"))
    assert got == [(1, "x1", "Region 1"), (2, "x2", "Region 2")]


def test_weekly_files(spark, tmp_path, day):
    for w in ("2021-01-03", "2021-01-10"):
        (tmp_path / f"{w}.csv").write_text("j,Ri\n1,0.5\n1,0.5\n")
    got = rows(readers.read_weekly_files(spark, str(tmp_path), "id"))
    assert got == [(1, 0.5, day("2021-01-03")), (1, 0.5, day("2021-01-10"))]


def test_partitions_prune(spark, table, day):
    path = scratch_path(spark, "parts")
    df = table([(1, day("2021-01-03")), (2, day("2021-01-10")), (3, day("2021-01-17"))], "x int, week date")
    sinks.write_by_week(df, path)
    some = readers.read_partitions(spark, path, "2021-01-05", "2021-01-12")
    assert [r.x for r in some.collect()] == [2]
    assert "PartitionFilters: [isnotnull(week" in some._jdf.queryExecution().toString()


def test_settled_table_keeps_its_rows(table):
    df = table([(1, 2.0), (None, None)], "k int, x double")
    assert rows(settle(df, "t")) == rows(df)


def test_a_dense_panel_reads_its_source_once(spark, tmp_path, day):
    """Rows, places and calendar come from the stored panel; the plan no longer names the reports."""
    from epilattice.operators.incidence import weekly_incidence
    from epilattice.operators.panel import time_index

    path = str(tmp_path / "cases")
    spark.createDataFrame([(day("2021-01-03"), 1, 5), (day("2021-01-12"), 1, 9), (day("2021-01-12"), 2, 4), (day("2021-01-13"), 2, 6)], "date date, fips int, cases long").write.parquet(path)
    weekly = weekly_incidence(spark.read.parquet(path))
    assert weekly.inputFiles() and not any(path in f for f in weekly.inputFiles())
    assert sorted(tuple(r) for r in weekly.select("fips", "week", "cases").collect()) == [
        (1, day("2021-01-03"), 0), (1, day("2021-01-10"), 4), (2, day("2021-01-03"), 0), (2, day("2021-01-10"), 2)
    ]
    raw = spark.createDataFrame([("b", 7), ("a", 3), ("b", 3), ("c", None)], "k string, x int")
    assert sorted((r.k, r.x or 0, r.t or 0) for r in time_index(raw, "x").collect()) == [("a", 3, 1), ("b", 3, 1), ("b", 7, 2), ("c", 0, 0)]
