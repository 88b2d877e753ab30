"""Folders by week: listing, pruned as-of reads, versions that share folders. Files that must not be read are broken."""

import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from epilattice.operators import coupling
from epilattice.sources import partitions, sinks

SCHEMA = "origin_county_fips int, destination_county_fips int, prop_population double, week date"
ORDER = ["origin_county_fips", "destination_county_fips", "prop_population", "week"]


def weeks(*days):
    return [datetime.date(2021, 1, d) for d in days]


def edges(spark, days, value=1.0):
    return spark.createDataFrame([(o, o + 1, value * o, w) for w in weeks(*days) for o in (1, 2)], SCHEMA)


def broken(path, *days):
    """Overwrite the files of some weeks with bytes that no reader takes."""
    files = [f for d in days for f in pathlib.Path(path, f"week=2021-01-{d:02d}").glob("*.parquet")]
    assert files
    for f in files:
        f.write_bytes(b"not a parquet file")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "edges")
    sinks.write_by_week(edges(spark, (3, 10, 24, 31)), path)
    return path


def test_weeks_come_from_the_listing(spark, stored):
    broken(stored, 3, 10, 24, 31)
    assert partitions.listed_weeks(spark, stored) == weeks(3, 10, 24, 31)


def test_asof_reads_only_the_weeks_it_needs(spark, stored):
    broken(stored, 3, 31)
    wanted = spark.createDataFrame([(w,) for w in weeks(10, 17, 24)], "week date")
    rows = partitions.read_asof(spark, wanted, stored, SCHEMA).select(*ORDER).collect()
    assert sorted(tuple(r) for r in rows) == sorted((o, o + 1, float(o), w) for w in weeks(10, 17, 24) for o in (1, 2))


def test_weeks_before_the_first_folder_have_no_rows(spark, stored):
    wanted = spark.createDataFrame([(datetime.date(2020, 12, 27),)], "week date")
    assert partitions.read_asof(spark, wanted, stored, SCHEMA).collect() == []
    assert partitions.read_asof(spark, wanted.limit(0), stored, SCHEMA).collect() == []


def test_fallback_reads_only_the_weeks_it_needs(spark, stored):
    broken(stored, 10, 31)
    wanted = spark.createDataFrame([(w,) for w in weeks(17, 24)], "week date")
    rows = partitions.read_with_fallback(spark, wanted, stored, "2021-01-03", SCHEMA).select("week").distinct().collect()
    assert sorted(r.week for r in rows) == weeks(17, 24)


def test_upsert_leaves_untouched_weeks_alone(spark, tmp_path):
    first, second, third = (str(tmp_path / n) for n in ("first", "second", "third"))
    partitions.write_version(edges(spark, (3, 10, 17)), first)
    broken(f"{first}/rows", 3)
    partitions.upsert_version(spark, first, edges(spark, (10, 24), 3.0), second, SCHEMA)
    where = {r.week: r.folder for r in partitions.version_weeks(spark, second).collect()}
    assert where == {w: f"{f}/rows" for w, f in zip(weeks(3, 10, 17, 24), (first, second, first, second), strict=True)}
    assert partitions.listed_weeks(spark, f"{second}/rows") == weeks(10, 24)
    rows = partitions.read_version(spark, second, SCHEMA, weeks(10, 17, 24)).select(*ORDER).collect()
    expected = {10: 2.0, 17: 1.0, 24: 3.0}
    assert sorted(tuple(r) for r in rows) == sorted((o, o + 1, v * o, datetime.date(2021, 1, d)) for d, v in expected.items() for o in (1, 2))
    partitions.upsert_version(spark, second, edges(spark, ()), third, SCHEMA)
    assert sorted(map(tuple, partitions.version_weeks(spark, third).collect())) == sorted(where.items())
    assert partitions.read_version(spark, third, SCHEMA, []).collect() == []


def at_weeks(wanted, rows, how):
    return coupling.asof_partition(wanted, rows) if how == "asof" else coupling.fixed_fallback(wanted, rows, "2021-01-03")


def test_asof_edges_are_made_once(spark):
    """Neither the rows that the wanted weeks come from nor those that the edges come from are in the plan of the result."""
    day = lambda modulus: F.date_add(F.lit("2021-01-10").cast("date"), (7 * (F.col("id") % modulus)).cast("int"))
    rows = spark.range(6).select((F.col("id") + 1).cast("int").alias("origin_county_fips"), day(2).alias("week"))
    found = at_weeks(spark.range(1000).select(day(3).alias("week")), rows, "asof")
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = [(1, 10), (3, 10), (5, 10), (2, 17), (4, 17), (6, 17), (2, 24), (4, 24), (6, 24)]
    assert sorted((r.origin_county_fips, r.week.day) for r in found.collect()) == sorted(expected)


@pytest.mark.parametrize("how", ["asof", "fallback"])
def test_missing_weeks_and_repeated_rows_of_any_table(spark, how):
    """Rows without a week go nowhere, equal rows are all kept, and a missing or repeated wanted week adds none."""
    some = edges(spark, (3, 10, 24))
    odd = some.unionByName(some).unionByName(some.limit(1).withColumn("week", F.lit(None).cast("date")))
    wanted = spark.createDataFrame([(None,), *((w,) for w in 2 * weeks(17, 24))], "week date")
    got = sorted(tuple(r) for r in at_weeks(wanted, odd, how).select(*ORDER).collect())
    assert got == sorted(2 * [(o, o + 1, float(o), w) for w in weeks(17, 24) for o in (1, 2)])
    assert at_weeks(wanted, odd.limit(0), how).collect() == []


def read_at(spark, path, wanted, how):
    return partitions.read_asof(spark, wanted, path, SCHEMA) if how == "asof" else partitions.read_with_fallback(spark, wanted, path, "2021-01-03", SCHEMA)


@pytest.mark.parametrize("how", ["asof", "fallback"])
def test_sources_are_looked_up_per_week_and_not_per_row(spark, stored, how):
    """The rows that the wanted weeks come from are no part of the plan that looks up the sources."""
    days = spark.range(1000).select(F.date_add(F.lit("2021-01-10").cast("date"), (7 * (F.col("id") % 3)).cast("int")).alias("week"))
    found = read_at(spark, stored, days, how)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan
    assert sorted(r.week for r in found.collect()) == sorted(2 * weeks(10, 17, 24))


@pytest.mark.parametrize("how", ["asof", "fallback"])
def test_missing_and_repeated_wanted_weeks(spark, stored, how):
    """A missing week takes no rows, a repeated one takes them once."""
    wanted = spark.createDataFrame([(None,), *((w,) for w in 2 * weeks(17, 24))], "week date")
    got = sorted(tuple(r) for r in read_at(spark, stored, wanted, how).select(*ORDER).collect())
    assert got == sorted((o, o + 1, float(o), w) for w in weeks(17, 24) for o in (1, 2))
    assert read_at(spark, stored, wanted.filter("week is null"), how).collect() == []
