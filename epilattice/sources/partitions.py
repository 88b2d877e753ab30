"""Tables kept as one folder per week: which weeks there are, as-of reads, and versions that share folders.

The weeks of a table come from the names of its folders or from a version's list, never from its rows. Reads pass the
weeks that are needed as a filter on the partition column, so the files of other weeks are not opened.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coupling import asof_source, copied_to_weeks, fallback_source, wanted_weeks
from ..operators.mobility import upsert_edges
from .sinks import write_by_week

#: Where a version keeps its rows and the list of its weeks.
ROWS, LIST = "rows", "weeks"
LIST_SCHEMA = "week date, folder string"


def listed_weeks(spark: SparkSession, path: str, axis: str = "week") -> list[datetime.date]:
    """Weeks with a folder below ``path``, in order, from the file system that Spark itself reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    entries = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = [entry.getPath().getName() for entry in entries if entry.isDirectory()]
    return sorted(datetime.date.fromisoformat(n.removeprefix(f"{axis}=")) for n in names if n.startswith(f"{axis}=") and "DEFAULT_PARTITION" not in n)


def _dates(weeks: list[datetime.date]) -> Column:
    return F.array(*[F.lit(w) for w in weeks]).cast("array<date>")


def _by_source(weeks: DataFrame, rows: DataFrame, source: Column, axis: str) -> DataFrame:
    """Rows of the source weeks that are needed, copied to the weeks that take them."""
    wanted = wanted_weeks(weeks, axis).withColumn("__source", source)
    needed = wanted.filter(F.col("__source").isNotNull()).agg(F.collect_set("__source").alias("weeks")).scalar()
    return copied_to_weeks(wanted, rows.filter(F.array_contains(needed, F.col(axis))), axis)


def _rows(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_asof(spark: SparkSession, weeks: DataFrame, path: str, schema: str | None = None, axis: str = "week") -> DataFrame:
    """Rows for every wanted week; a week without a folder takes the last week that has one."""
    source = asof_source(_dates(listed_weeks(spark, path, axis)), axis)
    return _by_source(weeks, _rows(spark, path, schema), source, axis)


def read_with_fallback(spark: SparkSession, weeks: DataFrame, path: str, fallback, schema: str | None = None, axis: str = "week") -> DataFrame:
    """Rows for every wanted week; a week without a folder takes one fixed week."""
    source = fallback_source(_dates(listed_weeks(spark, path, axis)), fallback, axis)
    return _by_source(weeks, _rows(spark, path, schema), source, axis)


def write_version(rows: DataFrame, path: str, kept: DataFrame | None = None) -> None:
    """Rows by week below ``path``, and the list of all weeks of the version with the folder that holds them.

    ``kept`` (week, folder) are weeks whose rows stay where another version wrote them.
    """
    spark = rows.sparkSession
    write_by_week(rows, f"{path}/{ROWS}")
    own = spark.createDataFrame([(w, f"{path}/{ROWS}") for w in listed_weeks(spark, f"{path}/{ROWS}")], LIST_SCHEMA)
    (own if kept is None else own.unionByName(kept)).coalesce(1).write.parquet(f"{path}/{LIST}")


def version_weeks(spark: SparkSession, path: str) -> DataFrame:
    """``week, folder`` of a version."""
    return spark.read.schema(LIST_SCHEMA).parquet(f"{path}/{LIST}")


def read_version(spark: SparkSession, path: str, schema: str, weeks: list[datetime.date] | None = None) -> DataFrame:
    """The rows of a version, of all its weeks or of some; ``schema`` names all columns, the week too.

    The list has one row per week. Weeks that lie in one folder are read by one scan.
    """
    folders: dict[str, list[datetime.date]] = {}
    for week, folder in version_weeks(spark, path).toLocalIterator():
        if weeks is None or week in weeks:
            folders.setdefault(folder, []).append(week)
    parts = [spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/week={w}" for w in sorted(here)]) for folder, here in sorted(folders.items())]
    if not parts:
        return spark.createDataFrame([], schema)
    table = parts[0]
    for more in parts[1:]:
        table = table.unionByName(more)
    return table


def upsert_version(spark: SparkSession, old: str, new: DataFrame, path: str, schema: str) -> None:
    """A version with new rows, averaged with the old ones per pair and week; only weeks with new rows are written.

    The files of the other weeks are neither read nor copied: the new version's list names the folder that has them.
    """
    touched = [row.week for row in new.select("week").distinct().toLocalIterator()]
    current = read_version(spark, old, schema, touched)
    kept = version_weeks(spark, old).filter(~F.col("week").isin(touched)) if touched else version_weeks(spark, old)
    write_version(upsert_edges(current, new), path, kept)
