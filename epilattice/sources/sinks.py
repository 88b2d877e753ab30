"""Writers. Output goes to a new path; nothing is written over the path being read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.mobility import upsert_edges
from .readers import dated_by_week_number


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str | None = None) -> None:
    writer = df.write.option("header", "true").option("sep", sep).option("nullValue", "NA")
    if encoding:
        writer = writer.option("encoding", encoding)
    writer.csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_by_week(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Rows re-sliced by week, in one pass over all entities.

    The rebalance hint lets AQE cut a week that is too large for one task and put small weeks
    together, by their measured sizes.
    """
    writer = df.hint("rebalance", "week").write.partitionBy("week").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def write_week_number_slices(edges: DataFrame, path: str) -> None:
    """Edges by year and week number, written by the date of the week."""
    write_by_week(dated_by_week_number(edges), path)


def write_upserted(current: DataFrame, new: DataFrame, path: str) -> None:
    """Old and new rows of the edge table, averaged per pair and week, as a new version."""
    write_by_week(upsert_edges(current, new), path)
