"""Readers for the file shapes of the pipeline. Schemas are stated, never inferred from the data."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import week_from_number
from ..functions.text import snake_case
from ..operators.panel import within_range
from ..operators.reshape import stack

# One letter per column; '-' skips a column.
LETTERS = {"c": "string", "d": "double", "i": "int", "l": "boolean", "D": "date", "T": "timestamp"}


def compact_schema(letters: str, names: list[str]) -> T.StructType:
    """Schema from one letter per column."""
    kept = [(n, LETTERS[x]) for n, x in zip(names, letters, strict=True) if x != "-"]
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in kept])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    types: str | None = None,
    names: list[str] | None = None,
    sep: str = ",",
    header: bool = True,
    clean_names: bool = False,
    encoding: str | None = None,
) -> DataFrame:
    """Delimited text with pinned types; 'NA' and '' are missing, text that does not fit becomes NULL.

    ``types`` has one letter per file column. Skipped columns are not parsed, as only the selected
    ones reach the reader. With ``header`` the names come from the first line unless given.
    """
    reader = spark.read.option("sep", sep).option("nullValue", "NA").option("emptyValue", "")
    if encoding:
        # With a wide encoding the line end has to be named, or the file is cut between bytes.
        reader = reader.option("encoding", encoding).option("lineSep", "\n")
    if header:
        reader = reader.option("header", "true").option("enforceSchema", "true")
    if names:
        raw = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    else:
        raw = reader.csv(path)
    found = [c.lstrip("﻿").rstrip("\r") for c in raw.columns]
    letters = types or "c" * len(found)
    out = []
    for column, name, letter in zip(raw.columns, found, letters, strict=True):
        if letter == "-":
            continue
        value = F.regexp_replace(F.col(f"`{column}`"), "\r$", "") if encoding else F.col(f"`{column}`")
        value = F.when(value != "", value)
        out.append(value.try_cast(LETTERS[letter]).alias(snake_case(name) if clean_names else name))
    return raw.select(*out)


def read_tsv(spark: SparkSession, path: str | list[str], types: str | None = None, **options) -> DataFrame:
    return read_csv(spark, path, types, sep="\t", **options)


def with_file_key(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Add a value taken from the name of the file that a row comes from."""
    return df.withColumn(column, F.regexp_extract(F.input_file_name(), pattern, 1))


def read_regions(spark: SparkSession, path: str, types: str | None = None) -> DataFrame:
    """UTF-16 tab-separated files, one per region, with the region from the file name."""
    raw = read_tsv(spark, path, types, encoding="UTF-16LE")
    return with_file_key(raw, "Region", r"Region(\d+)\.csv").withColumn("Region", F.concat(F.lit("Region "), "Region"))


def files_by_header(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """First lines and the files that begin with them, from one pass over the first blocks of all files.

    The driver sees each different first line and the names of the files, as it does when it lists them.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.filter("at = 0").withColumn("row", F.monotonically_increasing_id())
    firsts = lines.groupBy("file").agg(F.min_by("value", "row").alias("header"))
    shapes = firsts.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return {row.header: [unquote(f) for f in row.files] for row in shapes.orderBy("header").toLocalIterator()}


def read_union(spark: SparkSession, path: str | list[str], types: dict[str, str] | None = None, sep: str = ",", clean_names: bool = False) -> DataFrame:
    """All files below a path, also where their columns differ, matched by name; one scan for each different header.

    ``types`` has a letter per column name, as in ``read_csv``; other columns are text. Files without a first line have no
    rows; columns that a file lacks are missing.
    """
    frames = []
    for header, files in files_by_header(spark, path).items():
        names = next(csv.reader([header.lstrip("\ufeff").rstrip("\r")], delimiter=sep))
        letters = "".join((types or {}).get(name, "c") for name in names)
        frames.append(read_csv(spark, files, letters, names, sep, clean_names=clean_names))
    if not frames:
        raise ValueError(f"no file with a header in {path}")
    return stack(*frames)


def read_weekly_files(spark: SparkSession, path: str, types: str | None = None, **options) -> DataFrame:
    """Files named by their week, read at once, with the week as a column and equal rows once."""
    raw = read_csv(spark, path, types, **options)
    dated = with_file_key(raw, "week", r"(\d{4}-\d{2}-\d{2})(?:\.csv)?(?:/[^/]*)?$")
    return dated.withColumn("week", F.col("week").try_cast("date")).distinct()


def read_partitions(spark: SparkSession, path: str, start=None, end=None, axis: str = "week") -> DataFrame:
    """Parquet partitioned by week, with the wanted range of weeks pushed into the file listing."""
    return within_range(spark.read.parquet(path), axis, start, end)


def dated_by_week_number(edges: DataFrame, value: str = "prop_of_origin_visits_to_dest") -> DataFrame:
    """Edges keyed by (year, week number) to edges keyed by the nearest Sunday."""
    kept = [F.col(c) for c in edges.columns if c not in ("week", "year", value)]
    week = week_from_number(F.col("year"), F.col("week"))
    return edges.select(*kept, week.alias("week"), F.col(value).alias("p"))
