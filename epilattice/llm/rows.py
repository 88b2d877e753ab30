"""Columns by exact name, whole rows kept aside, and small helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a Python task turns into objects at once.
CHUNK = 256


def position(df: DataFrame, name: str) -> int:
    """Place of a column: an exact match of the name wins over one that differs in case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not (exact or loose):
        raise ValueError(f"no column {name!r} in {df.columns}")
    return (exact or loose)[0]


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, ``new_name='old name'``; other columns, also clashing ones, are not read."""
    at = {new: position(df, old) for new, old in wanted.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def wrap(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns beside a struct ``row`` of all columns under neutral names; ``unwrap`` undoes it."""
    at = {new: position(df, old) for new, old in wanted.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(F.struct("*").alias("row"), *[F.col(f"c{i}").alias(new) for new, i in at.items()])


def unwrap(df: DataFrame, like: DataFrame, row: str = "row", **changed: Column) -> DataFrame:
    """The columns of ``like`` again, under their own names and types; ``changed`` gives new values by name."""
    new = {position(like, name): value for name, value in changed.items()}
    fields = [
        (new[i].cast(f.dataType) if i in new else F.col(f"{row}.c{i}")).alias(f"c{i}")
        for i, f in enumerate(like.schema.fields)
    ]
    return df.select(*fields).toDF(*like.columns)


def chunks(batches: Iterable[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def hashed(*columns: Column | str, parts: int) -> Column:
    """A part number from exact columns: the same value whenever a task is run again."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")
