"""Line dedup by overlapping windows of three lines.

Windows of consecutive lines that are not blank are hashed; of equal windows anywhere in the table all but the first one,
in the order of doc_id and place, are removed, and the places that removed windows cover are merged, so a longer passage
goes as a whole. Blank lines between covered lines go with them. Built-in functions only.

Passages that lie within one or two lines, or begin and end inside lines, are not found; the README has figures.

Defined results: a null text stays null and has no lines; texts with fewer than three lines that are not blank stay as
they are; a text whose lines all go becomes empty; a null doc_id sorts last; rows that share doc_id and text count as one
document and get the same result; an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilattice.llm.rows import unwrap, wrap

#: Lines of a window.
WINDOW = 3


def _lines() -> Column:
    return F.split("text", "\n")


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc, first, last, w1, w2``: each window's place among the document's lines and two 64-bit hashes of its lines."""
    full = F.filter(
        F.transform(_lines(), lambda line, i: F.struct(i.alias("i"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit("b"), line).alias("b"), (F.trim(line, F.lit(" \t\r\x0b\x0c")) != "").alias("full"))),
        lambda x: x["full"],
    )
    at = lambda k, name: F.get(F.col("lines"), k)[name]
    window = lambda k: F.struct(
        at(k, "i").alias("first"),
        at(k + (size - 1), "i").alias("last"),
        F.xxhash64(*[at(k + j, "a") for j in range(size)]).alias("w1"),
        F.xxhash64(*[at(k + j, "b") for j in range(size)]).alias("w2"),
    )
    starts = F.when(F.size("lines") >= size, F.sequence(F.lit(0), F.size("lines") - size))
    return docs.select("doc", full.alias("lines")).select("doc", F.inline(F.transform(starts, window)))


def covered_spans(found: DataFrame) -> DataFrame:
    """``doc, spans``: by document, the places of windows that are equal to an earlier one.

    The first place of a window is an aggregate with map-side combine, so the most common window costs one row per task;
    its later places are joined to that one row, and Spark may split the hot side of this join as it likes.
    """
    firsts = found.groupBy("w1", "w2").agg(F.min(F.struct("doc", "first")).alias("origin"), F.count("*").alias("n")).filter("n > 1")
    later = found.join(firsts, ["w1", "w2"]).filter(F.struct("doc", "first") > F.col("origin"))
    return later.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def dedup_lines(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, n_lines, n_removed, text``: each input row (under neutral names, see ``unwrap``) with its text cleaned."""
    rows = wrap(docs, doc_id=id_col, text=text_col)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"))
    rows = rows.select("row", "text", key.alias("doc"))
    spans = covered_spans(windows(rows.select("doc", "text"), size))
    # A null doc_id has to find itself again, so the join compares parts without nulls.
    parts = lambda doc, name: [doc["no_id"].alias(f"{name}0"), F.coalesce(doc["doc_id"], F.lit(0)).alias(f"{name}1"), doc["h"].alias(f"{name}2")]
    left = rows.select("row", "text", *parts(F.col("doc"), "a"))
    right = spans.select("spans", *parts(F.col("doc"), "b"))
    joined = left.join(right, [F.col(f"a{i}") == F.col(f"b{i}") for i in range(3)], "left")
    lines = _lines()
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    text = F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines"))
    return (
        joined.withColumn("lines", lines)
        .withColumn("kept", F.when(F.col("spans").isNotNull(), kept))
        .select(
            "row",
            n_lines.cast("long").alias("n_lines"),
            F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n_lines - F.size("kept")).cast("long").alias("n_removed"),
            F.when(F.col("kept").isNull(), F.col("text")).otherwise(text).alias("text"),
        )
    )


def without_repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The columns of ``docs`` with cleaned texts; ``chars_col``, if there is one, follows the text where it changed."""
    cleaned = dedup_lines(docs, size, id_col, text_col)
    changed = {text_col: F.col("text")}
    if chars_col in docs.columns:
        old = F.col(f"row.c{docs.columns.index(chars_col)}")
        changed[chars_col] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(old)
    return unwrap(cleaned, docs, **changed)
