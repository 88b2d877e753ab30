"""How far the sources of a language differ in their terms, with strings left behind until the end.

Tasks count terms for themselves. Counts by group travel as a 64-bit digest of the term and numbers. The least and the
greatest string of each digest travel as two aggregates beside the document counts of a language, one row per task: where
they differ, the digest stands for several terms, and its rows are counted again, split by the term's number among them.
Terms are joined back by digest only for the rows that are kept in the end.

For two sources of a language, terms that neither has all give the same summand, and terms that one of them has give a
summand that depends on one count. So the sum over all kept terms is made of the number of terms, of each source's
histogram of counts, and of a correction for the terms that both have. Blocks of terms give the corrections, summed per
pair of sources within the block. All numbers are integers, so the result is exact.

Defined results: null texts, languages and sources count as empty strings; a text without terms only makes its group
occur; repeated rows are documents of their own; without kept terms all pairs have the value 0 and there are no terms; a
source alone in its language has no pairs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epilattice.llm.rows import chunks, pick
from epilattice.session import settle

#: Letters of ASCII and all bytes of other characters; UTF-8 has no ASCII byte inside a character.
TERM = re.compile(rb"[a-z\x80-\xff]+")

#: Distinct terms of groups a task holds before it hands on its counts; terms that come again later make further rows.
TERMS_HELD = 1_000_000

#: Rows of counts in a block of terms.
BLOCK_ROWS = 1 << 16

WIDE = "DECIMAL(38, 0)"


def term_counts(docs: DataFrame, held: int = TERMS_HELD) -> DataFrame:
    """``l, g, term, n, docs`` from ``l, g, text``, summed within tasks: occurrences by group, and by language.

    Rows by group have no ``docs``; rows by language have no ``g``, and count occurrences and documents.
    """

    def rows(l: int, g: int | None, counts: Counter, by_doc: Counter | None) -> pa.RecordBatch:  # noqa: E741
        n = len(counts)
        columns = [
            pa.array(np.full(n, l, np.int64)),
            pa.nulls(n, pa.int64()) if g is None else pa.array(np.full(n, g, np.int64)),
            pa.array(list(counts), pa.binary()).cast(pa.string()),
            pa.array(np.fromiter(counts.values(), np.int64, n)),
            pa.nulls(n, pa.int64()) if by_doc is None else pa.array(np.fromiter(map(by_doc.__getitem__, counts), np.int64, n)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["l", "g", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_group: dict[tuple[int, int], Counter] = {}
        by_lang: dict[int, tuple[Counter, Counter]] = {}

        def all_rows() -> Iterator[pa.RecordBatch]:
            for (l, g), counts in by_group.items():  # noqa: E741
                yield rows(l, g, counts, None)
            for l, (counts, by_doc) in by_lang.items():  # noqa: E741
                yield rows(l, None, counts, by_doc)
            by_group.clear()
            by_lang.clear()

        number = 0
        for part in chunks(batches):
            for l, g, text in zip(*(c.to_pylist() for c in part.columns), strict=True):  # noqa: E741
                terms = TERM.findall(text.lower())
                if not terms:
                    continue
                counts = by_group.setdefault((l, g), Counter())
                all_counts, by_doc = by_lang.setdefault(l, (Counter(), Counter()))
                number -= len(counts)
                counts.update(terms)
                number += len(counts)
                all_counts.update(terms)
                by_doc.update(set(terms))
            if number > held:
                yield from all_rows()
                number = 0
        yield from all_rows()

    return docs.select("l", "g", F.col("text").cast("binary")).mapInArrow(count, "l long, g long, term string, n long, docs long")


def _share(count: Column | str, size: str, scale: int) -> Column:
    """``1 + floor(scale * (count + 1) / size)`` in exact integers."""
    return F.expr(f"1 + (CAST({scale} AS DECIMAL(18, 0)) * CAST({count} + 1 AS DECIMAL(19, 0))) DIV CAST({size} AS DECIMAL(20, 0))")


def _gap(p: str, q: str) -> str:
    """``floor((p - q) ** 2 / q)``."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) DIV ({q})"


def groups_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """``lang, source`` of all groups with digests ``l`` and ``g``, and a seed under which no two digests are equal."""
    pairs = settle(docs.select("lang", "source").distinct(), "audit-groups")
    seed = 0
    while True:
        keyed = pairs.withColumn("l", F.xxhash64(F.lit(seed), "lang")).withColumn("g", F.xxhash64(F.lit(seed), "lang", "source"))
        clash = keyed.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").take(1)
        if not clash and not keyed.groupBy("l").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).filter("a <> b").take(1):
            return keyed, seed
        seed += 1


def vocabulary(found: DataFrame, stored: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """``l, t, s, term, c`` of the kept terms, and ``l, g, t, s, n`` of all groups; ``s`` is a term's number in its digest.

    ``stored`` has the rows of ``term_counts`` with digests ``t``, and terms by language only; ``found``, which is read
    only where digests stand for several terms, has all terms. ``s`` is 0 but for such digests.
    """
    by_digest = stored.filter("g IS NULL").groupBy("l", "t").agg(F.sum("docs").alias("docs"), F.sum("n").alias("c"), F.min("term").alias("low"), F.max("term").alias("high"))
    likely = settle(by_digest.filter(F.col("docs") >= least_docs).drop("docs"), "audit-terms")
    whole = likely.filter("low = high").select("l", "t", F.lit(0).alias("s"), F.col("low").alias("term"), "c")
    shared = likely.filter("low <> high").select("l", "t")
    counts = stored.filter("g IS NOT NULL").select("l", "g", "t", F.lit(0).alias("s"), "n")
    if not shared.take(1):
        return whole, counts
    apart = settle(found.join(shared, ["l", "t"]), "audit-shared-digests")
    by_term = apart.filter("g IS NULL").groupBy("l", "t", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("c"))
    number = F.row_number().over(Window.partitionBy("l", "t").orderBy("term"))
    split = settle(by_term.withColumn("s", number).filter(F.col("docs") >= least_docs).select("l", "t", "s", "term", "c"), "audit-split-terms")
    # Rows of a shared digest that is no kept term get no number and so find no kept term.
    numbered = apart.filter("g IS NOT NULL").join(split.select("l", "t", "term", "s"), ["l", "t", "term"]).select(*counts.columns)
    return whole.unionByName(split), counts.join(shared, ["l", "t"], "left_anti").select(*counts.columns).unionByName(numbered)


def _corrections(table: pa.Table) -> pa.Table:
    """Per ordered pair of groups, the sum over terms that both have of what the histograms of counts leave out."""
    names = ["t", "s", "g", "p", "p0"]
    t, s, g, p, p0 = (table.column(name).to_numpy() for name in names)
    groups, g = np.unique(g, return_inverse=True)
    order = np.lexsort((g, s, t))
    t, s, g, p, p0 = (x[order] for x in (t, s, g, p, p0))
    gap = lambda a, b: (a - b) * (a - b) // b
    keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
    apart = 1
    rows = np.arange(len(t))
    while True:
        rows = rows[rows + apart < len(t)]
        rows = rows[(t[rows] == t[rows + apart]) & (s[rows] == s[rows + apart])]
        if not len(rows):
            break
        for a, b in ((rows, rows + apart), (rows + apart, rows)):
            more = gap(p[a], p[b]) - gap(p[a], p0[b]) - gap(p0[a], p[b]) + gap(p0[a], p0[b])
            keys, values = np.concatenate([keys, g[a] * len(groups) + g[b]]), np.concatenate([values, more])
        by_key = np.argsort(keys, kind="stable")
        keys, values = keys[by_key], values[by_key]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, values = keys[first], np.add.reduceat(values, first)
        apart += 1
    return pa.table({"g": groups[keys // max(len(groups), 1)], "h": groups[keys % max(len(groups), 1)], "value": pa.array(values, pa.int64())})


def pair_values(counts: DataFrame, groups: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``g, h, value``: the divergence of each group from each other group of its language, over all kept terms.

    ``counts`` has ``l, g, t, s, p, p0`` for each group and kept term that it has, ``groups`` has ``l, g, v, p0``, the
    number of kept terms and the share of a term without occurrences.
    """
    other = groups.select("l", F.col("g").alias("h"), F.col("p0").alias("q0"))
    wide = lambda value: F.expr(f"CAST({value} AS {WIDE})").alias("value")
    none = groups.join(other, "l").filter("g <> h").select("g", "h", wide(f"IF(v = 0, 0, CAST(v AS {WIDE}) * ({_gap('p0', 'q0')}))"))
    histogram = counts.groupBy("l", "g", "p", "p0").agg(F.count("*").alias("m"))
    single = histogram.join(other, "l").filter("g <> h")
    one = single.select("g", "h", wide(f"CAST(m AS {WIDE}) * (({_gap('p', 'q0')}) - ({_gap('p0', 'q0')}))"))
    back = single.select(F.col("h").alias("g"), F.col("g").alias("h"), wide(f"CAST(m AS {WIDE}) * (({_gap('q0', 'p')}) - ({_gap('q0', 'p0')}))"))
    blocks = max(1, -(-counts.count() // block_rows))
    both = (
        counts.select("l", F.pmod(F.xxhash64("t", "s"), F.lit(blocks)).alias("block"), "t", "s", "g", "p", "p0")
        .groupBy("l", "block")
        .applyInArrow(_corrections, "g long, h long, value long")
        .select("g", "h", wide("value"))
    )
    return none.unionByName(one).unionByName(back).unionByName(both).groupBy("g", "h").agg(F.sum("value").cast("long").alias("value"))


def top_terms(scored: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """``g, item, value, rank``: the ``top`` terms of each group by value, then by bytes of the term.

    Strings are joined only to rows that are not below the value at place ``top``. Every task ranks for itself before
    anything of a group meets.
    """
    by_value = Window.partitionBy("g").orderBy(F.desc("value"))
    least = scored.select("g", "value").withColumn("place", F.row_number().over(by_value)).filter(F.col("place") <= top)
    least = least.groupBy("g").agg(F.min("value").alias("least"))
    near = scored.join(least, "g").filter("value >= least").join(terms.select("l", "t", "s", "term"), ["l", "t", "s"])
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "term"))
    return near.select("g", "term", "value").withColumn("rank", place).filter(F.col("rank") <= top).select("g", F.col("term").alias("item"), "value", "rank")


def source_divergence(
    docs: DataFrame, least_docs: int = 3, top: int = 200, scale: int = 1_000_000_000, digest_bits: int = 64,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` for the other sources, part ``term`` for the top terms.

    A term has the share ``1 + floor(scale * (count + 1) / (total + terms))`` in a group or language, counts and totals
    over its language's terms in at least ``least_docs`` documents. ``value`` is ``floor((p - q) ** 2 / q)``: summed over
    all kept terms against another source of the language, or of one term against the language as a whole, where the
    group has the term and its share is greater. Fewer ``digest_bits`` only make digests collide.
    """
    rows = pick(docs, lang=lang_col, source=source_col, text=text_col)
    rows = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    groups, seed = groups_of(rows)
    digest = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "term"), 64 - digest_bits) if digest_bits < 64 else F.xxhash64(F.lit(seed), "term")
    keyed = rows.select(F.xxhash64(F.lit(seed), "lang").alias("l"), F.xxhash64(F.lit(seed), "lang", "source").alias("g"), "text")
    found = term_counts(keyed).withColumn("t", digest)
    stored = settle(found.withColumn("term", F.when(F.col("g").isNull(), F.col("term"))), "audit-counts")
    terms, numbered = vocabulary(found, stored, least_docs)
    kept = terms.select("l", "t", "s", "c")
    counts = settle(numbered.join(kept, ["l", "t", "s"]).groupBy("l", "g", "t", "s", "c").agg(F.sum("n").alias("n")), "audit-kept-counts")
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("l").agg(F.sum("c").alias("lang_total"), F.count("*").alias("v"))
    known = groups.join(totals, "g", "left").join(langs, "l", "left").na.fill(0, ["total", "lang_total", "v"])
    sized = known.withColumn("size", F.expr("greatest(total + v, 1)")).withColumn("lang_size", F.expr("greatest(lang_total + v, 1)"))
    known = settle(sized.withColumn("p0", _share("0", "size", scale)), "audit-totals")
    shares = counts.join(known.select("g", "size", "lang_size", "p0"), "g")
    shares = shares.withColumn("p", _share("n", "size", scale))
    pairs = pair_values(shares.select("l", "g", "t", "s", "p", "p0"), known.select("l", "g", "v", "p0"))
    scored = shares.withColumn("q", _share("c", "lang_size", scale)).filter("p > q").select("l", "g", "t", "s", F.expr(_gap("p", "q")).alias("value"))
    names = known.select("g", "lang", "source")
    others = known.select(F.col("g").alias("h"), F.col("source").alias("item"))
    by_pair = pairs.join(others, "h").withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item")))
    parts = by_pair.select("g", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(top_terms(scored, terms, top).select("g", F.lit("term").alias("part"), "item", "value", "rank"))
    return parts.join(names, "g").select("lang", "source", "part", "item", "value", "rank")
