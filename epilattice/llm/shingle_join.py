"""Join of documents whose sets of word shingles are similar, by relations between the sets.

Equal sets are one node. An index keeps each set's rarest shingles; its lists are cut into blocks by set size, and by
size and position whole combinations are skipped that can't reach the similarity (index-level skipping). In each list a
few sets, the pivots, are compared with the rest; what is computed for a pivot then spares work for the sets like it
(answer-level skipping): sets that are already connected need no comparison, and by the triangle inequality of the
Jaccard distance two sets whose distances to the same pivot differ too much can't be similar. Further rounds take more
pivots until no list has two sets left that are neither connected nor compared, so no link between components is lost,
and finding a large group of near copies costs one comparison for each member instead of one for each pair.

Then each set's answers, the similar sets, are computed within its component. A component has a pivot; each member is
reduced to its difference from it, and what two members share follows from their answers for the pivot and what their
differences share, without their sets meeting. The members of a large component are dealt into parts, and each two parts
are one task of bounded size. Links are counted, not written, as a group of near copies has one for each pair.

Defined results: a null or blank text has no shingles and is linked with nothing; rows of equal sets are linked; rows that share a doc_id are each
compared by their own text; a row without doc_id belongs to the class of its set, and a class without any doc_id is
not compared with other sets (its component and its number of links are null); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epilattice.llm.graphs import components
from epilattice.llm.rows import as_bytes, chunks, pick
from epilattice.session import settle

#: Cells of the sketch of shingle counts that orders the shingles (any order is right, a good one is fast), and bits of
#: the filter that tells which documents' sets are needed for comparisons. Both go to every task: 8 MB and 1 MB.
SKETCH_CELLS, FILTER_BITS, SLICE = 1 << 22, 1 << 23, 1 << 14
#: Words whose hashes a worker keeps.
WORDS_KEPT = 100_000
#: Sets of a component that a task takes from each of two parts, and shingles that these differ by from the pivot; columns
#: of the table of differences that are multiplied at once.
PART_SETS, PART_SHINGLES, COLUMNS = 256, 1 << 21, 1 << 12
#: Earlier shingles of its set that a row of an index list carries, to spare pairs that meet there.
EARLIER = 64
#: Pivots in a list grow by this factor from round to round. What a round links needs no comparison in the next, so a
#: small factor spares pairs in a large group of near copies.
MORE_PIVOTS = 8


class WordHashes(dict):
    """64-bit hashes of words, made on first use."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = value
        return value


_HASHES = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = 3) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, a text without words has none."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    x = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        x = _mix(x + h[k : n + k] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(x)


def signature(tokens: np.ndarray) -> bytes | None:
    """96 bits: a thousand million sets have two with the same one with a chance of about 6e-12."""
    return hashlib.md5(tokens.tobytes()).digest()[:12] if len(tokens) else None


def bit_map(tokens: np.ndarray) -> bytes:
    """Four to eight bits for each shingle, set by the low bits of its hash: a sixteenth of the set's own size or less.

    A bit that is set for one set and not for another stands for a shingle that the other does not have.
    """
    bits = 64
    while bits < 4 * len(tokens):
        bits *= 2
    filled = np.zeros(bits, dtype=bool)
    filled[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(filled, bitorder="little").tobytes()


def most_common(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """A bound on the shingles that two sets share, from their bit maps; the longer map is folded to the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    return min(n_x - int(np.bitwise_count(a & ~b).sum()), n_y - int(np.bitwise_count(b & ~a).sum()))


def prefix_length(n: int, percent: int) -> int:
    """How many of the first shingles in any common order have to be indexed."""
    return n - -(-percent * n // 100) + 1


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)


def packed_cells(cells: np.ndarray) -> bytes:
    """Cells in as few bytes each as the largest needs, compressed; the first byte tells how many."""
    width = next(w for w in (1, 2, 4) if int(cells.max()) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(cells.astype(f"<u{width}").tobytes(), 1)


def unpacked_cells(value: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(value[1:]), f"<u{value[0]}")


def _bit(doc_id: int) -> int:
    return ((doc_id * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 41


def set_table(rows: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n, sig, map`` of every document, stored, and the sketch of how often shingles occur.

    Each task counts into cells and adds its cells to its output, slice by slice; slices are summed by number.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH_CELLS, dtype="<u4")
        for part in chunks(batches):
            sets = [shingles(text, size) for text in as_bytes(part.column(1))]
            for s in sets:
                np.add.at(cells, _cells(s), np.uint32(1))
            yield batch(part.column(0), [len(s) for s in sets], [signature(s) for s in sets], [bit_map(s) for s in sets])
        for k in range(0, SKETCH_CELLS, SLICE):
            if cells[k : k + SLICE].any():
                yield batch(pa.array([None], pa.int64()), [-1 - k // SLICE], [None], [packed_cells(cells[k : k + SLICE])])

    def batch(doc_ids: pa.Array, ns: list, sigs: list, maps: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(maps, pa.binary())], names=["doc_id", "n", "sig", "map"])

    stored = settle(rows.mapInArrow(measure, "doc_id long, n long, sig binary, map binary"), "shingle-sets")

    def add(key, table):
        total = np.zeros(SLICE, dtype=np.int64)
        for cells in table.column("map"):
            total += unpacked_cells(cells.as_py())
        return pa.table({"n": [key[0].as_py()], "cells": [np.minimum(total, 2**16 - 1).astype("<u2").tobytes()]})

    slices = stored.filter("n < 0").groupBy("n").applyInArrow(add, "n long, cells binary").toPandas()
    sketch = np.zeros(SKETCH_CELLS, dtype="<u2")  # counts beyond its range are all as common as can be
    for n, cells in zip(slices["n"], slices["cells"], strict=True):
        at = (-1 - n) * SLICE
        sketch[at : at + SLICE] = np.frombuffer(cells, "<u2")
    return stored.filter("n >= 0"), sketch


def index_lists(rows: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """``token, block, sig, n, pos``: the index lists in which at least two different sets may be similar, stored.

    A set is listed under its first shingles in the order of (sketched count, hash); ``block`` is its class of sizes:
    similar sets lie in the same block or in neighbouring ones. Shingles of one set only leave first. Whole blocks are
    skipped next: neighbours share one of two ways to pair blocks up, so a block without another set in either of its
    pairs has nothing to find. All of it is done where the rows of a shingle are: they are shuffled once and not stored before.
    """
    order = rows.sparkSession.sparkContext.broadcast(sketch)
    step = -math.log(percent / 100) * (1 + 1e-9)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            tokens, sigs, ns, at = [np.empty(0, np.int64)], [], [], [np.empty(0, np.int32)]
            for text in as_bytes(part.column(1)):
                s = shingles(text, size)
                if not len(s):
                    continue
                p, count = prefix_length(len(s), percent), order.value[_cells(s)]
                first = s[np.argsort(count, kind="stable")[:p]]  # s is sorted, so ties go by hash
                tokens.append(first.view(np.int64))
                at.append(np.arange(p, dtype=np.int32))
                sigs += [signature(s)] * p
                ns += [len(s)] * p
            columns = [pa.array(np.concatenate(tokens)), pa.array(sigs, pa.binary()), pa.array(ns, pa.int64()), pa.array(np.concatenate(at))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "sig", "n", "pos"])

    found = rows.mapInArrow(lists, "token long, sig binary, n long, pos int")
    block = F.floor(F.log(F.col("n")) / F.lit(step)).cast("int").alias("block")
    kept = several(found, "token").dropDuplicates(["token", "sig"]).select("token", block, "sig", "n", "pos")
    pairs = F.array(F.floor(F.col("block") / 2) * 2, F.floor((F.col("block") + 1) / 2) * 2 + 1)
    useful = several(kept.withColumn("pair", F.explode(pairs)), "token", "pair")
    return settle(useful.dropDuplicates(["token", "sig"]).drop("pair"), "shingle-lists")


def several(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur with at least two different sets."""
    same = Window.partitionBy(*keys)
    return rows.withColumn("low", F.min("sig").over(same)).withColumn("high", F.max("sig").over(same)).filter("low <> high").drop("low", "high")


def needed_sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``sig, tokens``: the sets of the nodes ``wanted`` (``sig, rep``), each once, stored.

    Sets are made again from the text of one document for each node; a filter of fixed size over the ids of these
    documents spares most others, and the join by signature then is exact.
    """
    bits = wanted.select("rep").mapInArrow(_bits_of, "word int, bits binary").groupBy("word").applyInArrow(_join_bits, "word int, bits binary").toPandas()
    filled = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for word, value in zip(bits["word"], bits["bits"], strict=True):
        filled[word * SLICE : (word + 1) * SLICE] = np.frombuffer(value, np.uint8)
    known = rows.sparkSession.sparkContext.broadcast(filled)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            hit = [x is not None and bool(known.value[_bit(x) >> 3] >> (_bit(x) & 7) & 1) for x in part.column(0).to_pylist()]
            part = part.filter(pa.array(hit, pa.bool_()))
            found = [shingles(text, size) for text in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["sig", "tokens"])

    made = rows.mapInArrow(sets, "sig binary, tokens binary")
    return settle(made.join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "shingle-members")


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filled = np.zeros(FILTER_BITS, dtype=bool)
    for part in batches:
        filled[[_bit(x) for x in part.column(0).to_pylist()]] = True
    packed = np.packbits(filled, bitorder="little")
    words = [k for k in range(len(packed) // SLICE) if packed[k * SLICE : (k + 1) * SLICE].any()]
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array([packed[k * SLICE : (k + 1) * SLICE].tobytes() for k in words], pa.binary())], names=["word", "bits"])


def _join_bits(key, table):
    total = np.zeros(SLICE, dtype=np.uint8)
    for bits in table.column("bits"):
        total |= np.frombuffer(bits.as_py(), np.uint8)
    return pa.table({"word": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})


def candidates(lists: DataFrame, pivots_per_list: int, rounds: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of sets to compare in this round (``a < b``, labels ``la, lb``), and the lists' pivots (``token, block, sig``).

    A list's pivots are the first sets by hash, one for each share, which is an aggregate with map-side combine. So lists
    of the same group of near copies have the same pivots, and these are as like the group as any of its sets. A
    pivot meets the blocks beside its own; size, position, equal labels and distances to a common pivot skip the rest.
    """
    h = F.xxhash64("sig", F.lit(rounds))
    share = F.pmod(h, F.lit(pivots_per_list))
    first_round = "label" not in lists.columns
    carried = ["n", "sig", "pos"] if first_round else ["n", "sig", "pos", "label", "ref", "far", "before"]
    pivots = lists.groupBy("token", "block", share.alias("share")).agg(F.min(F.struct(h.alias("h"), *carried)).alias("p"))
    near = pivots.select("token", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), "p")
    p = lambda name: F.col(f"p.{name}")
    sizes = p("n") + F.col("n")
    # Two similar sets meet in the list of their first common shingle, where nothing before it is common.
    most = F.least(p("n") - p("pos"), F.col("n") - F.col("pos"))
    mine, other = (p("sig"), F.col("sig")) if first_round else (p("label"), F.col("label"))
    too_far = F.lit(False) if first_round else F.coalesce((p("ref") == F.col("ref")) & (F.abs(p("far") - F.col("far")) > F.lit(1 - percent / 100 + 1e-9)), F.lit(False))
    # A pair that also shares an earlier list is left to that one, until the list is done with the pair or has one component.
    first_here = F.lit(True) if first_round else ~F.arrays_overlap(p("before"), F.col("before"))
    can = (
        (mine != other)
        & (F.lit(100) * F.least(p("n"), "n") >= F.lit(percent) * F.greatest(p("n"), "n"))
        & (F.lit(100 + percent) * most >= F.lit(percent) * sizes)
        & ~too_far
        & first_here
    )
    pairs = near.join(lists, ["token", "block"]).filter(can)
    first = p("sig") < F.col("sig")
    ends = [F.when(first, x).otherwise(y).alias(name) for name, x, y in (("a", p("sig"), F.col("sig")), ("b", F.col("sig"), p("sig")), ("la", mine, other), ("lb", other, mine))]
    return pairs.select(*ends).distinct(), pivots.select("token", "block", "p.sig")


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``a, b, la, lb, open`` for each pair, stored: whether the bit maps leave it possible that the sets are similar."""
    side = lambda x: nodes.select(F.col("sig").alias(x), F.col("map").alias(f"m{x}"), F.col("n").alias(f"n{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "la", "lb", "ma", "na", "mb", "nb")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = zip(*(c.to_pylist() for c in part.columns[4:]), strict=True)
            can = [(100 + percent) * most_common(x, n, y, m) >= percent * (n + m) for x, n, y, m in rows]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(can, pa.bool_())], names=["a", "b", "la", "lb", "open"])

    return settle(met.mapInArrow(bound, "a binary, b binary, la binary, lb binary, open boolean"), "shingle-pairs")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, la, lb, both, either``: sizes of intersection and union of each pair, stored."""
    met = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb")), "b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            both, either = [], []
            for ta, tb in zip(part.column(4), part.column(5), strict=True):
                x, y = np.frombuffer(ta.as_buffer(), np.uint64), np.frombuffer(tb.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                n = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                both.append(n)
                either.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "la", "lb", "both", "either"])

    names = "a binary, b binary, la binary, lb binary, both long, either long"
    return settle(met.select("a", "b", "la", "lb", "ta", "tb").mapInArrow(count, names), "shingle-links")


def relabelled(table: DataFrame, moved: DataFrame) -> DataFrame:
    """``table`` with the labels of a round's components, ``moved`` (``label, to``), in the place of those before."""
    return table.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).select(*table.columns)


def similar_sets(rows: DataFrame, lists: DataFrame, nodes: DataFrame, size: int, percent: int) -> list[DataFrame]:
    """How labels move, ``label, to``, round by round; a set's first label is its own signature.

    A round joins components by the links found between them, so a round without links moves nothing. ``nodes`` are the
    listed sets, ``sig, rep, n, map``; only those that are still listed are kept for the next round.
    """
    met, moves, rounds = None, [], 0
    while True:
        pairs, pivots = candidates(lists, MORE_PIVOTS**rounds, rounds, percent)
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        pivots = settle(pivots, "shingle-pivots")
        seen = possible(pairs, nodes, percent)
        met = seen.select("a", "b") if met is None else met.unionByName(seen.select("a", "b"))
        near, found, moved = seen.filter("open").drop("open"), None, None
        if near.take(1):
            ends = near.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
            found = compare(near, needed_sets(rows, settle(nodes.select("sig", "rep").join(ends, "sig"), "shingle-nodes"), size))
            links = found.filter(100 * F.col("both") >= percent * F.col("either")).select(F.col("la").alias("a"), F.col("lb").alias("b"))
            if links.take(1):
                moves.append(components(links).select(F.col("node").alias("label"), F.col("label").alias("to")))
                moved = moves[-1]
        # A pivot has met all of its list; a list of one component has nothing left to find.
        left = lists.join(pivots, ["token", "block", "sig"], "left_anti")
        if rounds == 0:
            left = left.withColumn("label", F.col("sig"))
        if moved is not None:
            left = relabelled(left, moved)
        open_lists = left.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
        left = left.join(open_lists, "token").select(*left.columns)
        lists = settle(with_earlier(with_distances(left, pivots, found)) if rounds == 0 else left, "shingle-lists")
        if not lists.take(1):
            return moves
        nodes = settle(nodes.join(lists.select("sig").distinct(), "sig", "left_semi"), "shingle-nodes")
        rounds += 1


def with_earlier(lists: DataFrame) -> DataFrame:
    """Each listed set with the shingles before this one under which it is listed too, ``before``: the last few of them."""
    return lists.withColumn("before", F.collect_list("token").over(Window.partitionBy("sig").orderBy("pos").rowsBetween(-EARLIER, -1)))


def with_distances(lists: DataFrame, pivots: DataFrame, compared: DataFrame | None) -> DataFrame:
    """Each listed set with its list's first pivot (``ref``) and the Jaccard distance to it (``far``), where known."""
    if compared is None:
        return lists.withColumn("ref", F.lit(None).cast("binary")).withColumn("far", F.lit(None).cast("double"))
    ref = pivots.select("token", "block", F.col("sig").alias("ref"))
    distance = compared.select("a", "b", (1 - F.col("both") / F.col("either")).alias("far"))
    joined = lists.join(ref, ["token", "block"]).withColumn("a", F.least("ref", "sig")).withColumn("b", F.greatest("ref", "sig"))
    return joined.join(distance, ["a", "b"], "left").select(*lists.columns, "ref", "far")


def differences(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """``label, sig, copies, n, minus, n_pivot, other``: each set by its difference from its component's pivot, stored.

    ``other`` has the shingles that only one of set and pivot has, ``minus`` counts those that only the pivot has. The
    pivot is the set with the smallest signature; it is joined to the members, so no task holds a component.
    """
    pivots = classes.groupBy("label").agg(F.min("sig").alias("pivot"))
    own = classes.join(pivots, "label").join(sets, "sig").withColumnRenamed("tokens", "own")
    met = own.join(pivots.join(sets.withColumnRenamed("sig", "pivot"), "pivot").select("label", F.col("tokens").alias("theirs")), "label")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 32):
            ns, minus, n_pivot, other = [], [], [], []
            for own, theirs in zip(part.column(3), part.column(4), strict=True):
                x, p = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(theirs.as_buffer(), np.uint64)
                d = np.setxor1d(x, p, assume_unique=True)
                ns.append(len(x))
                n_pivot.append(len(p))
                minus.append((len(d) - len(x) + len(p)) // 2)
                other.append(d.tobytes())
            more = [*(pa.array(c, pa.int64()) for c in (ns, minus, n_pivot)), pa.array(other, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *more], names=["label", "sig", "copies", "n", "minus", "n_pivot", "other"])

    names = "label binary, sig binary, copies long, n long, minus long, n_pivot long, other binary"
    return settle(met.select("label", "sig", "copies", "own", "theirs").mapInArrow(reduce, names), "shingle-differences")


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``xs`` shares with each of ``ys``, from products of 0/1 tables of bounded width."""
    flat = np.concatenate([*xs, *ys])
    at = np.unique(flat, return_inverse=True)[1]
    rows = np.repeat(np.arange(len(xs) + len(ys)), [len(v) for v in (*xs, *ys)])
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    out = np.zeros((len(xs), len(ys)), dtype=np.int64)
    width = int(at[-1]) + 1 if len(at) else 0
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        table = np.zeros((len(xs) + len(ys), min(COLUMNS, width - low)), dtype=np.float32)
        table[rows[a:b], at[a:b] - low] = 1
        out += np.rint(table[: len(xs)] @ table[len(xs) :].T).astype(np.int64)  # at most COLUMNS, exact in single precision
    return out


def link_counts(members: DataFrame, percent: int) -> DataFrame:
    """``sig, others``: how many rows have another set that is similar, for each set of ``members`` (of ``differences``).

    With x- what x lacks of the pivot p, |x & y| = |p| - |x-| - |y-| + |(x ^ p) & (y ^ p)|.
    """
    heavy = F.greatest(F.count("*") / F.lit(PART_SETS), F.sum(F.length("other") / 8) / F.lit(PART_SHINGLES))
    parts = members.groupBy("label").agg(F.ceil(heavy).cast("int").alias("parts"))
    dealt = members.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("sig"), F.greatest("parts", F.lit(1))).cast("int"))
    # Each part meets each: a member goes to the tasks (its part, k) for later k and (k, its part) for earlier ones.
    task = F.transform(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    tasks = dealt.select("sig", "copies", "n", "minus", "n_pivot", "other", "label", "part", F.inline(task))

    def count(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        part = table.column("part").to_numpy()
        sides = [np.flatnonzero(part == i), np.flatnonzero(part == j)]
        n, minus, copies = (table.column(c).to_numpy() for c in ("n", "minus", "copies"))
        other = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("other")]
        x, y = sides
        out = np.zeros(table.num_rows, dtype=np.int64)
        if len(x) and len(y):
            both = table.column("n_pivot")[0].as_py() - minus[x][:, None] - minus[y][None, :] + shared_counts([other[k] for k in x], [other[k] for k in y])
            linked = 100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)
            if i == j:
                np.fill_diagonal(linked, False)
            out[x] += linked @ copies[y]
            if i != j:
                out[y] += linked.T @ copies[x]
        return pa.table({"sig": table.column("sig"), "others": pa.array(out, pa.int64())})

    counted = tasks.groupBy("label", "i", "j").applyInArrow(count, "sig binary, others long")
    return counted.groupBy("sig").agg(F.sum("others").alias("others"))


def shingle_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", with_links: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` per document; ``percent`` is the least Jaccard similarity of a link.

    ``n_links`` is the number of other rows whose sets are similar; rows of one set count each. A caller that wants the
    components only leaves the column out by ``with_links=False``.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table, sketch = set_table(rows, size)
    # Rows without doc_id take part through the documents with an id whose set is the same.
    lists = index_lists(rows.filter("doc_id IS NOT NULL"), sketch, size, percent)
    # Bit maps are wanted of listed sets only, and the others' leave before they are stored a second time.
    sets = table.filter("n > 0").groupBy("sig")
    listed = sets.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("map").alias("map")).join(lists.select("sig").distinct(), "sig", "left_semi")
    moves = similar_sets(rows, lists, settle(listed, "shingle-nodes"), size, percent)
    classes = sets.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("rep IS NOT NULL").withColumn("label", F.col("sig"))
    for moved in moves:
        classes = relabelled(classes, moved)
    smallest = classes.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("sets"), F.sum("copies").alias("all"))
    named = classes.join(smallest, "label").select("sig", "rep", "copies", "label", "component", "sets", "all")
    others = None
    if moves and with_links:
        named = settle(named, "shingle-classes")
        large = named.filter("sets > 2")
        if large.take(1):
            members = needed_sets(rows, settle(large.select("sig", "rep"), "shingle-nodes"), size)
            others = link_counts(differences(large.select("label", "sig", "copies"), members), percent)
    named = named.join(others, "sig", "left") if others is not None else named.withColumn("others", F.lit(0))
    # The two sets of a component of two are similar, or they would not be in one.
    links = F.col("copies") - 1 + F.when(F.col("sets") == 2, F.col("all") - F.col("copies")).otherwise(F.coalesce("others", F.lit(0)))
    named = named.select("sig", "component", links.alias("links"))
    out = table.join(named, "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    return out if with_links else out.drop("n_links")
