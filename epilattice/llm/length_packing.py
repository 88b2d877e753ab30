"""Packing by repeat counts of length combinations, from non-negative least squares on the length histogram.

Documents longer than the window are cut into whole windows and a rest, so that all that is left to pack is a histogram
of lengths below the window. Combinations of two or three lengths that fill the window are enumerated; non-negative least
squares finds how often to repeat each so that together they use up the histogram; the counts are rounded and never use
more pieces than there are. What is left over is packed greedily, again as counts: the longest length first, then the
longest that still fits, and where only longer pieces are left one of them is cut at the gap. The last tokens, fewer than
a window, go into sequences whose lengths are powers of two. So no sequence needs padding, and their number is the least.

The driver sees one number per length. Which document goes where follows from its rank among the documents of its length:
ranks are counted within tasks and moved up by the counts of the tasks before, so a length that many documents share is
never in one place. A task looks its documents up in the plan, a few thousand rows whatever the size of the corpus.

Defined results: a null text is an empty document (only the end id); a null doc_id is a document of its own; repeated rows
are packed once each (``copy`` tells equal doc_ids apart); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epilattice.llm.byte_tokens import byte_token_ids
from epilattice.llm.rows import chunks
from epilattice.llm.tokens import id_kind
from epilattice.session import settle


#: Combinations join the passive set together down to this share of the steepest slope.
REACH = 0.05


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths, ascending, that fill the window; a first length of 0 stands for a combination of two.

    Only lengths that are ``present`` (a flag per length) are combined.
    """
    first = np.flatnonzero(np.concatenate([[True], present[1:]]))
    low = np.repeat(first, len(first))
    middle = np.tile(first, len(first))
    high = window - low - middle
    good = (middle > 0) & (low <= middle) & (middle <= high)
    low, middle, high = low[good], middle[good], high[good]
    good = present[high]
    return np.stack([low[good], middle[good], high[good]], axis=1)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, tolerance: float = 3e-4) -> np.ndarray:
    """How often to repeat each combination: non-negative least squares against the histogram, errors in tokens.

    An active-set method. In every round the combinations that promise most, with no length in common, join the passive
    set; its least squares solution is taken as far as no count turns negative, and counts that reach zero leave. It ends
    when a round lowers the squared error by less than a share of ``tolerance`` of what all rounds have lowered it by.
    """
    x = np.zeros(len(combos))
    total = histogram.sum()
    if not len(combos) or not total:
        return x
    size = len(histogram)
    weight = np.arange(size) / size
    weight[0] = 0.0
    target = weight * (histogram / total)
    passive = np.zeros(len(combos), dtype=bool)
    errors: list[float] = []
    while True:
        used = np.bincount(combos.ravel(), np.repeat(x, 3), minlength=size)
        slope = (weight * (target - weight * used))[combos].sum(axis=1)
        slope[passive] = 0.0
        steepest = float(slope.max())
        errors.append(float(np.sum((target - weight * used) ** 2)))
        if steepest <= 1e-15 or (len(errors) > 1 and errors[-2] - errors[-1] <= tolerance * (errors[0] - errors[-1])):
            return x * total
        taken = np.zeros(size, dtype=bool)
        for c in np.argsort(-slope, kind="stable")[: 4 * size]:
            if slope[c] <= steepest * REACH:
                break
            if not taken[combos[c]].any():
                taken[combos[c]] = True
                taken[0] = False
                passive[c] = True
        while True:
            columns = np.flatnonzero(passive)
            matrix = np.zeros((size, len(columns)))
            for k in range(3):
                np.add.at(matrix, (combos[columns, k], np.arange(len(columns))), 1.0)
            matrix *= weight[:, None]
            normal = matrix.T @ matrix
            normal[np.diag_indices_from(normal)] += 1e-9
            solved = np.linalg.solve(normal, matrix.T @ target)
            if (solved > 0).all():
                x[:] = 0.0
                x[columns] = solved
                break
            now = x[columns]
            down = solved <= 0
            step = float(np.min(now[down] / np.maximum(now[down] - solved[down], 1e-300)))
            now = now + step * (solved - now)
            gone = down & (now <= 1e-15)
            now[gone] = 0.0
            x[columns] = now
            passive[columns[gone]] = False
            if not passive.any():
                break


class Take(NamedTuple):
    """Pieces of one length that take the same place in the sequences of a pattern.

    Ranks ``first`` to ``first + repeat * many - 1`` of the length go to sequences ``sequence`` and on, ``many`` to each,
    beginning at ``offset``. Only ``taken`` tokens of each are used here; the rest of a piece that is cut is a new piece,
    of rank ``tail`` and on among those of its length.
    """

    first: int
    repeat: int
    many: int
    sequence: int
    offset: int
    taken: int
    tail: int


class Plan:
    """Where the pieces of each length go. Built on the driver from a histogram; tasks look pieces up."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window, self.sequences = window, 0
        self.left = [int(n) for n in histogram]  # pieces of each length not yet placed
        self.supply = list(self.left)  # pieces of each length so far, rests of cut pieces included
        self.takes: list[list[Take]] = [[] for _ in range(window + 1)]

    def add(self, members: list[tuple[int, int]], repeat: int, cut: tuple[int, int] | None = None) -> None:
        """``repeat`` sequences of ``many`` whole pieces of each length, and the head of a longer piece."""
        offset, rests = 0, []
        for length, many, taken in [*((n, many, n) for n, many in members), *([(cut[0], 1, cut[1])] if cut else [])]:
            first = self.supply[length] - self.left[length]
            rest = length - taken
            self.takes[length].append(Take(first, repeat, many, self.sequences, offset, taken, self.supply[rest] if rest else -1))
            self.left[length] -= repeat * many
            offset += many * taken
            rests += [rest] if rest else []
        for rest in rests:
            self.left[rest] += repeat
            self.supply[rest] += repeat
        self.sequences += repeat

    def greedy(self) -> None:
        """Pack all that is left: full windows first, then powers of two."""
        tokens = sum(n * many for n, many in enumerate(self.left))
        while tokens:
            goal = self.window if tokens >= self.window else 1 << (tokens.bit_length() - 1)
            space, members = goal, []
            for length in range(min(goal, self.window), 0, -1):
                many = min(space // length, self.left[length])
                if many:
                    members.append((length, many))
                    space -= length * many
                if not space:
                    break
            cut = None
            if space:
                used = dict(members)
                cut = (max(range(space + 1, self.window + 1), key=lambda n: self.left[n] - used.get(n, 0)), space)
            need = dict(members)
            if cut:
                need[cut[0]] = need.get(cut[0], 0) + 1
            repeat = min(self.left[n] // many for n, many in need.items()) if goal == self.window else 1
            self.add(members, repeat, cut)
            tokens -= repeat * goal

    def place(self, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """``(tokens taken, sequence, offset)`` of a piece and of its rests."""
        while length:
            takes = self.takes[length]
            take = takes[bisect_right(takes, rank, key=lambda t: t.first) - 1]
            copy, slot = divmod(rank - take.first, take.many)
            yield take.taken, take.sequence + copy, take.offset + slot * take.taken
            length, rank = length - take.taken, take.tail + copy


def plan_of(histogram: np.ndarray, window: int) -> Plan:
    """The plan for a histogram: ``histogram[n]`` pieces of ``n`` tokens, ``n`` up to ``window``."""
    plan = Plan(histogram, window)
    if plan.left[window]:
        plan.add([(window, 1)], plan.left[window])
    short = np.array(histogram[:window], dtype=np.int64)
    short[0] = 0
    combos = combinations(window, short > 0)
    counts = np.rint(repeat_counts(combos, short.astype(float))).astype(np.int64)
    for c in np.argsort(-counts, kind="stable"):
        if not counts[c]:
            break
        lengths, many = np.unique(combos[c][combos[c] > 0], return_counts=True)
        members = [(int(n), int(k)) for n, k in zip(lengths, many, strict=True)][::-1]
        repeat = min(int(counts[c]), *(plan.left[n] // k for n, k in members))
        if repeat:
            plan.add(members, repeat)
    plan.greedy()
    return plan


def ranked(tokens: DataFrame, window: int, width: int) -> DataFrame:
    """``doc_id, part, copy, n_tokens, rank, fulls, ids``: ranks within the task that wrote the row.

    ``rank`` counts earlier rows with the same rest, ``fulls`` the whole windows of earlier rows.
    """

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen, fulls, row = [0] * window, 0, part << 33
        for batch in batches:
            n = batch.column(2).to_pylist()
            ranks, before = [], []
            for many in n:
                ranks.append(seen[many % window])
                seen[many % window] += 1
                before.append(fulls)
                fulls += many // window
            copies = np.arange(row, row + len(n), dtype=np.int64)
            row += len(n)
            columns = [batch.column(0), pa.array([part] * len(n), pa.int32()), pa.array(copies), batch.column(2), pa.array(ranks, pa.int64()), pa.array(before, pa.int64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "copy", "n_tokens", "rank", "fulls", "ids"])

    return tokens.mapInArrow(rank, "doc_id long, part int, copy long, n_tokens long, rank long, fulls long, ids binary")


def pack_lengths(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, copy, start, length, ids, doc_tokens, sequence_id, offset``: one row per piece, no sequence padded.

    ``ids`` are bytes of the tokenizer's ``id_kind``.
    """
    kind = id_kind(tokenizer, end_id)
    width = int(kind[2])
    rows = settle(ranked(byte_token_ids(docs, tokenizer, end_id, kind, id_col, text_col), window, width), "ranked-tokens")
    rests = rows.groupBy("part", (F.col("n_tokens") % window).alias("rest")).agg(F.count("*").alias("n"))
    fulls = rows.groupBy("part").agg(F.sum(F.expr(f"n_tokens DIV {window}")).alias("n")).select("part", F.lit(window).cast("long").alias("rest"), "n")
    counts = settle(rests.unionByName(fulls), "length-counts")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for rest, n in counts.filter("rest > 0").groupBy("rest").agg(F.sum("n")).toLocalIterator():
        histogram[rest] = n
    plan = plan_of(histogram, window)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    by_part = settle(bases.groupBy(F.col("part").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("bases")), "length-bases")
    found = rows.join(by_part, F.col("part") == F.col("of")).select(
        "doc_id", "copy", "n_tokens",
        (F.col("rank") + F.expr(f"bases[n_tokens % {window}]")).alias("rank"),
        (F.col("fulls") + F.expr(f"bases[{window}L]")).alias("fulls"),
        "ids",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            out: list[tuple] = []
            for doc_id, copy, n, rank, before, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                start = 0
                for full in range(n // window):
                    (taken, sequence, offset), *_ = plan.place(window, before + full)
                    out.append((doc_id, copy, start, taken, ids[start * width : (start + taken) * width], n, sequence, offset))
                    start += taken
                for taken, sequence, offset in plan.place(n % window, rank):
                    out.append((doc_id, copy, start, taken, ids[start * width : (start + taken) * width], n, sequence, offset))
                    start += taken
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "copy", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return found.mapInArrow(cut, "doc_id long, copy long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
