"""Best-fit packing of token pieces, certified by lower bounds and repacked where they leave room.

Defined results: a null text is an empty document (only the end id); a null doc_id is a document of its own; repeated
rows are packed once each (``copy`` tells equal doc_ids apart); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epilattice.llm.rows import hashed
from epilattice.llm.tokens import id_kind, token_ids
from epilattice.session import settle

#: Pieces that meet in one partition: the first partitioning aims at this many, later ones too.
PIECES_PER_PART = 8192


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions.

    The identity gives the volume bound. For each threshold ``a`` up to half the capacity, sizes over ``capacity - a``
    count as full bins, sizes below ``a`` as nothing, the rest as themselves; and rounding each size to
    ``floor((k + 1) * x / capacity) / k``, sizes that divide evenly kept as they are, is feasible for every k.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    volume = count * x
    best = -(-int(volume.sum()) // capacity)
    below, number = np.cumsum(volume), np.cumsum(count)
    a = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - a]
    middle = below[capacity - a] - below[a - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 20):
        # in units of 1 / (k * capacity)
        even = (k + 1) * x % capacity == 0
        value = np.where(even, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each size and the number of bins: largest first, into the fullest bin that has room."""
    bins, free = np.empty(len(sizes), dtype=np.int64), [[] for _ in range(capacity + 1)]
    open_sizes, n = 0, 0  # bit f: some bin has exactly f free
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = open_sizes >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_sizes &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        if room > size:
            free[room - size].append(b)
            open_sizes |= 1 << (room - size)
    return bins, n


def cut(tokens: DataFrame, kind: str, capacity: int) -> DataFrame:
    """``doc_id, copy, piece, start, length, ids``: only documents over the capacity are cut.

    Built-in functions only: a second Python node beside the encoding would take every task a second worker, which
    then stays with a tokenizer and a store of words of its own.
    """
    size = int(kind[2])
    width, n = size * capacity, F.length("ids")

    def piece(k):
        start = k * capacity
        return F.struct(
            k.cast("int").alias("piece"),
            start.alias("start"),
            F.least(F.lit(capacity), F.floor(n / size) - start).cast("long").alias("length"),
            F.substring("ids", (k * width + 1).cast("int"), F.lit(width)).alias("ids"),
        )

    return tokens.filter(n > 0).select("doc_id", "copy", F.inline(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(n / width) - 1), piece)))


PLACED = "doc_id long, copy long, piece int, length long, part int, bin long, settled boolean, gap long"


def pack_parts(pieces: DataFrame, capacity: int, last: bool) -> DataFrame:
    """Best-fit decreasing in every ``part``; each learns from its bound whether it can still be improved.

    A partition that needs as many bins as its bound keeps all but its emptiest bin: its pieces could still fill gaps
    elsewhere. Beyond the bound it gives back every bin with room. With ``last`` all bins stay.
    """

    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], ignore_index=True)
        sizes = pieces["length"].to_numpy(np.int64)
        bins, n = best_fit_decreasing(sizes, capacity)
        gap = n - lower_bound(sizes, capacity)
        room = capacity - np.bincount(bins, sizes, minlength=n)
        if last:
            given = np.zeros(n, dtype=bool)
        elif gap:
            given = room > 0
        else:
            given = (room > 0) & (np.arange(n) == np.argmax(room))
        return pieces.assign(bin=bins, settled=~given[bins], gap=gap)

    return pieces.select("doc_id", "copy", "piece", "length", "part").groupBy("part").applyInPandas(pack, PLACED)


def assign(pieces: DataFrame, capacity: int, per_part: int = PIECES_PER_PART) -> DataFrame:
    """``doc_id, copy, piece, sequence_id, offset`` from ``doc_id, copy, piece, length`` alone.

    Round by round the pieces given back are dealt anew to fewer partitions of about the same size, so that pieces from
    different partitions meet. The packing is final when one partition holds all that is left, or when a round has given
    back so much that the next one would need as many partitions again. Every round's result is stored.
    """
    parts, rounds, done, last = max(1, math.ceil(pieces.count() / per_part)), 0, [], False
    while True:
        last = last or parts == 1
        dealt = pieces.withColumn("part", hashed(F.lit(rounds), "copy", "piece", parts=parts))
        placed = settle(pack_parts(dealt, capacity, last), "packed-round")
        bin_key = F.struct(F.lit(rounds).alias("round"), "part", "bin").alias("sequence")
        done.append(placed.filter("settled").select("doc_id", "copy", "piece", "length", bin_key))
        if last:
            break
        pieces = placed.filter("NOT settled").select("doc_id", "copy", "piece", "length")
        needed = math.ceil(pieces.count() / per_part)
        if not needed:
            break
        parts, rounds, last = needed, rounds + 1, needed >= parts
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return offsets(result)


def offsets(placed: DataFrame) -> DataFrame:
    """Gapless places inside each sequence; a sequence holds at most ``capacity`` pieces, as none is empty."""
    order = Window.partitionBy("sequence").orderBy(F.desc("length"), "doc_id", "copy", "piece").rowsBetween(Window.unboundedPreceding, -1)
    number = F.expr("(CAST(sequence.round AS LONG) * 16777216 + sequence.part) * 4294967296 + sequence.bin")
    return placed.select("doc_id", "copy", "piece", number.alias("sequence_id"), F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))


def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, per_part: int = PIECES_PER_PART) -> DataFrame:
    """Pack all documents: ``doc_id, copy, piece, start, length, ids, sequence_id, offset``, one row per piece.

    ``ids`` are bytes of the tokenizer's ``id_kind``. Pieces are stored once; the packing itself moves lengths only.
    """
    kind = id_kind(tokenizer, end_id)
    # A row number per task tells repeated doc_ids apart. It is stored before anything is shuffled by it.
    tokens = token_ids(docs, tokenizer, end_id, kind).withColumn("copy", F.monotonically_increasing_id())
    pieces = settle(cut(tokens, kind, capacity), "pieces")
    placed = assign(pieces.select("doc_id", "copy", "piece", "length"), capacity, per_part)
    return pieces.join(placed.drop("doc_id"), ["copy", "piece"]).select("doc_id", "copy", "piece", "start", "length", "ids", "sequence_id", "offset")
