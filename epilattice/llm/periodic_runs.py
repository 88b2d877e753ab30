"""Runs of words that repeat with a period, found online on sparse diagonals.

A word that equals the word ``d`` places before it continues the diagonal (lag) ``d``. The words are read once, in order:
earlier occurrences open diagonals, each further equal word adds one to the match length of its lag, and a lag that ends
with a sufficient length emits its run at once. Documents are independent, so nothing is shuffled.

Which earlier occurrences open a diagonal is narrowed without loss. A run of period ``d`` and exponent ``e`` matches its
lag at ``(e - 1) * d`` words or more, so for lags from ``2 ** k`` on, below ``2 ** (k + 1)``, only an earlier occurrence
of the next ``(e - 1) * 2 ** k`` words counts, and only where the words before both differ (else the diagonal is open
already). Occurrences of one such stretch within ``2 ** (k + 1)`` places are so few that all scales together take
O(n log n) steps for any text, also for one word repeated. A lag that is a multiple of an open lag whose stretch holds
its start follows that lag to the same end and has not the smallest period; it stays closed.

Defined results: a null text has no words, no runs and stays null; an empty text or one of blanks only has no words and
collapses to the empty text; a null doc_id stays null; repeated rows give equal rows; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilattice.llm.rows import chunks, pick

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, n_dropped long, text string"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, by first occurrence."""
    table: dict[bytes, int] = {}
    return np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dense numbers of pairs of numbers."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def openings(words: np.ndarray, exponent: int = 4) -> list[tuple[int, int]]:
    """``(place, lag)``, in order of place: where a diagonal opens that may become a run of ``exponent`` periods."""
    n, found, scale = len(words), [], 1
    stretch, ids = 1, words
    while stretch < exponent - 1 and len(ids) > 1:
        ids, stretch = _paired(ids[:-1], words[stretch:]), stretch + 1
    before = np.concatenate([[-1], words[:-1]])
    # ids[i] numbers the words i to i + stretch - 1
    while len(ids) > scale and stretch + scale <= n:
        order = np.argsort(ids, kind="stable")
        same = ids[order][1:] == ids[order][:-1]
        if not same.any():
            break
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        place = order[twice]
        group, previous, wide = ids[place], before[place], n + 2 * scale
        key = group * wide + place
        # of each place, the later places of its group from the next one on that is preceded by another word
        changes = np.flatnonzero((group[1:] != group[:-1]) | (previous[1:] != previous[:-1])) + 1
        after = np.append(changes, len(place))[np.searchsorted(changes, np.arange(len(place)), side="right")]
        low = np.maximum(after, np.searchsorted(key, key + scale))
        many = np.maximum(np.searchsorted(key, key + 2 * scale) - low, 0)
        if many.any():
            first = np.repeat(np.arange(len(place)), many)
            second = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            open_here = previous[first] != previous[second]
            found.append(np.stack([place[second], place[second] - place[first]], axis=1)[open_here])
        if len(ids) <= stretch:
            break
        ids, stretch, scale = _paired(ids[:-stretch], ids[stretch:]), 2 * stretch, 2 * scale
    if not found:
        return []
    both = np.concatenate(found)
    return [(i, d) for i, d in both[np.lexsort((both[:, 1], both[:, 0]))].tolist()]


def word_runs(words: np.ndarray, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every maximal run with its smallest period, by start and period.

    A run is as long as ``exponent`` periods and ``least`` words, or longer.
    """
    opened = openings(words, exponent)
    if not opened:
        return []
    word, n, runs = words.tolist(), len(words), []
    matched: dict[int, int] = {}  # by open lag, its match length
    at, i = 0, 0

    def close(lag: int, end: int) -> None:
        length = matched.pop(lag) + lag
        if length >= max(least, exponent * lag):
            runs.append((end - length, length, lag))

    while i < n and (matched or at < len(opened)):
        if not matched:
            i = opened[at][0]
        for lag in list(matched):
            if word[i] == word[i - lag]:
                matched[lag] += 1
            else:
                close(lag, i)
        while at < len(opened) and opened[at][0] == i:
            lag = opened[at][1]
            # an open lag's stretch begins at i + 1 - its match length - itself
            if not any(lag % other == 0 and i + 1 - length - other <= i - lag for other, length in matched.items()):
                matched[lag] = 1
            at += 1
        i += 1
    for lag in list(matched):
        close(lag, n)
    return sorted(runs, key=lambda run: (run[0], run[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, n_dropped, text``: every document's runs, and its text with each run's first period only.

    Words are what blanks (space, tab to carriage return) divide; the collapsed text joins them by one space.
    """
    if exponent < 2:
        raise ValueError("a run repeats: its exponent is 2 or more")
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            counts, runs, dropped, texts = [], [], [], []
            for text in part.column(1).to_pylist():
                words = (text or b"").split()
                found = word_runs(numbered(words), exponent, least) if len(words) >= least else []
                kept = [words[k] for k in np.flatnonzero(kept_words(len(words), found))] if found else words
                counts.append(len(words))
                runs.append([{"start": s, "length": length, "period": p} for s, length, p in found])
                dropped.append(len(words) - len(kept))
                texts.append(None if text is None else b" ".join(kept))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(runs, RUNS), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "n_dropped", "text"])

    return rows.mapInArrow(find, SCHEMA)
