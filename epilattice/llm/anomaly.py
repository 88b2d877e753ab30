"""Quality rules: plain rule statistics, and an isolation forest over them for what the rules miss.

Defined results: a null text has no words and fails the base rules; texts of white space likewise; a null doc_id is kept
as it is and has no label; repeated rows are judged alike; a document with several labels counts once per label; without
labelled rows of both kinds nothing is rejected beyond the base rules; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilattice.llm.rows import as_bytes, chunks, pick
from epilattice.session import settle

SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: The base rules: fewer words, or a larger share of words in repeated windows in percent, fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rows from which trees are drawn, trees, rows per tree (the method's own bound), and the seed.
SAMPLE_ROWS, TREES, TREE_ROWS, SEED = 8192, 100, 256, 17
#: Share of labelled good rows that a threshold has to keep, and steps of the score histogram.
KEEP_RATE, SCORE_STEPS = 0.995, 2000

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    if len(words) < size + 1:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    n = len(words) - size + 1
    key = ids[:n].copy()
    for k in range(1, size):
        if k > 1 and len(number) >= 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[k : n + k]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    inside = np.zeros(len(words), dtype=bool)
    for k in range(size):
        inside[k : n + k] |= hit
    return int(inside.sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The columns of ``STATS`` behind doc_id for a text in UTF-8; ``n_upper`` and ``n_marks`` count ASCII signs."""
    words = text.split()  # bytes are split at the six blanks only
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    signs = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    blanks, symbols, marks = (int(signs[list(kind)].sum()) for kind in (BLANKS, SYMBOLS, MARKS))
    chars = int(signs[:128].sum() + signs[192:].sum())  # bytes from 128 to 191 continue a sign
    return len(words), chars - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), int(signs[65:91].sum()), marks


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``STATS`` per document, over its whole text."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STATS.split(", ")]
        for part in chunks(batches):
            columns = list(zip(*map(text_stats, as_bytes(part.column(1))), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return rows.mapInArrow(measure, STATS)


def features(stats: np.ndarray) -> np.ndarray:
    """Columns of ``STATS`` without doc_id -> what the forest sees: shares that do not depend on the size of a text.

    Repeated words and lines are left to the base rules: they are rare and widely spread in good texts, so each of them
    alone would look like an anomaly.
    """
    n_words, chars, symbols, _, _, _, upper, marks = stats.astype(np.float64).T
    words, chars = np.maximum(n_words, 1), np.maximum(chars, 1)
    return np.column_stack([chars / words, symbols / chars, upper / chars, marks / chars])


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    many = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: split feature (-1: leaf), split value, left child (the right one follows), path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    depth: int
    rows: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores: near 1 for rows that few random splits set apart, 0.5 and less for the rest."""
        total, at_row = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                inner = f >= 0
                step = self.left[t, node] + (x[at_row, np.maximum(f, 0)] >= self.value[t, node])
                node = np.where(inner, step, node)
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / max(float(mean_path(self.rows)), 1e-9))


def fit_forest(x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Random splits on random features, each tree on its own draw of rows, down to the mean depth of such trees."""
    rng = np.random.default_rng(seed)
    rows = min(tree_rows, len(x))
    depth = max(1, math.ceil(math.log2(max(rows, 2))))
    size = 2 ** (depth + 1)
    feature, value = np.full((trees, size), -1), np.zeros((trees, size))
    left, length = np.zeros((trees, size), dtype=np.int64), np.zeros((trees, size))
    for t in range(trees):
        todo, n_nodes = [(0, x[rng.choice(len(x), rows, replace=False)], 0)], 1
        while todo:
            node, own, level = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if level == depth or len(own) <= 1 or not len(open_features):
                length[t, node] = level + mean_path(len(own))
                continue
            f = rng.choice(open_features)
            cut = rng.uniform(low[f], high[f])
            feature[t, node], value[t, node], left[t, node] = f, cut, n_nodes
            right = own[:, f] >= cut
            todo += [(n_nodes, own[~right], level + 1), (n_nodes + 1, own[right], level + 1)]
            n_nodes += 2
    return Forest(feature, value, left, length, depth, rows)


def calibrate(histogram: list[tuple[int, int, int]], steps: int = SCORE_STEPS, keep_rate: float = KEEP_RATE) -> float:
    """From (score step, good 0/1, rows): the score from which rows are rejected, or infinity.

    Among the thresholds that keep ``keep_rate`` of the good rows, the one with the largest share of bad rows rejected
    less the share of good rows rejected.
    """
    counts = np.zeros((2, steps + 2))
    for step, good, n in histogram:
        counts[good, step] += n
    bad, good = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows at or above each step
    if not (bad[0] and good[0]):
        return math.inf
    gain = np.where(good <= (1 - keep_rate) * good[0], bad / bad[0] - good / good[0], -1.0)
    best = int(gain.argmax())
    return best / steps if gain[best] > 0 else math.inf


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, keep_rate: float = KEEP_RATE) -> DataFrame:
    """``STATS`` and ``base_failed, score, kept`` per document.

    The statistics are stored once. Trees grow on ``SAMPLE_ROWS`` rows that pass the base rules (those with the smallest
    hash); every row is scored, and the threshold follows from all labelled rows by a histogram of their scores.
    """
    names = [x.split()[0] for x in STATS.split(", ")][1:]
    stats = settle(rule_stats(docs), "rule-stats").withColumn("base_failed", base_failed())
    drawn = stats.filter("NOT base_failed").select(*names, F.xxhash64("doc_id", *names, F.lit(SEED)).alias("h")).orderBy("h", *names).limit(SAMPLE_ROWS).toPandas()
    if not len(drawn):
        return stats.withColumn("score", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    forest = fit_forest(features(drawn[names].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = features(np.column_stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))])) if part.num_rows else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forest.score(x), pa.float64())], names=[*part.schema.names, "score"])

    scored = settle(stats.select("doc_id", *names, "base_failed").mapInArrow(score, STATS + ", base_failed boolean, score double"), "rule-scores")
    known = pick(labels, doc_id="doc_id", quality="quality").filter("quality IN (0, 1)")
    step = F.floor(F.col("score") * SCORE_STEPS).cast("int")
    seen = scored.filter("NOT base_failed").join(known, "doc_id").groupBy(step.alias("step"), F.col("quality").cast("int").alias("good")).count()
    threshold = calibrate([tuple(r) for r in seen.collect()], keep_rate=keep_rate)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(float(threshold))))
