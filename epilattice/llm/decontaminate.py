"""Benchmark decontamination by latent semantic retrieval, then in-order overlap and answer checks.

Benchmark items are cut into passages; their words are weighted by how rare they are in all documents, and a randomised
SVD of these TF-IDF rows, whose sums are made by tasks, gives a latent space. Every window of every document is placed
in it, windows with a high cosine to a passage are candidates, and a candidate is a leak when the passage's words come in
the same order around the window: nearly all of them, or most of them and the words of its answer.

The benchmark is the stated query set: it is taken in blocks of bounded size, and each block meets all documents once.
A block has at most as many passages as the latent space has dimensions, so the space holds every one of them exactly.

Defined results: a null or empty text or item has no words and no leak; a null doc_id or item_id stays null; repeated
rows are each reported; an empty table gives no rows; extra columns are not read. An item's answer is its column
``answer``, if the table has one and it is not null, else its last sentence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilattice.llm.rows import as_texts, chunks, pick, unwrap, wrap
from epilattice.session import settle

#: Words of a document window and the step between windows; words of a benchmark passage.
WINDOW, STEP, PASSAGE = 32, 16, 64
#: Dimensions of the latent space, and spare dimensions; passages of the benchmark that meet the documents in one pass.
RANK, SPARE = 256, 16
BLOCK = RANK  # with more, the passages outside the leading directions would not be found
#: A candidate has this cosine in the latent space, and this share of a passage's weight.
LEAST_COSINE, LEAST_WEIGHT = 0.35, 0.2
#: Shares of a passage's words in order: enough alone, enough with the answer; and the share of the answer's words.
ALONE, WITH_ANSWER, ANSWER = 0.8, 0.6, 0.8
#: Words whose numbers a worker keeps.
WORDS_KEPT = 300_000

_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def bare(raw: str) -> str:
    """A word without signs at its edges."""
    word = raw.strip(_MARKS)
    return word if not word or word[0].isalnum() and word[-1].isalnum() else _EDGE.sub("", raw)


def words_of(text: str) -> list[str]:
    """Lower-cased words without signs at their edges."""
    return [w for w in map(bare, text.lower().split()) if w]


@dataclass(frozen=True)
class Passage:
    item: int | None
    words: tuple[str, ...]
    answer: tuple[str, ...]


def passages(item: int | None, text: str | None, answer: str | None) -> list[Passage]:
    words = words_of(text or "")
    said = words_of(answer) if answer else words_of(_SENTENCE.split((text or "").strip())[-1])
    starts = [0, *range(PASSAGE, len(words) - PASSAGE // 2, PASSAGE)] if words else []
    ends = [*starts[1:], len(words)][: len(starts)]
    return [Passage(item, tuple(words[a:b]), tuple(said)) for a, b in zip(starts, ends, strict=True)]


class WordNumbers(dict):
    """Numbers of the benchmark's words by raw word of a text; -1 for all other words."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, raw: str) -> int:
        number = self.numbers.get(bare(raw), -1)
        if len(self) < WORDS_KEPT:
            self[raw] = number
        return number

    def of(self, text: str) -> np.ndarray:
        raw = text.lower().split()
        return np.fromiter(map(self.__getitem__, raw), dtype=np.int64, count=len(raw))


def numbered(rows: DataFrame, names: str, numbers: dict[str, int]) -> DataFrame:
    """``rows`` with the numbers of their text's words (``ids``) instead of ``text``, their last column; stored.

    Texts are so cut into words once for each block of the benchmark; counts, search and checks read numbers only.
    """
    known = rows.sparkSession.sparkContext.broadcast(numbers)  # the words of one block of passages
    kind = id_type(numbers)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = WordNumbers(known.value)
        for part in chunks(batches):
            ids = [lookup.of(text).astype(kind).tobytes() for text in as_texts(part.column(part.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=[*part.schema.names[:-1], "ids"])

    return settle(rows.mapInArrow(number, f"{names}, ids binary"), "word-numbers")


def id_type(numbers: dict[str, int]) -> str:
    return "<i2" if len(numbers) < 1 << 15 else "<i4"


def document_frequency(texts: DataFrame, n_words: int, kind: str) -> tuple[np.ndarray, int]:
    """In how many texts (numbers as bytes of ``kind``) each word occurs, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words + 1, dtype=np.int64)
        for part in chunks(batches):
            for ids in part.column(0).to_pylist():
                there = np.zeros(n_words + 1, dtype=bool)
                there[np.frombuffer(ids, kind)] = True  # -1 falls on the last place
                total[:-1] += there[:-1]
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    counts = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(n_words + 1, dtype=np.int64)
    total[counts["word"]] = counts["n"]
    return total[:-1], int(total[-1])


def _summed(rows: DataFrame, shape: tuple[int, int], add) -> np.ndarray:
    """The sum over all rows of what ``add`` makes of a batch: each task sums its own, then equal parts are summed."""
    part_rows = 1024

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for part in chunks(batches):
            add(total, part)
        at = [k for k in range(0, shape[0], part_rows) if total[k : k + part_rows].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[k : k + part_rows].tobytes() for k in at], pa.binary())], names=["at", "part"])

    def join(key, table):
        total = sum(np.frombuffer(x.as_py()) for x in table.column("part"))
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(shape)
    for row in rows.mapInArrow(per_task, "at long, part binary").groupBy("at").applyInArrow(join, "at long, part binary").collect():
        own = np.frombuffer(row["part"]).reshape(-1, shape[1])
        out[row["at"] : row["at"] + len(own)] = own
    return out


def randomised_svd(rows: DataFrame, dims: int, rank: int, spare: int = SPARE, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (dims x rank) and singular values of sparse rows (columns ``ids``, ``values``).

    Two passes over the rows, whose sums are made by tasks: ``A' A`` times a random matrix gives a basis of the range,
    and ``A`` in that basis gives a small symmetric matrix whose eigenvectors turn the basis.
    """
    wide = min(rank + spare, dims)
    dense = lambda part: [(np.asarray(i.as_py(), dtype=np.int64), np.asarray(v.as_py())) for i, v in zip(part.column(0), part.column(1), strict=True)]

    def times_random(total: np.ndarray, part: pa.RecordBatch) -> None:
        random = np.random.default_rng(seed).standard_normal((dims, wide))
        for ids, values in dense(part):
            total[ids] += values[:, None] * (values @ random[ids])

    basis, _ = np.linalg.qr(_summed(rows.select("ids", "values"), (dims, wide), times_random))
    shared = rows.sparkSession.sparkContext.broadcast(basis)  # dims and rank are bounded by the block

    def squares(total: np.ndarray, part: pa.RecordBatch) -> None:
        for ids, values in dense(part):
            y = values @ shared.value[ids]
            total += np.outer(y, y)

    size, turn = np.linalg.eigh(_summed(rows.select("ids", "values"), (wide, wide), squares))
    kept = [i for i in np.argsort(-size)[:rank] if size[i] > 1e-9 * max(size.max(), 1e-300)]
    return basis @ turn[:, kept], np.sqrt(size[kept])


def common_in_order(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a machine word of bits per place of ``a`` at once."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for w in b:
        hit = rest & masks.get(w, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


@dataclass(frozen=True)
class Space:
    """A block of passages in its latent space; ``words`` has the weighted latent vector of each numbered word."""

    passages: tuple[Passage, ...]
    numbers: dict[str, int]
    energy: np.ndarray
    words: np.ndarray
    placed: np.ndarray

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(first word of a window, passage, cosine) for the windows of a text that come near a passage.

        A window's vector is a difference of running sums over the words that have a weight. It can't carry more of a
        passage's weight than its words have, nor more than its vector is long; most windows end there.
        """
        places = np.flatnonzero((ids >= 0) & (self.energy[ids] > 0))
        own = ids[places]
        norms = np.linalg.norm(self.placed, axis=1)
        least = LEAST_WEIGHT * float(norms.min()) * (1 - 1e-4)
        starts = np.arange(0, max(len(ids) - WINDOW + STEP, 1), STEP)
        low, high = np.searchsorted(places, starts), np.searchsorted(places, starts + WINDOW)
        total = np.concatenate([[0.0], np.cumsum(self.energy[own])])
        near = total[high] - total[low] >= least * float(norms.min())
        if not near.any():
            return []
        starts, low, high = starts[near], low[near], high[near]
        found = []
        for at in range(0, len(starts), 256):
            some = slice(at, at + 256)
            first, last = int(low[some].min()), int(high[some].max())
            sums = np.concatenate([np.zeros((1, self.words.shape[1]), np.float32), np.cumsum(self.words[own[first:last]], axis=0)])
            x = sums[high[some] - first] - sums[low[some] - first]
            size = np.linalg.norm(x, axis=1)
            long = np.flatnonzero(size >= least)
            inner = x[long] @ self.placed.T
            cosine = inner / np.maximum(size[long, None] * norms, 1e-9)
            hits = np.argwhere((cosine >= LEAST_COSINE) & (inner >= LEAST_WEIGHT * norms**2))
            found += [(int(starts[at + long[k]]), int(p), float(cosine[k, p])) for k, p in hits]
        return found

    def leaks(self, ids: np.ndarray) -> list[tuple[int | None, float, float, bool]]:
        """(item, cosine, share in order, answer found): the best place of each passage that leaks into a text."""
        best = {}
        for start, p, cosine in self.candidates(ids):
            passage = self.passages[p]
            words, answer = ([self.numbers[w] for w in x] for x in (passage.words, passage.answer))
            n = len(words)
            around = ids[max(0, start - n) : start + WINDOW + n].tolist()
            share = common_in_order(words, around) / n
            answered = bool(answer) and common_in_order(answer, around) >= ANSWER * len(answer)
            if (share >= ALONE or (share >= WITH_ANSWER and answered)) and (p not in best or (share, cosine) > best[p][:2]):
                best[p] = (share, cosine, answered)
        return [(self.passages[p].item, cosine, share, answered) for p, (share, cosine, answered) in sorted(best.items())]


def word_numbers(block: list[Passage]) -> dict[str, int]:
    return {w: i for i, w in enumerate(sorted({w for p in block for w in p.words + p.answer}))}


def latent_space(texts: DataFrame, block: list[Passage], numbers: dict[str, int]) -> Space:
    """Weights from all documents (``ids`` of their words), and the randomised SVD of the block's rows."""
    seen, n_docs = document_frequency(texts.select("ids"), len(numbers), id_type(numbers))
    ids = [sorted({numbers[w] for w in p.words}) for p in block]
    weight = word_weights(seen, n_docs, ids)
    rows = passage_rows(texts.sparkSession, ids, weight)
    vectors, _ = randomised_svd(rows.repartition(max(1, len(block) // 128)), len(numbers), RANK)
    return placed_in(block, numbers, ids, weight, vectors)


def passage_rows(spark: SparkSession, ids: list[list[int]], weight: np.ndarray) -> DataFrame:
    """``ids, values`` of each passage's words. As an Arrow table: rows of a Python list would be read by Python workers
    of a second kind, which then stay beside those of the other stages."""
    columns = [pa.array(ids, pa.list_(pa.int32())), pa.array([weight[i] for i in ids], pa.list_(pa.float64()))]
    return spark.createDataFrame(pa.table(columns, names=["ids", "values"]))


def word_weights(seen: np.ndarray, n_docs: int, ids: list[list[int]]) -> np.ndarray:
    """How rare each word is, less a quarter of the largest such weight.

    Words of many documents so get no weight, and windows made of them are not looked at further; only where a passage
    has fewer than three other words, such words keep a small one.
    """
    weight = np.log((1 + n_docs) / (1 + seen)) - 0.25 * math.log(1 + n_docs)
    least = 0.0 if all(np.count_nonzero(weight[i] > 0.05) >= 3 for i in ids) else 0.05
    return np.where(weight > 0.05, weight, least)


def placed_in(block: list[Passage], numbers: dict[str, int], ids: list[list[int]], weight: np.ndarray, vectors: np.ndarray) -> Space:
    words = weight[:, None] * vectors
    placed = np.stack([words[i].sum(axis=0) for i in ids])
    return Space(tuple(block), numbers, weight**2, words.astype(np.float32), placed.astype(np.float32))


def blocks(benchmark: DataFrame, per_block: int = BLOCK) -> Iterator[list[Passage]]:
    """The benchmark's passages in blocks of at most ``per_block``, all but the last one full.

    Items are read part by part, so the driver holds a part and what is left of the one before.
    """
    has_answer = any(c.lower() == "answer" for c in benchmark.columns)
    wanted = {"item": "item_id", "text": "text"} | ({"answer": "answer"} if has_answer else {})
    rows = pick(benchmark, **wanted)
    if not has_answer:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    n = int(rows.agg(F.sum(F.ceil((F.size(F.split(F.trim("text"), r"\s+")) + 1) / F.lit(PASSAGE)))).first()[0] or 0)
    parts, left = max(1, math.ceil(n / per_block)), []  # n is an estimate, so passages are counted when they are cut
    for k in range(parts):
        own = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        left += [p for r in own.orderBy("item", "text").collect() for p in passages(r["item"], r["text"], r["answer"])]
        while len(left) >= per_block:
            yield left[:per_block]
            left = left[per_block:]
    if left:
        yield left


FOUND = "item_id long, cosine double, in_order double, answer boolean"


def _found(rows: DataFrame, block: list[Passage], names: str) -> DataFrame:
    """The key columns of ``rows``, which end in ``text``, and ``FOUND`` for each leak of a block's passages."""
    numbers = word_numbers(block)
    table, kind = numbered(rows, names, numbers), id_type(numbers)
    shared = rows.sparkSession.sparkContext.broadcast(latent_space(table, block, numbers))  # bounded by the block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            hits = [(i, *leak) for i, ids in enumerate(part.column(part.num_columns - 1).to_pylist()) for leak in shared.value.leaks(np.frombuffer(ids, kind))]
            at = pa.array([h[0] for h in hits], pa.int64())
            columns = [c.take(at) for c in part.columns[:-1]]
            more = [pa.array([h[k] for h in hits], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*part.schema.names[:-1], "item_id", "cosine", "in_order", "answer"])

    return table.mapInArrow(search, f"{names}, {FOUND}")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, in_order, answer``: one row per document and benchmark passage that leaked into it."""
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in blocks(benchmark):
        own = _found(rows, block, "doc_id long")
        found = own if found is None else found.unionByName(own)
    return found if found is not None else docs.sparkSession.createDataFrame([], f"doc_id long, {FOUND}")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no benchmark passage leaked, with all their columns.

    Rows are told apart by hashes of id and text, so documents without id are judged too; only hits are shuffled, and
    the rows when the hits are too many for a broadcast by Spark's own check.
    """
    rows = wrap(docs, doc_id="doc_id", text="text")
    key = F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit("b"), "doc_id")
    hits = None
    for block in blocks(benchmark):
        own = _found(rows.select(key[0].alias("k1"), key[1].alias("k2"), "text"), block, "k1 long, k2 long").select("k1", "k2")
        hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        return docs
    hits = settle(hits.distinct(), "leaks")
    kept = rows.withColumn("k1", key[0]).withColumn("k2", key[1]).join(hits, ["k1", "k2"], "left_anti")
    return unwrap(kept, docs)
