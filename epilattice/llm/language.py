"""Language identification in two steps: the family first, then the language within it.

Both steps are one-versus-one linear support vector machines over hashed letter n-grams of the whole text. Defined
results: a text that is null or has no letter is ``und`` with score 0; a null doc_id is never held out and never learned
from; repeated rows are predicted alike; with one learned language that one is predicted, without any all is ``und``; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epilattice.llm.rows import as_texts, chunks, pick, position, unwrap, wrap
from epilattice.session import settle

#: Labelled rows per language that the machines are fitted on, and the dimensions of the hashed n-grams.
ROWS_PER_LANGUAGE, BITS = 300, 13
#: How many times as many ids as are wanted pass the cut on their hashes.
CUT = 4
ORDERS = (1, 2, 3)
#: Signs of a text that are turned into n-grams at once; pieces overlap, so no n-gram is lost between them.
PIECE = 1 << 18
#: Length of the excerpt that each labelled text also gives, so that short texts are learned too.
EXCERPT = 80

#: Families by language code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def profile(text: str, bits: int = BITS) -> np.ndarray | None:
    """Square roots of the shares of hashed letter n-grams (so a unit vector), or None without a letter."""
    letters = _letters()
    counts, seen = np.zeros(1 << bits, dtype=np.int64), False
    for start in range(0, len(text), PIECE):
        piece = text[max(0, start - max(ORDERS) + 1) : start + PIECE].lower()
        signs = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        known = letters[signs]
        seen = seen or bool(known.any())
        signs = np.where(known, signs, np.uint32(32))
        key = np.zeros(len(signs), dtype=np.uint32)
        for n in ORDERS:
            if len(signs) >= n:
                key = key[: len(signs) - n + 1] * np.uint32(0x01000193) + signs[n - 1 :] + np.uint32(n)
                counts += np.bincount((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    if not seen:
        return None
    return np.sqrt(counts / counts.sum()).astype(np.float32)


class Profiles:
    """Rows of ``profile`` as places and values that are not zero; made dense only for the pair that is being fitted."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.rows, self.width = rows, width

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, wanted: np.ndarray) -> Profiles:
        return Profiles([self.rows[i] for i in np.flatnonzero(wanted)], self.width)

    def dense(self) -> np.ndarray:
        x = np.zeros((len(self.rows), self.width), dtype=np.float32)
        for i, (at, values) in enumerate(self.rows):
            x[i, at] = values
        return x


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss; ``y`` is 1 or -1, both sides count the same.

    Accelerated gradient steps on the whole sample, with the step size from the largest curvature. Single precision, and
    the offset is kept apart, so ``x`` is not copied.
    """
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c).astype(np.float32)
    curvature = np.float32(1.0 + 2.0 * float(weight.sum()) * (1.0 + float(np.einsum("ij,ij->i", x, x).max())))
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    b = u = np.float32(0)
    for k in range(steps):
        pull = weight * y * np.maximum(np.float32(0), np.float32(1) - y * (x @ v + u))
        w_after = v - (v - np.float32(2) * (pull @ x)) / curvature
        b_after = u - (u - np.float32(2) * pull.sum()) / curvature
        on = np.float32(k / (k + 3.0))
        w, v = w_after, w_after + on * (w_after - w)
        b, u = b_after, b_after + on * (b_after - b)
    return w, float(b)


@dataclass(frozen=True)
class Machines:
    """One-versus-one machines for the members of a group: a vote for each pair, ties go to the larger margin."""

    members: tuple[str, ...]
    weights: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, x: Profiles, names: np.ndarray) -> Machines:
        members = tuple(sorted(set(names)))
        fitted = []
        for a, b in combinations(members, 2):
            own = (names == a) | (names == b)
            fitted.append(fit_svm(x[own].dense(), np.where(names[own] == a, 1.0, -1.0)))
        weights = np.stack([w for w, _ in fitted]) if fitted else np.zeros((0, x.width), np.float32)
        return cls(members, weights, np.array([b for _, b in fitted]))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The winner, and a score from 0 to 1: the logistic of its smallest margin against another member."""
        if len(self.members) == 1:
            return self.members[0], 1.0
        margins = self.weights @ x + self.offsets
        n = len(self.members)
        votes, total, least = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        for (a, b), m in zip(combinations(range(n), 2), margins, strict=True):
            votes[a if m >= 0 else b] += 1
            total[a], total[b] = total[a] + m, total[b] - m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(range(n), key=lambda i: (votes[i], total[i]))
        return self.members[best], float(1.0 / (1.0 + np.exp(-4.0 * least[best])))


@dataclass(frozen=True)
class LanguageModel:
    families: Machines | None = None
    languages: dict[str, Machines] = field(default_factory=dict)
    bits: int = BITS

    @classmethod
    def fit(cls, x: Profiles, langs: np.ndarray, bits: int = BITS) -> LanguageModel:
        if not len(x):
            return cls(bits=bits)
        family = np.array([FAMILY_OF.get(lang, f"only {lang}") for lang in langs])
        within = {f: Machines.fit(x[family == f], langs[family == f]) for f in sorted(set(family))}
        return cls(Machines.fit(x, family), within, bits)

    def predict(self, text: str) -> tuple[str, float]:
        x = profile(text, self.bits) if text else None
        if x is None or self.families is None:
            return "und", 0.0
        family, sure = self.families.predict(x)
        lang, surer = self.languages[family].predict(x)
        return lang, sure * surer


def held_out() -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learning_rows(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``lang, text``: at most so many labelled rows of each language, by the smallest hashes of id, then of text.

    Rows are counted first. A cut on the hash then leaves about four times as many ids as are wanted, so what is ranked
    does not grow with the table; the least hash of a language stays in any case. The choice looks at ids and labels only; the
    chosen ids, stored, are joined to the texts, and rows that share an id are ranked again, so their number is bounded too.
    """
    rows = pick(docs, doc_id="doc_id", lang="lang", text="text")
    open_rows = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()
    h = F.xxhash64("doc_id")
    ids = rows.filter(open_rows).select("doc_id", "lang", h.alias("h"))
    counts = settle(ids.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")), "language-counts")
    share = F.least(F.lit(1.0), F.lit(float(CUT * rows_per_language)) / F.col("n"))
    low = F.col("h").cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)
    close = ids.join(counts, "lang").filter(low | (F.col("h") == F.col("least"))).select("doc_id", "lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = settle(close.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rows_per_language).drop("k"), "language-ids")
    again = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"), "text")
    found = rows.filter("text IS NOT NULL").join(chosen, ["doc_id", "lang"]).withColumn("k", F.row_number().over(again))
    return found.filter(F.col("k") <= rows_per_language).select("lang", "text")


def fit_languages(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, bits: int = BITS) -> LanguageModel:
    """Machines fitted on the driver from a bounded sample, whose profiles are made by tasks."""

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = []
            for lang, text in zip(part.column(0).to_pylist(), as_texts(part.column(1)), strict=True):
                middle = max(0, len(text) // 2 - EXCERPT // 2)
                for piece in (text, text[middle : middle + EXCERPT]):
                    x = profile(piece, bits)
                    if x is not None:
                        at = np.flatnonzero(x)
                        rows.append((lang, at.astype("<u4").tobytes(), x[at].astype("<f4").tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.binary(), pa.binary()], strict=True)], names=["lang", "at", "x"])

    found = learning_rows(docs, rows_per_language).mapInArrow(profiles, "lang string, at binary, x binary").toPandas()
    found = found.sort_values(["lang", "at", "x"], ignore_index=True)
    rows = [(np.frombuffer(at, "<u4"), np.frombuffer(values, "<f4")) for at, values in zip(found["at"], found["x"], strict=True)]
    return LanguageModel.fit(Profiles(rows, 1 << bits), found["lang"].to_numpy(dtype=object), bits)


def with_language(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``rows`` with ``lang_pred`` and ``score`` from their last column, ``text``."""
    known = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages and of dimensions

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            said = [known.value.predict(text) for text in as_texts(part.column(part.num_columns - 1))]
            more = [pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*part.schema.names[:-1], "lang_pred", "score"])

    kept = rows.drop("text")
    schema = kept.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return rows.select(*kept.columns, "text").mapInArrow(predict, schema)


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    model = model or fit_languages(docs)
    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", held_out().alias("held_out"), "text")
    return with_language(rows, model)


def in_known_language(docs: DataFrame, model: LanguageModel | None = None, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns.

    Documents without a letter go; a ``least_score`` above 0 also drops those that no language fits clearly. The text is
    read from the row itself, so tasks and their workers hold it once.
    """
    model = model or fit_languages(docs)
    at = position(docs, "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            said = [known.value.predict(text) for text in as_texts(part.column(0).field(at))]
            yield pa.RecordBatch.from_arrays([part.column(0)], names=["row"]).filter(pa.array([lang != "und" and score >= least_score for lang, score in said], pa.bool_()))

    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = wrap(docs)
    return unwrap(rows.mapInArrow(keep, rows.schema), docs)
