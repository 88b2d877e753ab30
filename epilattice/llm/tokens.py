"""Token ids of whole texts with a tokenizer file, word by word."""

from __future__ import annotations

import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epilattice.llm.rows import as_texts, chunks, pick

#: Words whose ids a Python worker keeps. Further words are encoded each time they occur.
WORDS_KEPT = 400_000

# Letters that the byte-level alphabet uses for bytes: printable Latin-1 stands for itself, the rest follows from 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(ids: list[int], kind: str) -> bytes:
    """Ids as little-endian unsigned integers of numpy's ``kind``, ``<u2`` or ``<u4``."""
    code = {"<u2": "H", "<u4": "I"}[kind]
    if sys.byteorder == "little" and array(code).itemsize == int(kind[2]):
        return array(code, ids).tobytes()
    return np.array(ids, dtype=kind).tobytes()


def id_kind(path: str, *more: int) -> str:
    """The narrowest kind for all ids of a tokenizer and some more ids: ids are stored and shuffled in it."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)
    return "<u2" if max(most, *more) < 1 << 16 else "<u4"


class WordIds(dict):
    """Little-endian unsigned ids of a ``kind`` by lower-cased word.

    The tokenizer cuts texts at white space, runs of letters, single digits and runs of other signs, and looks at no
    piece beside another one, so the ids of a text are those of its words in order. Words of letters only go straight
    to its BPE model; a full stop or comma after such a word is a piece of its own; all else goes through the whole
    tokenizer.
    """

    def __init__(self, path: str, kind: str, kept: int = WORDS_KEPT):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.kind, self.kept = self.tokenizer.model, kind, kept

    def direct(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = packed([piece.id for piece in self.model.tokenize(letters)], self.kind)
        elif word[-1] in ".," and word[:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        else:
            ids = self.direct(word)
        if len(self) < self.kept:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        """Ids of a text. Texts in which words do not stand alone go through the tokenizer as a whole."""
        if "<|" in text or any(sign in text for sign in "\x1c\x1d\x1e\x1f"):
            return self.direct(text)
        if not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text)):
            return self.direct(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


_KEPT: dict[tuple[str, str], WordIds] = {}


def coder(path: str, kind: str) -> WordIds:
    """One per worker process; it outlives a task."""
    if (path, kind) not in _KEPT:
        _KEPT[path, kind] = WordIds(path, kind)
    return _KEPT[path, kind]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens``: ids of each whole text (null: empty) and then ``end_id``, as bytes of ``kind``.

    One row per input row; a null doc_id stays null. Nothing is shuffled.
    """
    end, width = packed([end_id], kind), int(kind[2])
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer, kind)
        for part in chunks(batches):
            ids = [words.of(text) + end for text in as_texts(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64())],
                names=["doc_id", "ids", "n_tokens"],
            )

    return rows.mapInArrow(encode, "doc_id long, ids binary, n_tokens long")


def ids_crc32(ids: Column, kind: str) -> Column:
    """Unsigned CRC-32 of ids of a ``kind``, taken as little-endian unsigned 32-bit integers."""

    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes())).astype("int64")

    return F.pandas_udf(crc, T.LongType())(ids)
