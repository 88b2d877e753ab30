"""Token ids of whole texts with a byte-level BPE file, piece by piece.

The tokenizer cuts a text into an optional space with letters, with digits or with other signs, and runs of white space;
no piece is looked at beside another one. A space between two visible signs always begins a piece, and a line end between
two visible signs is a piece, so texts are cut there and equal pieces are encoded once.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilattice.llm.rows import as_texts, chunks, pick
from epilattice.llm.tokens import _BYTE_LETTERS, WORDS_KEPT, packed


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces(dict):
    """Ids by piece, all of them with the same signs ``before``; a piece has no white space, or is the line end."""

    def __init__(self, tokenizer, before: str, kind: str, kept: int, marks: Pieces | None = None):
        super().__init__()
        self.tokenizer, self.before, self.kind, self.kept = tokenizer, before, kind, kept
        self.tokenize, self.marks = tokenizer.model.tokenize, self if marks is None else marks
        self.code = "H" if kind == "<u2" else "I"
        self.letter = before.encode().decode("latin-1").translate(_BYTE_LETTERS)

    def encoded(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def __missing__(self, piece: str) -> bytes:
        # Latin letters only go straight to the BPE model: there all versions of the letter classes agree.
        if piece.isalpha() and (piece.isascii() or max(piece) < "ɐ"):
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = array(self.code, [x.id for x in self.tokenize(self.letter + letters)])
            if sys.byteorder != "little":
                ids.byteswap()
            ids = ids.tobytes()
        elif piece[-1:] in (".", ",") and piece[:-1].isalpha() and (piece.isascii() or max(piece) < "ɐ"):
            ids = self[piece[:-1]] + self.marks[piece[-1]]
        else:
            ids = self.encoded(self.before + piece)
        if len(self) < self.kept:
            self[piece] = ids
        return ids


class TextIds:
    """Little-endian unsigned ids of a ``kind`` of whole texts; pieces that a worker has seen are kept, up to a number."""

    def __init__(self, path: str, kind: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.bare = Pieces(tokenizer, "", kind, kept // 8)
        self.spaced = Pieces(tokenizer, " ", kind, kept, self.bare)
        self.direct = self.bare.encoded

    def of(self, text: str) -> bytes:
        """Ids of a text. Texts with special tokens or with white space that does not stand alone go through as a whole."""
        if "<|" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1] in " \n":
            return self.direct(text)
        lines = [line.split(" ") for line in text.split("\n")]
        if text.split() != list(chain.from_iterable(lines)):
            return self.direct(text)  # there is white space of other kinds
        bare, spaced = self.bare, self.spaced.__getitem__
        return bare["\n"].join([bare[words[0]] + b"".join(map(spaced, words[1:])) for words in lines])


_KEPT: dict[tuple[str, str], TextIds] = {}


def coder(path: str, kind: str) -> TextIds:
    """One per worker process; it outlives a task."""
    if (path, kind) not in _KEPT:
        _KEPT[path, kind] = TextIds(path, kind)
    return _KEPT[path, kind]


def byte_token_ids(docs: DataFrame, tokenizer: str, end_id: int, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens``: ids of each whole text (null: empty) and then ``end_id``, as bytes of ``kind``.

    One row per input row; a null doc_id stays null. Nothing is shuffled.
    """
    end, width = packed([end_id], kind), int(kind[2])
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = coder(tokenizer, kind)
        for part in chunks(batches):
            ids = [texts.of(text) + end for text in as_texts(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64())],
                names=["doc_id", "ids", "n_tokens"],
            )

    return rows.mapInArrow(encode, "doc_id long, ids binary, n_tokens long")
