"""Canonical length-limited Huffman files of token ids.

Counts over all ids give one code per vocabulary. Documents are written in ascending order of their id; every file holds
the code lengths, so it can be read by itself, and independent blocks of whole documents. A block keeps the bit offset
of every ``STEP``-th id, so its stretches are decoded side by side with one table lookup per id.

Defined results: a null text is an empty document (only the end id); a null doc_id sorts first; repeated rows and equal
ids stay separate documents, next to each other; an empty table gives no files and no rows; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilattice.llm.files import FILE_BYTES, Files, read_files
from epilattice.llm.rows import chunks
from epilattice.llm.tokens import id_kind, token_ids
from epilattice.session import scratch_path, settle

MAGIC = b"EPHUF1\0\0"
#: Longest code in bits: the size of the decoding table is two to this power.
MAX_LENGTH = 16
#: Ids between two checkpoints of a block, and ids in a block (a longer document makes a longer block).
STEP, BLOCK_IDS = 128, 1 << 18
#: Ids above this are refused: counts per id are held on the driver, so the vocabulary has to be bounded.
MAX_VOCABULARY = 1 << 20


def code_lengths(counts: np.ndarray, longest: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over ``longest`` (package-merge); 0 for ids that do not occur.

    Level by level, pairs of the cheapest items of the level below become packages that compete with the leaves. The
    first ``2n - 2`` items of the top level are taken; how many leaves and how many packages are among them follows down
    through the levels, and each level adds one bit to its cheapest leaves.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids do not fit into codes of {longest} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.int64)
    packages, is_leaf = np.empty(0, dtype=np.int64), []
    for _ in range(longest):
        items = np.concatenate([leaves, packages])
        rank = np.argsort(items, kind="stable")
        is_leaf.append(rank < len(leaves))
        items = items[rank][: len(rank) // 2 * 2]
        packages = items[0::2] + items[1::2]
    taken, bits = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.int64)
    for level in reversed(is_leaf):
        n = int(level[:taken].sum())
        bits[:n] += 1
        taken = 2 * (taken - n)
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code = before = 0
    for i in order[np.count_nonzero(lengths == 0) :]:
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next ``longest`` bits."""
    ids, bits = np.zeros(1 << longest, dtype=np.uint32), np.zeros(1 << longest, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    ordered = used[np.lexsort((used, lengths[used]))]
    width = np.int64(1) << (longest - lengths[ordered].astype(np.int64))
    ids[: width.sum()], bits[: width.sum()] = np.repeat(ordered, width), np.repeat(lengths[ordered], width)
    return ids, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bit offsets of every ``STEP``-th id, and the bits, most significant first."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    word = at >> 5
    wide = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
    n = int(end[-1] >> 5) + 2 if len(ids) else 0
    # No two codes share a bit, so sums are unions, and each stays far below the exact range of a double.
    high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), minlength=n)
    low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    packed = (high + low).astype(np.uint64).astype(">u4").tobytes()
    return at[::STEP], packed[: (int(end[-1]) + 7) // 8] if len(ids) else b""


def decode_block(data: bytes, offsets: np.ndarray, n: int, ids: np.ndarray, bits: np.ndarray, longest: int) -> np.ndarray:
    """All ``n`` ids of a block; the stretch after each checkpoint is a lane of its own."""
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
    window = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
    at, out = offsets.astype(np.int64), np.empty((len(offsets), STEP), dtype=np.uint32)
    last = n - (len(offsets) - 1) * STEP
    for k in range(STEP):
        lanes = len(at) if k < last else len(at) - 1
        here = at[:lanes]
        shift = (40 - longest - (here & 7)).astype(np.uint64)
        next_bits = (window[here >> 3] >> shift) & np.uint64((1 << longest) - 1)
        out[:lanes, k] = ids[next_bits]
        at[:lanes] = here + bits[next_bits]
    return out.reshape(-1)[:n]


def pack_file(blocks: list[bytes], lengths: np.ndarray) -> bytes:
    table = zlib.compress(lengths.tobytes())
    return b"".join([MAGIC, struct.pack("<III", len(lengths), len(table), len(blocks)), table, *blocks])


def pack_block(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    offsets, data = encode_block(ids, codes, lengths)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    parts = [np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), known.tobytes(), np.array(sizes, dtype="<u4").tobytes(), offsets.astype("<u8").tobytes(), data]
    return struct.pack("<IQQ", len(doc_ids), len(ids), len(data)) + b"".join(parts)


def unpack_file(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document of a file in its order, block by block."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of Huffman-coded ids")
    vocabulary, n_table, n_blocks = struct.unpack_from("<III", content, 8)
    lengths = np.frombuffer(zlib.decompress(content[20 : 20 + n_table]), dtype=np.uint8)
    if len(lengths) != vocabulary:
        raise ValueError("the table of code lengths is damaged")
    longest = max(int(lengths.max(initial=1)), 1)
    table = decoding_table(lengths, longest)
    at = 20 + n_table
    for _ in range(n_blocks):
        docs, n, n_data = struct.unpack_from("<IQQ", content, at)
        at += 20
        take = lambda kind, count, at: np.frombuffer(content, kind, count, at)
        doc_ids, known = take("<i8", docs, at), take("u1", docs, at + 8 * docs)
        sizes = take("<u4", docs, at + 9 * docs)
        at += 13 * docs
        marks = -(-n // STEP)
        offsets = take("<u8", marks, at)
        at += 8 * marks
        ids = decode_block(content[at : at + n_data], offsets, n, *table, longest) if n else np.empty(0, np.uint32)
        at += n_data
        ends = np.cumsum(sizes)
        for doc_id, ok, a, b in zip(doc_ids, known, ends - sizes, ends, strict=True):
            yield (int(doc_id) if ok else None), ids[a:b]


def count_ids(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs: counted per task first, so at most a vocabulary of rows leaves a task."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for part in chunks(batches):
            ids = np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=kind)
            if len(ids) and int(ids.max()) >= MAX_VOCABULARY:
                raise ValueError(f"an id is beyond {MAX_VOCABULARY}")
            counts = np.bincount(ids, minlength=len(total))
            counts[: len(total)] += total
            total = counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(per_task, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["id"]] = rows["n"]
    return counts


def write_huffman(tokens: DataFrame, kind: str, folder: str, longest: int = MAX_LENGTH, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``tokens`` (doc_id, ids as bytes of ``kind``) below ``folder`` in ascending order of doc_id.

    Returns the committed files: ``part`` and ``place`` (their order), ``file``, ``n_docs``, ``n_tokens``. ``tokens`` is
    read three times (counts, range bounds, writing) and should be a stored table.
    """
    spark = tokens.sparkSession
    lengths = code_lengths(count_ids(tokens, kind), longest)
    codes = canonical(lengths)
    code = spark.sparkContext.broadcast((codes, lengths))  # at most MAX_VOCABULARY entries

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, lengths = code.value
        out, done, width = Files(folder, ".ephuf"), [], int(kind[2])
        blocks: list[bytes] = []
        held, docs, sizes, n = [], [], [], 0
        file_docs = file_ids = 0

        def close_block() -> None:
            nonlocal held, docs, sizes, n, file_docs, file_ids
            if docs:
                blocks.append(pack_block(docs, sizes, np.frombuffer(b"".join(held), dtype=kind), codes, lengths))
                file_docs, file_ids = file_docs + len(docs), file_ids + n
            held, docs, sizes, n = [], [], [], 0

        def close_file() -> None:
            nonlocal blocks, file_docs, file_ids
            close_block()
            if blocks:
                done.append((TaskContext.get().partitionId(), len(done), out.write(pack_file(blocks, lengths)), file_docs, file_ids))
            blocks, file_docs, file_ids = [], 0, 0

        for part in chunks(batches):
            for doc_id, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.append(ids)
                docs.append(doc_id)
                sizes.append(len(ids) // width)
                n += sizes[-1]
                if n >= BLOCK_IDS:
                    close_block()
                    if sum(map(len, blocks)) >= file_bytes:
                        close_file()
        close_file()
        columns = list(zip(*done, strict=True)) if done else [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "place", "file", "n_docs", "n_tokens"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = tokens.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    listed = ordered.mapInArrow(write, "part int, place int, file string, n_docs long, n_tokens long")
    return settle(listed, "huffman-files")


def read_huffman(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the listed files.

    ``start`` counts the ids of all documents before it. Only the list of files, one row each, is put in order in one
    task; files are decoded one at a time.
    """
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    starts = listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, rows, held = batch.column(0)[k].as_py(), [], 0
                for doc_id, ids in unpack_file(batch.column(1)[k].as_py()):
                    rows.append((doc_id, at, len(ids), ids.astype("<u4").tobytes()))
                    at, held = at + len(ids), held + len(ids)
                    if held >= BLOCK_IDS:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    return read_files(spark, folder, starts).select("start", "content").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def huffman_round_trip(docs: DataFrame, tokenizer: str, end_id: int, longest: int = MAX_LENGTH) -> DataFrame:
    """Encode documents, write the files, read them back: ``doc_id, start, n_tokens, ids`` (``<u4``)."""
    spark, kind = docs.sparkSession, id_kind(tokenizer, end_id)
    tokens = settle(token_ids(docs, tokenizer, end_id, kind), "token-ids")
    if not tokens.take(1):
        return tokens.selectExpr("doc_id", "0L AS start", "n_tokens", "ids").limit(0)
    folder = scratch_path(spark, "huffman")
    return read_huffman(spark, folder, write_huffman(tokens, kind, folder, longest))
