"""Byte-level ids, repeat counts by least squares, plans and packed tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epilattice.llm import byte_tokens, length_packing
from epilattice.llm.catalog import op13_length_packing

PATH = byte_tokens.byte_tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_pieces_give_the_ids_of_the_whole_text(text):
    texts = byte_tokens.coder(PATH, "<u4")
    assert texts.of(text) == texts.direct(text)


def test_random_pieces_of_many_scripts():
    texts, rng = byte_tokens.coder(PATH, "<u4"), random.Random(5)
    signs = ["a", "Z", "é", "ß", "'s", "'ll", ".", ",", "1", " ", " ", "  ", "\n", "\t", "Σ", "İ", "<|endoftext|>", "漢", "\U0001f642", "\x1c", "\x85", "　", "½", "Ⅷ", "ª", "\xa0", "word"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert texts.of(text) == texts.direct(text), text


def test_combinations_fill_the_window():
    found = {tuple(sorted(x for x in row if x)) for row in length_packing.combinations(12, np.ones(12, bool)).tolist()}
    assert found == {t for a in range(0, 12) for b in range(1, 12) for c in range(1, 12) if a + b + c == 12 and a <= b <= c for t in [tuple(x for x in (a, b, c) if x)]}
    assert set(map(tuple, length_packing.combinations(12, np.isin(np.arange(12), [3, 9, 6])).tolist())) == {(0, 3, 9), (0, 6, 6), (3, 3, 6)}


def projected_gradient(combos, histogram, rounds=60_000):
    """The same problem, slowly: dense matrix, plain steps."""
    size = len(histogram)
    a = np.zeros((size, len(combos)))
    for column, lengths in enumerate(combos):
        for n in lengths:
            a[n, column] += 1
    weight = np.arange(size) / size
    a, b = a * weight[:, None], histogram * weight
    step, x = 1 / np.linalg.norm(a, 2) ** 2, np.zeros(len(combos))
    for _ in range(rounds):
        x = np.maximum(0, x - step * (a.T @ (a @ x - b)))
    return float(np.sum((a @ x - b) ** 2))


def test_least_squares_reach_the_least_error():
    rng = np.random.default_rng(2)
    for _ in range(4):
        histogram = rng.integers(0, 40, 24).astype(float)
        histogram[0] = 0
        combos = length_packing.combinations(24, histogram > 0)
        x = length_packing.repeat_counts(combos, histogram, tolerance=0.0)
        weight = np.arange(24) / 24
        used = np.bincount(combos.ravel(), np.repeat(x, 3), minlength=24)
        error = float(np.sum((weight * (used - histogram)) ** 2))
        assert (x >= 0).all() and error <= projected_gradient(combos, histogram) * 1.01 + 1e-6


def test_repeat_counts_do_most_of_the_work():
    sizes = np.random.default_rng(3).integers(1, 256, 50_000)
    histogram = np.bincount(sizes, minlength=257)
    combos = length_packing.combinations(256, histogram[:256] > 0)
    x = length_packing.repeat_counts(combos, histogram[:256].astype(float))
    used = np.bincount(combos.ravel(), np.repeat(x, 3), minlength=256)
    tokens = np.arange(256)
    assert (tokens * np.abs(used - histogram[:256])).sum() < 0.05 * sizes.sum()


@pytest.mark.parametrize("window", [1, 2, 8, 64])
def test_plans_place_every_piece_without_padding(window):
    rng = np.random.default_rng(window)
    for n in [0, 1, 2, 5, 60, 500] * 4:
        sizes = rng.integers(1, window + 1, n)
        if n > 10:
            sizes[: n // 3] = sizes[0]
        plan = length_packing.plan_of(np.bincount(sizes, minlength=window + 1), window)
        seen, sequences = Counter(), defaultdict(list)
        for size in sizes.tolist():
            places = list(plan.place(size, seen[size]))
            seen[size] += 1
            assert sum(taken for taken, _, _ in places) == size
            for taken, sequence, offset in places:
                sequences[sequence].append((offset, taken))
        check_sequences(sequences, int(sizes.sum()), window)


def check_sequences(sequences, tokens, window):
    """Gapless, not over the window, full or a power of two, and as few as can be."""
    for pieces in sequences.values():
        at = 0
        for offset, taken in sorted(pieces):
            assert offset == at and taken > 0
            at += taken
        assert at == window or (at < window and at & (at - 1) == 0)
    assert len(sequences) == tokens // window + bin(tokens % window).count("1")


def check_pieces(rows, given, plain, window, kind="<u2"):
    """All ids of every document once, in pieces that follow each other."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r.doc_id, r.copy].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    found = Counter()
    for (doc_id, _), pieces in documents.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1])
        ids = b"".join(r.ids for r in pieces)
        assert all(r.doc_tokens * int(kind[2]) == len(ids) and len(r.ids) == r.length * int(kind[2]) for r in pieces)
        found[doc_id, ids] += 1
    expected = Counter((i, np.array([*plain(t), 0], kind).tobytes()) for i, t in given)
    assert found == expected
    check_sequences(sequences, sum(len(ids) // int(kind[2]) * n for (_, ids), n in expected.items()), window)


@pytest.mark.parametrize("window", [16, 1024])
def test_awkward_rows(awkward, nothing, plain, window):
    given = [(r[0], r[1]) for r in awkward.collect()]
    rows = length_packing.pack_lengths(awkward, PATH, window=window).collect()
    check_pieces(rows, given, plain, window)
    assert length_packing.pack_lengths(nothing, PATH, window=window).collect() == []


def test_one_length_for_all_and_a_shuffled_input(spark, plain):
    given = [(i, "one two three four five" if i % 3 else f"word number {i}") for i in range(700)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    check_pieces(length_packing.pack_lengths(docs, PATH, window=32).collect(), given, plain, 32)


def test_query_over_a_table(spark, small, documents, plain):
    given = {r.doc_id: [*plain(r.text), 0] for r in documents.select("doc_id", "text").collect()}
    rows, sequences, seen = op13_length_packing(spark, small).collect(), defaultdict(list), Counter()
    for r in rows:
        part = given[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(given[r.doc_id])
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: len(ids) for i, ids in given.items()}
    check_sequences(sequences, sum(map(len, given.values())), 1024)
