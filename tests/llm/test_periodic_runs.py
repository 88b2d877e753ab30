"""Periodic runs: brute force over all lags, awkward rows, long repeats in linear time."""

import hashlib
import random

import numpy as np
import pytest

from checks.compare import compare, connect
from epilattice.llm import periodic_runs
from epilattice.llm.catalog import SQL, op11_periodic_runs


def brute(words, exponent=4, least=6):
    """Every maximal stretch of every lag; of equal stretches the smallest lag."""
    n, found = len(words), {}
    for lag in range(1, n):
        i = lag
        while i < n:
            end = i
            while end < n and words[end] == words[end - lag]:
                end += 1
            if end > i and end - i + lag >= max(least, exponent * lag):
                found.setdefault((i - lag, end - i + lag), lag)
            i = max(end, i + 1)
    return sorted(((s, length, lag) for (s, length), lag in found.items()), key=lambda run: (run[0], run[2]))


def texts(rng, rounds):
    for _ in range(rounds):
        signs = rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(signs) for _ in range(rng.randint(0, 50))]
        while rng.random() < 0.6 and len(words) < 140:
            unit = [rng.randrange(signs) for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * rng.randint(2, 8))[: rng.randint(1, 60)]
        yield words


def test_runs_of_random_words():
    rng = random.Random(7)
    for words in texts(rng, 3000):
        exponent, least = rng.choice([2, 3, 4, 4]), rng.choice([1, 6])
        assert periodic_runs.word_runs(np.array(words, np.int64), exponent, least) == brute(words, exponent, least), words


@pytest.mark.parametrize("period", [1, 7, 1000])
def test_one_long_repeat_opens_few_diagonals(period):
    words = np.arange(60_000) % period
    assert periodic_runs.word_runs(words) == [(0, 60_000, period)]
    assert len(periodic_runs.openings(words)) <= 60_000


def test_equal_passages_at_uneven_distances_open_no_diagonal():
    words = np.concatenate([np.append(np.arange(50), 1000 + i) for i in range(800)])
    assert periodic_runs.openings(words) == []


def test_awkward_rows(awkward, nothing):
    rows = periodic_runs.periodic_runs(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[3].n_words, by_id[3].runs, by_id[3].text) == (0, [], None)
    assert (by_id[4].n_words, by_id[4].text) == (0, "") and (by_id[5].n_words, by_id[5].text) == (0, "")
    fox = by_id[1]
    assert [tuple(r) for r in fox.runs] == [(0, 72, 9)] and fox.text == "The quick brown fox jumps over the lazy dog." and fox.n_dropped == 63
    assert [r.text for r in rows if r.doc_id == 2] == [fox.text] * 2
    assert periodic_runs.periodic_runs(nothing).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(awkward, exponent=1)


def test_collapsed_text_has_first_periods_only(spark):
    words = "a b c a b c a b c a b c x x x x x x x y a b c a b c a b c a b".split()
    (row,) = periodic_runs.periodic_runs(spark.createDataFrame([(1, "\t" + "\x0b\n ".join(words))], "doc_id long, text string")).collect()
    runs = brute(words)
    kept = [w for k, w in enumerate(words) if not any(s + p <= k < s + n for s, n, p in runs)]
    assert [tuple(r) for r in row.runs] == runs and row.text.split(" ") == kept


def test_query_equals_sql(spark, small):
    result = op11_periodic_runs(spark, small)
    assert compare(result, connect(small), SQL["op11_periodic_runs"]) == ""
    empty = hashlib.sha256(b"").hexdigest()
    assert result.filter("runs_sha256 IS NULL OR collapsed_sha256 IS NULL").count() == 0
    assert result.filter(f"n_runs = 0 AND (runs_sha256 <> '{empty}' OR start IS NOT NULL OR exponent_milli IS NOT NULL)").count() == 0
    assert result.filter("n_runs > 0").count() > 0
