"""Divergence of sources: brute force over dense tables, colliding digests, awkward rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from checks.compare import compare, connect
from epilattice.llm import source_audit
from epilattice.llm.catalog import SQL, op12_source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least_docs=3, top=200, scale=10**9):
    docs = [tuple(x or "" for x in row) for row in docs]
    found, by_doc = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = TERM.findall(text.translate(LOWER))
        found[lang, source].update(terms)
        by_doc[lang].update(set(terms))
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in by_doc[lang].items() if n >= least_docs]
        sources = sorted({d[1] for d in docs if d[0] == lang})

        def shares(counts):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + scale * (counts[t] + 1) // size for t in kept}

        q = shares(sum((found[lang, s] for s in sources), Counter()))
        p = {s: shares(found[lang, s]) for s in sources}
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])}
    return out


def made(rng, n):
    words = ["the", "The", "a", "b'c", "Äpfel", "äpfel", "x1y", "z_q", "日本", "ÉÉ"] + [f"w{chr(97 + i)}" for i in range(26)]
    for _ in range(n):
        source = rng.choice(["hot"] * 5 + ["s1", "s2", "s3", None, ""])
        yield rng.choice(["en", "en", "de", None]), source, rng.choice([None, "", " 12 !"] + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(8)])


def result(spark, docs, **more):
    table = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    return {tuple(r) for r in source_audit.source_divergence(table, **more).collect()}


def test_equals_brute_force(spark):
    docs = list(made(random.Random(1), 150))
    assert result(spark, docs) == brute(docs)


def test_colliding_digests_are_split(spark):
    docs = list(made(random.Random(2), 60))
    assert result(spark, docs, digest_bits=3, top=5) == brute(docs, top=5)


def test_ties_at_the_last_place_are_taken_by_bytes(spark):
    docs = [("en", "a", "é z y x w v ž"), ("en", "a", "é z y x w v ž"), ("en", "b", "other words are here"), ("en", "a", "é z y x w v ž")]
    assert result(spark, docs, top=3) == brute(docs, top=3)


def test_counts_are_whole_when_tasks_hand_on_early(spark):
    docs = spark.createDataFrame([(i % 2, i % 6, t or "") for i, (_, _, t) in enumerate(made(random.Random(3), 900))], "l long, g long, text string").coalesce(1)
    sums = lambda held: {tuple(r) for r in source_audit.term_counts(docs, held).groupBy("l", "g", "term").sum("n", "docs").collect()}
    assert source_audit.term_counts(docs, 5).count() > source_audit.term_counts(docs).count()
    assert sums(5) == sums(10**6)


def test_awkward_rows(awkward, nothing):
    rows = awkward.toDF(*[f"c{i}" for i in range(len(awkward.columns))]).select("c2", "c3", "c1").collect()
    assert {tuple(r) for r in source_audit.source_divergence(awkward).collect()} == brute([tuple(r) for r in rows])
    assert source_audit.source_divergence(nothing).collect() == []


def test_without_kept_terms(spark):
    docs = [("en", "a", "one two"), ("en", "b", None), ("de", "c", "drei")]
    assert result(spark, docs) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


@pytest.mark.parametrize("size", [1, 7])
def test_blocks_do_not_matter(spark, monkeypatch, size):
    docs = list(made(random.Random(4), 60))
    monkeypatch.setattr(source_audit.pair_values, "__defaults__", (size,))
    assert result(spark, docs) == brute(docs)


def test_query_equals_sql(spark, small):
    assert compare(op12_source_audit(spark, small), connect(small), SQL["op12_source_audit"]) == ""
