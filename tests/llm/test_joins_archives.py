"""Shingle join, archives, decontamination and the pipeline against brute force; awkward rows."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from epilattice.llm import decontaminate, graphs, shingle_join, warc
from epilattice.llm.catalog import QUERIES


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_query_op8_equals_brute_force(spark, small, documents):
    want = brute_components([(r.doc_id, r.text) for r in documents.collect()], 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_shingle_join"](spark, small).collect()} == want


@pytest.mark.parametrize("size, percent, seed", [(3, 90, 1), (3, 60, 2), (5, 80, 3)])
def test_chains_of_near_copies(spark, size, percent, seed):
    """Families of edited texts and a phrase that all share: links form chains, lists are long."""
    rng, rows = random.Random(seed), []
    for family in range(6):
        words = [f"f{family}w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 90))]
        for _ in range(25):
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(["one phrase that all of them share"] * (family % 2) + words)))
    rng.shuffle(rows)
    got = shingle_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, size, percent)


@pytest.mark.parametrize("part_sets, percent", [(256, 60), (4, 60), (4, 80)])
def test_links_equal_brute_force(spark, monkeypatch, part_sets, percent):
    monkeypatch.setattr(shingle_join, "PART_SETS", part_sets)
    rng, rows = random.Random(7), []
    for family in range(3):
        words = [f"f{family}w{k}" for k in range(40)]
        for _ in range(12):
            words = list(words)
            words[rng.randrange(40)] = f"x{rng.randint(0, 10**6)}"
            rows += [(len(rows) + k, " ".join(words)) for k in range(rng.choice([1, 1, 3]))]
    rows += [(None, rows[0][1]), (900, None), (901, "of its own")]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in ((t or "").split() for _, t in rows)]
    want = [(r[0], sum(bool(x) and k != i and 100 * len(x & y) >= percent * len(x | y) for k, y in enumerate(sets))) for i, (r, x) in enumerate(zip(rows, sets, strict=True))]
    got = shingle_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent)
    assert sorted((str(r.doc_id), r.n_links) for r in got.collect()) == sorted((str(i), n) for i, n in want)


def test_shingles_of_awkward_rows(awkward, nothing):
    got = defaultdict(set)
    for r in shingle_join.shingle_components(awkward).collect():
        got[r.doc_id].add((r.n_shingles > 0, r.component_id))
    assert got[1] == got[2] == {(True, 1)}
    assert got[3] == {(False, 3)} and got[4] == {(False, 4)} and got[5] == {(False, 5)}
    assert got[None] == got[11] == got[12] == {(True, 11)}
    assert got[13] == got[14] == {(True, 13)}
    assert shingle_join.shingle_components(nothing).count() == 0


def test_bit_maps_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        assert shingle_join.most_common(shingle_join.bit_map(x), len(x), shingle_join.bit_map(y), len(y)) >= len(np.intersect1d(x, y))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    random.Random(1).shuffle(links)
    got = {r.node: r.label for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, size int")


@pytest.mark.parametrize("least", [0, 3])
def test_archives_of_awkward_pages(spark, least):
    rows = [(5, "http://a/", "same"), (3, None, "same"), (9, "http://b/ x\n", "same"), (1, "u", None), (2, "u", ""), (None, "v", "same"), (7, "w", "é漢" * 9000), (7, "w", "é漢" * 9000)]
    got = warc.archive(pages_of(spark, rows), least, payloads=True).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        again = len(p) >= least and first.get(html or "") is not None and i != first[html or ""]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None, p))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got], key=key) == sorted(want, key=key)
    assert warc.archive(pages_of(spark, [])).count() == 0


def test_damage_in_an_archive_is_noticed():
    data = warc.record(1, "u", b"payload", "D", False, None, None)
    assert warc.parse(data)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"paYload"))


def test_query_op9(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    first = {}
    for r in sorted(pages, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    for r in QUERIES["op9_warc_revisits"](spark, folder).collect():
        html = next(p.html for p in pages if p.page_id == r.page_id) or ""
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(html.encode()), *(("response", None) if first[html] == r.page_id else ("revisit", first[html])))


ITEM = "Kova redn stell amber quint. The orb was veld and nire across. Salt farn answers zemble torq."


def test_leaks_exact_and_paraphrased(spark):
    words = ITEM.split()
    loose = " ".join(w for i, w in enumerate(words) if i % 6 != 2)  # words left out
    swapped = " ".join("zzz" if i in (4, 9) else w for i, w in enumerate(words))
    filler = " ".join(f"fill{i}" for i in range(200))
    docs = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler} {loose}"), (3, f"{swapped} {filler}"), (4, filler), (5, " ".join(sorted(words)) + " " + filler), (6, None), (7, ""), (None, ITEM)]
    bench = spark.createDataFrame([(10, ITEM, "x"), (11, None, "x"), (12, "", "x")], "item_id long, text string, cosine string")
    table = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, k1 int, row string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()} == {(1, 10), (2, 10), (3, 10), (None, 10)}
    kept = decontaminate.without_leaks(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7}
    assert decontaminate.leaks(table, bench.limit(0)).count() == 0
    assert decontaminate.leaks(table.limit(0), bench).count() == 0


def test_candidate_search_recall(spark):
    """Against brute force: every place where a window holds an item's words in order."""
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontaminate"](spark, folder).collect()}
    words = {r.item_id: tuple(decontaminate.words_of(r.text)) for r in items}
    want, sets = set(), {i: set(w) for i, w in words.items()}
    for d in docs:
        own = decontaminate.words_of(d.text or "")
        there = set(own)
        for i, w in words.items():
            if len(sets[i] & there) >= 0.8 * len(sets[i]):
                n = len(w)
                share = max(decontaminate.common_in_order(w, own[k : k + 2 * n]) for k in range(0, len(own), n)) / n
                if share >= decontaminate.ALONE:
                    want.add((d.doc_id, i))
    assert want and len(want & got) >= 0.9 * len(want)
    assert len(got - want) <= 0.05 * len(got)


def test_no_passage_is_lost_beyond_the_rank(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(40 if i < 270 else 8))) for i in range(400)]
    near = lambda: [f"i{rng.integers(270)}w{rng.integers(40)}" for _ in range(12)]
    docs = [(i, " ".join([*near(), text, *near()])) for i, text in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sizes = [len(b) for b in decontaminate.blocks(bench)]
    assert sum(sizes) == 400 and max(sizes) <= decontaminate.RANK and len(sizes) == 2
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(i, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in found.select("doc_id", "item_id").collect()}


def test_passage_rows_need_no_python_worker(spark):
    rows = decontaminate.passage_rows(spark, [[0, 2], [1]], np.array([0.5, 1.0, 2.0]))
    assert rows.dtypes == [("ids", "array<int>"), ("values", "array<double>")]
    assert "LocalRelation" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.ids, r["values"]) for r in rows.collect()] == [([0, 2], [0.5, 2.0]), ([1], [1.0])]


def test_common_subsequence_equals_the_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert decontaminate.common_in_order(tuple(a), b) == rows[-1][-1]


def test_randomised_svd_of_a_low_rank_table(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((60, 5)) @ rng.standard_normal((5, 40))
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in a], "ids array<int>, values array<double>").repartition(3)
    vectors, size = decontaminate.randomised_svd(rows, 40, 5)
    assert np.allclose(size, np.linalg.svd(a)[1][:5]) and np.allclose(a @ vectors @ vectors.T, a)


def test_pipeline_against_brute_force(spark, small, documents):
    import corpus_pipeline as pipeline
    from tests.llm.test_tokens_files import PATH, check_packing

    rows = {r.doc_id: r.text for r in documents.collect()}
    rows = {i: t for i, t in rows.items() if t and any(map(str.isalpha, t))}
    seen, cleaned = set(), {}
    for i in sorted(rows):
        lines = rows[i].split("\n")
        full = [k for k, line in enumerate(lines) if line.strip(" \t\r\x0b\x0c")]
        gone = set()
        for a in range(len(full) - 2):
            key = tuple(lines[full[a + k]] for k in range(3))
            if key in seen:
                gone |= set(range(full[a], full[a + 2] + 1))
            seen.add(key)
        cleaned[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    kept = {i for i, (_, c) in brute_components(cleaned.items(), 5, 80).items() if c == i}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    runs = lambda w, n=8: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    own = {i: runs(decontaminate.words_of(cleaned[i])) for i in kept}
    left = {i for i in kept if not any(len(runs(w) & own[i]) >= 0.5 * len(runs(w)) for w in items if runs(w))}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    check_packing(pipeline.run(spark, small).collect(), [(i, whole.encode(cleaned[i], add_special_tokens=False).ids + [0]) for i in left])


def test_stages_keep_the_columns(spark, awkward, small):
    import corpus_pipeline as pipeline

    docs = awkward
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == awkward.columns and docs.count() > 0
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, awkward.limit(0), small).count() == 0


def test_a_pair_comes_from_its_first_common_list(spark, monkeypatch):
    """Four sets of one size under the same five shingles: 12 rows of lists a pivot could join, one row for each pair."""
    rows = [(token, 0, bytes([sig]), 100, token, bytes([sig]), None, None) for token in range(5) for sig in range(4)]
    lists = spark.createDataFrame(rows, "token long, block int, sig binary, n long, pos int, label binary, ref binary, far double")
    monkeypatch.setattr(type(lists), "distinct", lambda df: df)  # rows as the join makes them
    pairs = shingle_join.candidates(shingle_join.with_earlier(lists), 64, 1, 90)[0]
    got = sorted((bytes(r.a), bytes(r.b)) for r in pairs.collect())
    want = sorted({(bytes([x]), bytes([y])) for x in range(4) for y in range(x + 1, 4)})
    assert sorted(set(got)) == want and len(got) <= 2 * len(want)  # a pair of two pivots comes from each of them


def test_few_sets_are_stored_again(spark, monkeypatch):
    """The index is not stored before its filter, bit maps of listed sets only; a component of two sets has known links."""
    rng, stored, made = random.Random(3), {}, []
    rows = [(k, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(120))) for k in range(40)]
    rows += [(100 + k, f"{rows[k][1]} end") for k in range(3)] + [(200, rows[0][1])]
    settle, needed = shingle_join.settle, shingle_join.needed_sets

    def settled(df, name):
        table = settle(df, name)
        stored.setdefault(name, []).append(table.count())
        return table

    def sets(docs, wanted, size):
        made.append(wanted.count())
        return needed(docs, wanted, size)

    monkeypatch.setattr(shingle_join, "settle", settled)
    monkeypatch.setattr(shingle_join, "needed_sets", sets)
    got = {r.doc_id: (r.component_id, r.n_links) for r in shingle_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "shingle-index" not in stored and stored["shingle-nodes"][0] == 6 and made == [6]
    assert [got[k] for k in (0, 1, 2, 3, 100, 101, 200)] == [(0, 2), (1, 1), (2, 1), (3, 0), (0, 2), (1, 1), (0, 2)]


@pytest.mark.parametrize("top", [1, 255, 256, 70_000])
def test_cells_are_packed_without_loss(top):
    cells = np.arange(0, top + 1, max(1, top // 50), dtype="<u4")
    assert (shingle_join.unpacked_cells(shingle_join.packed_cells(cells)) == cells).all()
