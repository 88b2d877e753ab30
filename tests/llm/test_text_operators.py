"""Line windows, chat, language, quality, personal data: SQL or brute force, and awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import compare, connect
from epilattice.llm import anomaly, chat, language, line_windows, pii
from epilattice.llm.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", ["op3_line_windows", "op6_chat_format"])
def test_query_equals_sql(spark, small, name):
    assert compare(QUERIES[name](spark, small), connect(small), SQL[name]) == ""


def test_line_windows_of_awkward_rows(awkward, nothing):
    out = line_windows.without_repeats(awkward)
    got = {(r[0], r[2]): r[1] for r in out.collect()}
    assert got[7, "en"].startswith("alpha beta gamma")
    assert got[8, "en"] == "intro line\noutro line"
    assert got[9, "en"] == ""
    assert got[3, "en"] is None and got[4, "fr"] == "" and got[13, "fr"] == "two words"
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.filter("doc_id = 8").first()["n_chars"] == len("intro line\noutro line")
    assert line_windows.without_repeats(nothing).count() == 0


def test_null_ids_find_themselves(spark):
    text = "a b\nc d\ne f"
    rows = spark.createDataFrame([(None, text), (3, text), (5, text)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_windows.without_repeats(rows).collect()} == {3: text, 5: "", None: ""}


def chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, valid int")


def test_chat_of_awkward_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "first"), (3, None, None, None), (3, 1, "user", "x"), (3, 1, "user", "x"),
        (None, 0, "user", "<|turn|>\\: \\ <|end|>"), (None, 1, "assistant", "<</SYS>></s><s>[/INST]\\:"), (4, 0, "sys<|text|>tem\n", "a"),
    ]
    got = {r.conv_id: r for r in chat.chat_digests(chat_rows(spark, [(*r, "s", 1) for r in rows])).collect()}
    assert [got[k].valid for k in (1, 2, 3, 4, None)] == [True, False, False, False, True]
    for k in got:
        own = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == k)
        said = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        loss = "".join(text for *_, role, text in own if role == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(chat_rows(spark, [])).count() == 0


def test_no_control_string_is_left_in_a_text(spark):
    t = chat.Template()
    texts = ["".join(t.controls), "<" * 3 + "s>" * 2, "\\:<\\:/s>", "[INST][INST]"]
    rows = chat_rows(spark, [(i, 0, "user", x, "s", 1) for i, x in enumerate(texts)])
    for r in chat.format_chat(chat.conversations(rows)).collect():
        assert not any(c in r.segments[1].text for c in t.controls)


def test_templates_that_can_not_be_read_back_are_refused():
    with pytest.raises(ValueError):
        chat.Template(open="<turn>")
    with pytest.raises(ValueError):
        chat.Template(controls=(*chat.Template().controls, "d|><"))


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op7_language_id"](spark, folder).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 150
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_awkward_rows(awkward, nothing):
    model = language.fit_languages(awkward)
    got = {(r.doc_id): (r.lang_pred, r.score) for r in language.identify(awkward, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5, 6))
    assert got[10][0] != "und"
    kept = language.in_known_language(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 4
    assert language.identify(nothing).count() == 0
    assert language.LanguageModel().predict("abc") == ("und", 0.0)


def test_language_filter_sends_each_text_once(spark):
    texts = [None if i % 7 == 0 else "12 34" if i % 5 == 0 else f"words {i}" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sample = language.Profiles([(np.array([k], "<u4"), np.array([1.0], "<f4")) for k in (1, 1, 2, 2)], 1 << language.BITS)
    model = language.LanguageModel.fit(sample, np.array(["en", "en", "fr", "fr"], dtype=object))
    kept = language.in_known_language(docs, model)
    assert sorted(map(tuple, kept.collect())) == [(i, t) for i, t in enumerate(texts) if t and "w" in t]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("MapInArrow") :].split("\n")[1]
    assert " AS row#" in sent and sent.count(" AS ") == 1


def test_learning_rows_are_bounded(spark):
    """The smallest hashes of each language, also where one id holds most rows; equal to a plain sort."""
    rows = [(i, "en", f"text {i}") for i in range(3000)] + [(5000, "fr", f"mot {i}") for i in range(400)] + [(i, "de", None) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = [tuple(r) for r in language.learning_rows(docs, 20).collect()]
    plain = docs.filter("lang = 'en'").filter(~language.held_out()).selectExpr("text", "xxhash64(doc_id) AS h").orderBy("h").limit(20).collect()
    assert {t for lang, t in got if lang == "en"} == {r.text for r in plain}
    assert sum(lang == "fr" for lang, _ in got) == 20 and not any(lang == "de" for lang, _ in got)


def test_machines_of_sparse_profiles():
    rng = np.random.default_rng(3)
    x = rng.random((60, 40)).astype(np.float32) * (rng.random((60, 40)) < 0.3)
    y = np.where(x[:, :20].sum(1) > x[:, 20:].sum(1), 1.0, -1.0)
    sparse = language.Profiles([(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x], 40)
    assert np.array_equal(sparse[y > 0].dense(), x[y > 0])
    w, b = language.fit_svm(sparse.dense(), y, steps=400)
    assert np.mean(np.sign(x @ w + b) == y) > 0.95


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "\x0b", "\x85", " ", "é", "#", "|", "  ", "\U0001f642"]), max_size=60))
def test_rule_statistics_equal_brute_force(parts):
    text = "".join(parts)
    assert anomaly.text_stats(text.encode())[:5] == brute_stats(text)


def test_quality_query_base_columns(spark, small, documents):
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, small).collect()}
    for r in documents.collect():
        n, chars, symbols, dup, rep = brute_stats(r.text or "")
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert g.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (g.base_failed and g.kept)


def test_forest_finds_what_stands_apart_and_threshold_keeps_good_rows():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (2000, 3)), rng.normal(9, 0.5, (20, 3))])
    scores = anomaly.fit_forest(x).score(x)
    assert scores[2000:].min() > np.quantile(scores[:2000], 0.99)
    steps = np.floor(scores * anomaly.SCORE_STEPS).astype(int)
    cut = anomaly.calibrate([(int(s), int(i < 2000), 1) for i, s in enumerate(steps)])
    assert (scores[:2000] < cut).mean() >= anomaly.KEEP_RATE and (scores[2000:] >= cut).all()
    assert anomaly.calibrate([(5, 1, 3)]) == math.inf


def test_quality_of_awkward_rows(awkward, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (10, None, 1)], "doc_id long, quality int, toxic int")
    got = anomaly.judge(awkward, labels)
    assert got.count() == awkward.count()
    assert got.filter("doc_id IN (3, 4, 5)").filter("NOT base_failed OR n_words > 0").count() == 0
    assert anomaly.judge(nothing, labels).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    count = lambda m: sum(c in "0123456789" for c in m.group())
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= count(m) <= 19 and pii.luhn(pii.digits_of(m.group()))]
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= count(m) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "25", "255", "300", "+1", " ", "-", "(", ")", "4111111111111111", "x@y.z", "é", "%"]), max_size=25))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_take_linear_time():
    text = "a." * 300_000 + "1" * 300_000 + "+" + "(" * 300_000 + "1.2." * 50_000
    assert pii.base_spans(text)[0][0] == "ip"


def test_gradients_of_the_sequence_model():
    from epilattice.llm.sequence_model import Tagger

    rng = np.random.default_rng(0)
    tagger = Tagger.new(7, 3, size=3, hidden=4)
    tagger.weights = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in tagger.weights.items()}
    signs, tags = rng.integers(0, 7, (2, 5)), rng.integers(0, 3, (2, 5))
    _, grads = tagger.gradients(signs, tags)
    for name, w in tagger.weights.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        before = w[at]
        w[at] = before + 1e-4
        up = tagger.gradients(signs, tags)[0]
        w[at] = before - 1e-4
        down = tagger.gradients(signs, tags)[0]
        w[at] = before
        assert abs((up - down) / 2e-4 - grads[name][at]) < 2e-3, name


def test_viterbi_is_the_best_path():
    from itertools import product

    from epilattice.llm.sequence_model import Tagger

    tagger = Tagger.new(5, 3, size=3, hidden=3)
    tagger.weights["moves"] = np.random.default_rng(2).standard_normal((3, 3)).astype(np.float32)
    signs = np.array([[0, 3, 4, 1, 2]])
    e = tagger.scores(signs)[0][0]
    value = lambda p: sum(e[t, k] for t, k in enumerate(p)) + sum(tagger.weights["moves"][a, b] for a, b in zip(p, p[1:]))
    assert tuple(tagger.decode(signs)[0]) == max(product(range(3), repeat=5), key=value)


def test_personal_data_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op5_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_spans(texts[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.KINDS)
        every = [pii.parse_span(x) for x in r.spans.split(",") if x]
        assert set(want) <= set(every) and len(every) == len(want) + r.n_added
        assert every == sorted(every, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_model_adds_what_the_patterns_miss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.train(pii.scan(docs))
    text = "anre the over +1 (578) 555-6437 4918187128635271 and the rest of it"
    assert pii.base_spans(text) == []
    got = pii.added_spans([], [0], [text], pii.tagged([text], tagger))
    assert {(k, text[a:b]) for k, a, b in got} == {("phone", "+1 (578) 555-6437"), ("card", "4918187128635271")}
    clean = ["on 2024-05-17 we paid 1250 at 12:30", "version 1.2.3 of it", "plain words only @ the end"]
    assert [pii.added_spans([], [0], [t], [tags]) for t, tags in zip(clean, pii.tagged(clean, tagger), strict=True)] == [[], [], []]


def test_personal_data_of_awkward_rows(awkward, nothing):
    assert pii.personal_data(awkward).count() == awkward.count()
    assert pii.personal_data(nothing).count() == 0


def test_spans_run_through_windows():
    marks = np.zeros(300, dtype=np.int64)
    marks[40:200] = 2
    marks[40] = 1
    assert pii.tag_spans(marks) == [("email", 40, 200)]
    assert pii.window_starts(96) == [0] and pii.window_starts(97) == [0, 48] and pii.window_starts(10) == [0]


@pytest.mark.parametrize("said", ["name (at) mail (dot) example (dot) com", "x" * 40 + " (at) mail.org", "a [at] " + "d" * 60 + " [dot] " + "e" * 60 + "[DOT]com", "12" * 40 + "@" + "d" * 50 + ".org"])
def test_stretches_hold_whole_addresses(said):
    text = "some plain words before it, " * 3 + said + " and some plain words after it" * 3
    at = text.index(said)
    assert any(a <= at and at + len(said) <= b for a, b in pii.stretches(text))
    assert all(b < c for (_, b), (c, _) in zip(pii.stretches(text * 3), pii.stretches(text * 3)[1:]))
