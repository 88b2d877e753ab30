"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilattice.llm import anomaly, chat, decontaminate, huffman, language, length_packing, line_windows, packing, periodic_runs, pii, shingle_join, source_audit, warc
from epilattice.llm.byte_tokens import byte_tokenizer_path
from epilattice.llm.tokens import id_kind, ids_crc32, word_tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as read back from Huffman files of their ids, with the end id 2."""
    back = huffman.huffman_round_trip(table(spark, folder, "documents"), word_tokenizer_path(), end_id=2)
    return back.select("doc_id", "start", "n_tokens", ids_crc32(F.col("ids"), "<u4").alias("ids_crc32"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a document and a benchmark item that leaked into it."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines of three-line windows that occur earlier."""
    docs = table(spark, folder, "documents")
    cleaned = line_windows.dedup_lines(docs)
    return cleaned.select(F.col(f"row.c{docs.columns.index('doc_id')}").alias("doc_id"), "n_lines", "n_removed", "text")


def op4_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids, one row per piece."""
    path = word_tokenizer_path()
    packed = packing.best_fit(table(spark, folder, "documents"), path, end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", ids_crc32(F.col("ids"), id_kind(path, 0)).alias("ids_crc32"), "sequence_id", "offset")


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text: base spans by pattern, and those that the model adds."""
    return pii.personal_data(table(spark, folder, "documents"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = F.inline(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))]))
    return chat.chat_digests(given.unionByName(spark.range(1).select(rows)))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return language.identify(table(spark, folder, "documents"))


def op8_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every document's set of three-word shingles, its component of sets with similarity 0.9 or more, and its links."""
    return shingle_join.shingle_components(table(spark, folder, "documents"), size=3, percent=90)


def op9_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as read back from archives in which repeated payloads are revisit records."""
    back = warc.archive(table(spark, folder, "pages"), least_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics of every document, and whether the base rules and the isolation forest keep it."""
    judged = anomaly.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every document, a tenth of them with a repeat planted by rule, and digests of what is left."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    words = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string"))).withColumn("words", F.when(F.expr("h % 10 = 0"), F.regexp_extract_all("text", F.lit("[^ \\t-\\r]+"), F.lit(0))))
    placed = words.withColumn("n", F.size("words")).withColumn("a", F.expr("IF(n > 0, CAST(h DIV 10 % n AS INT), 0)"))
    period = placed.withColumn("p", F.expr("1 + CAST((n - a) DIV (3 + h DIV 10 % 8) AS INT)"))
    planted = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), 1 + CAST((n - a) DIV p AS INT))), 1, n - a)), ' ')")
    found = periodic_runs.periodic_runs(period.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text")))
    # the greatest length / period, compared without division; ties by start, then period
    best = F.expr("aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (x, y) -> IF(y.length * x.period > x.length * y.period, y, x))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[name].cast("string") for name in ("start", "length", "period")])), "\n")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("collapsed_sha256"),
        "n_words",
        "n_dropped",
    )


def op12_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of a language differ: from each other, and in which terms from the language."""
    return source_audit.source_divergence(table(spark, folder, "documents"), least_docs=3, top=200)


def op13_length_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids without padding, one row per piece."""
    path = byte_tokenizer_path()
    packed = length_packing.pack_lengths(table(spark, folder, "documents"), path, end_id=0, window=1024)
    return packed.select("doc_id", "start", "length", ids_crc32(F.col("ids"), id_kind(path, 0)).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "copy")


QUERIES: dict[str, Query] = {
    "op1_huffman_ids": op1_huffman_ids,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_windows": op3_line_windows,
    "op4_best_fit": op4_best_fit,
    "op5_personal_data": op5_personal_data,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_shingle_join": op8_shingle_join,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_audit": op12_source_audit,
    "op13_length_packing": op13_length_packing,
}

_BLANKS = r" \t\r\v\f"

SQL: dict[str, str] = {
    "op3_line_windows": r"""
WITH lines AS (
    SELECT doc_id, text, i - 1 AS i, l[i] AS line
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), range(1, len(l) + 1) AS r(i)
), full_lines AS (
    SELECT doc_id, i, line FROM lines WHERE regexp_matches(line, '[^ \t\r\v\f]')
), windows AS (
    SELECT doc_id, i AS a, lead(i, 2) OVER w AS b,
           line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS k
    FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
    SELECT doc_id, a, b FROM windows WHERE k IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, a) > 1
), gone AS (
    SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN later x ON l.doc_id = x.doc_id AND l.i BETWEEN x.a AND x.b
), cleaned AS (
    SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
           coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, c.text
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id""",
    "op6_chat_format": r"""
WITH rows_in AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           replace(coalesce(role, ''), '\', '\\') AS er, replace(coalesce(text, ''), '\', '\\') AS et
    FROM rows_in
), e AS (
    SELECT *, length(regexp_replace(er, '(<)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\:\2\4', 'g')) AS nr,
           length(regexp_replace(et, '(<)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\:\2\4', 'g')) AS nt
    FROM t
), g AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum(length('<|turn|><|text|><|end|>') + 1 + nr + nt)::BIGINT AS formatted_chars,
           '>' || string_agg(role, '>' ORDER BY turn NULLS FIRST, role, text) || '>' AS path
    FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       regexp_full_match(path, '>(system>)?(user>assistant>)+') AS valid
FROM g""",
    "op11_periodic_runs": r"""
WITH digits AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS said,
           list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
    FROM documents
), hashed AS (
    SELECT doc_id, said, len(said) AS n,
           xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h
    FROM digits
), planted AS (
    SELECT doc_id, said, n, h % 10 = 0 AND n > 0 AS changed, CASE WHEN n > 0 THEN (h // 10) % n END AS a,
           CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p
    FROM hashed
), words AS (
    SELECT doc_id, n, i, said[1 + CASE WHEN changed AND i >= a THEN a + (i - a) % p ELSE i END] AS word
    FROM planted, range(n) AS r(i)
), checked AS (  -- a run of four periods d matches its lag at three multiples of d or more
    SELECT x.doc_id, x.d
    FROM (SELECT p.doc_id, l.d, m.k * l.d AS i FROM planted p, range(1, n // 4 + 1) AS l(d), range(1, n // l.d + 1) AS m(k) WHERE m.k * l.d < p.n) x
    JOIN words u ON u.doc_id = x.doc_id AND u.i = x.i JOIN words v ON v.doc_id = x.doc_id AND v.i = x.i - x.d
    WHERE u.word = v.word GROUP BY x.doc_id, x.d HAVING count(*) >= 3
), matches AS (
    SELECT c.doc_id, c.d, u.i, u.i - row_number() OVER (PARTITION BY c.doc_id, c.d ORDER BY u.i) AS island
    FROM checked c JOIN words u ON u.doc_id = c.doc_id AND u.i >= c.d JOIN words v ON v.doc_id = c.doc_id AND v.i = u.i - c.d
    WHERE u.word = v.word
), stretches AS (
    SELECT doc_id, d, min(i) - d AS start, count(*) + d AS length FROM matches GROUP BY doc_id, d, island
), runs AS (
    SELECT doc_id, start, length, min(d) AS period FROM stretches WHERE length >= greatest(6, 4 * d) GROUP BY doc_id, start, length
), dropped AS (
    SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length
), kept AS (
    SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) FILTER (x.i IS NULL) AS text, count(x.i) AS n_dropped
    FROM words w LEFT JOIN dropped x ON w.doc_id = x.doc_id AND w.i = x.i GROUP BY w.doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY doc_id
), best AS (
    SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DECIMAL(38, 18)) / period DESC, start, period) = 1
)
SELECT p.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256, p.n AS n_words, coalesce(k.n_dropped, 0) AS n_dropped
FROM planted p LEFT JOIN listed l ON p.doc_id = l.doc_id LEFT JOIN best b ON p.doc_id = b.doc_id LEFT JOIN kept k ON p.doc_id = k.doc_id""",
    "op12_source_audit": r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), said AS (
    SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS c FROM said GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), sizes AS (
    SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), pairs AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT s.lang, s.source, s.term, count(*) AS n FROM said s JOIN kept k ON s.lang = k.lang AND s.term = k.term GROUP BY s.lang, s.source, s.term
), totals AS (
    SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source
), shares AS (  -- every group and every kept term of its language
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + z.v) AS p,
           1 + (1000000000::HUGEINT * (k.c + 1)) // (z.n + z.v) AS q
    FROM pairs g JOIN kept k ON g.lang = k.lang JOIN sizes z ON g.lang = z.lang
    LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
    LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200""",
}
