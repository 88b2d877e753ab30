"""A table of awkward documents, with clashing extra columns, and an empty one."""

import pytest

LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(60_000))
LINES = "alpha beta gamma\nsecond line of it\nthird line here\nfourth one too"
SHARED = " ".join(f"w{i}" for i in range(80))

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 8, "en"),
    (2, "The quick brown fox jumps over the lazy dog. " * 8, "en"),
    (2, "The quick brown fox jumps over the lazy dog. " * 8, "en"),
    (3, None, "en"),
    (4, "", "fr"),
    (5, " \t\n ", None),
    (6, "12345 !!! 67", "de"),
    (7, LINES, "en"),
    (8, "intro line\n" + LINES + "\noutro line", "en"),
    (9, "alpha beta gamma\n\nsecond line of it\n \nthird line here", "en"),
    (10, LONG, "de"),
    (None, SHARED, "es"),
    (11, SHARED, "es"),
    (12, SHARED + " extra", "es"),
    (13, "two words", "fr"),
    (14, "Two WORDS", "fr"),
    (15, "Über Straße ΣΣ İ é é \U0001f642 漢字 <|endoftext|> don't 's", "de"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, ids binary, piece int, start string, label int, token long, TEXT string, sig string, spans string, k1 int"


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, lang, "s", None if t is None else len(t), "row", b"x", 7, "start", 1, 2, "other", "sig", "spans", 3) for i, t, lang in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
