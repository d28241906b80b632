import pytest

SMALL = "/root/testdata/sf0.001"

#: Null and empty texts, one word, repeated rows, ties, a null id, null labels, a very long text.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "   \n\t\n ", None, None, 6),
    (4, "word", "en", None, 4),
    (5, "same text here in two rows of one id", "en", "a", 36),
    (5, "same text here in two rows of one id", "en", "a", 36),
    (6, "same text here in two rows of one id", "de", "b", 36),
    (None, "a row without an id", "en", "b", 19),
    (None, None, None, None, None),
    (7, "12345 !!! ???", "en", "b", 13),
    (8, " ".join(f"long{i % 997}" for i in range(60_000)), "en", "c", 0),
    (9, "日本語のテキスト ünïcödé İstanbul 😀", "de", "c", 30),
    (10, "line one of three\nline two of three\nline three of three\nline four", "en", "a", 60),
    (11, "other\nline one of three\nline two of three\n\nline three of three\nend", "en", "a", 60),
]
#: Names that operators use for columns of their own.
EXTRA = ["row", "text_hash", "h1", "k1", "size", "shard", "slot", "copies", "copy", "spans", "score", "lang_pred", "held_out", "kept", "n_words", "removed_lines", "uid", "print", "words", "lines", "ids", "_id"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"extra {c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
