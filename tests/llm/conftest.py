import pytest

DIRTY = [
    (0, "First line here that is long enough\nsecond line of the text\n\n  FIRST line here that is long enough ", "en", "a", 5),
    (1, None, "en", None, None),
    (2, "", None, "b", 0),
    (3, "second line of the text\nown line number three\tdone", "de", "a", 9),
    (4, "second line of the text\nown line number three\tdone", "de", "a", 9),
    (5, "   \n\t ", "fr", "c", 4),
    (6, "Ünïcödé Wörter ÄÖÜ straße und mehr Wörter " * 40, "de", "b", 7),
    (7, "x" * 20000, "en", "a", 20000),
    (8, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", "en", "a", 1),
    (9, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen sixteen", "en", "a", 1),
    (10, "a.b+c@mail.example.com, 10.0.0.255 and 300.1.1.1; 4111 1111 1111 1111 x +1 (606) 555-7814", "en", "c", 1),
    (11, "<|endoftext|> It's   don't 12345 ﬁne é   日本語 emoji 😀 end", "ja", "c", 1),
]


@pytest.fixture(scope="session")
def dirty(spark):
    """Nulls, empty and long texts, copies, and columns whose names clash with those that operators add."""
    df = spark.createDataFrame(DIRTY, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'x' as size", "1 as rank", "'y' as key", "0 as shard", "'r' as row", "n_chars as n_words")


@pytest.fixture(scope="session")
def empty(dirty):
    return dirty.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
