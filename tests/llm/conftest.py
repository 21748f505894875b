import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept boolean, score string, predicted int, rate int, fp long, target string"
A = "the quick brown fox jumps over the lazy dog and runs to the river of the old town with it"
LONG = " ".join(f"word{i % 977} is in the long text of number {i}" for i in range(20000))

#: Null and empty texts, white space, ties, repeated rows, null ids, languages and
#: sources, a very long text, and columns whose names clash with results.
ROWS = [
    (1, A, "en", "a", 5, "x", True),
    (2, A, "en", "a", 5, "y", None),
    (3, A + " Tail", "en", "b", 5, None, False),
    (4, None, "en", "b", None, "z", True),
    (5, "", None, None, 0, "z", True),
    (6, " \t\n\r\x0b\x0c ", "de", None, 7, None, None),
    (7, "der die das und die Straße ist nicht groß für uns, ähnlich schön übrigens auch", "de", "c", 1, "", True),
    (8, LONG, "en", "a", 1, "", True),
    (9, "one\n\none\none \ntwo # $ % & | < > *", "en", None, 1, "", True),
    (9, "one\n\none\none \ntwo # $ % & | < > *", "en", None, 1, "", True),
    (None, "no id at all", None, "é", 1, "", True),
    (10, "a b a b a b a b a b", "fr", "é", 1, "", True),
    (11, "it's 'save' we'll  go\u00a0there <|endoftext|> 你好 😀 \u0301 x", "fr", "z", 1, "", True),
    (12, "THE QUICK brown fox jumps over the lazy dog and runs to the river of the old town with it", "en", "z", 1, "", True),
    (13, "12345 !!! ???", "en", "z", 1, "", True),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, "s", 1, 2, 3, "t") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def saved(tmp_path_factory, docs, spark):
    """A folder of tables for registered queries."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (3, 1, 0), (7, 1, 0), (8, 1, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(1, "https://WWW.Example.com/en/a?b"), (2, None), (3, "no scheme"), (4, "http://a.net/es/"), (4, "http://a.net/es/"), (None, "x://com/#f"), (5, "http://example.com")]
    spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    vecs = [(i, [float((i * 37 + k * 11) % 17 - 8) / 16 for k in range(8)], 0) for i in range(200)]
    vecs += [(200 + i, [0.5] * 8, 1) for i in range(120)] + [(400, None, 0), (450, [None] * 8, 0), (451, [float("nan")] * 8, 0), (500, [0.25, 0.5], 0), (None, [1.0] * 8, 0)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d
