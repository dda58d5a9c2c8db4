import pytest

CLASHING = ("id", "tie", "key", "fp", "size", "target", "copies", "starts", "seed", "item", "feature", "bucket", "stratum",
            "words", "names", "ids", "_host", "_kept", "host", "n_words", "score", "component_id", "fingerprint",
            "_text_key", "text_key", "_score", "_copies", "_times", "_id", "_key", "_bad", "n", "row", "again", "root", "first_id", "place",
            "copies_", "_lines", "_site", "_drop", "_line", "_pages")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) tuples, with extra columns whose
    names operators might use themselves."""
    def make(rows):
        filled = [(*(tuple(r) + ("en", "a"))[: max(4, len(r))][:4], 1, *["x"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(filled, SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, a long text, unusual characters."""
    passage = " ".join(f"w{i}" for i in range(60))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", "en", "a"), (5, "one two", None, "b"),
        (6, passage, "en", "a"), (6, passage, "en", "a"), (7, passage.upper(), "de", "b"), (8, passage + " end", "de", "b"),
        (None, "no id " + passage, "en", "a"), (None, None, "en", "a"), (9, " non breaking　space İ ß ﬁ", "en", "a"),
        (10, " ".join(str(i % 977) for i in range(30_000)), "en", "c"), (11, "x" * 50_000, "en", "c"), (12, passage, "fr", "b"),
        (13, "a\n" * 500, "en", "a"), (14, "😀 # * $ % & | < >\r\nend", "en", "a"),
    ]
