import pytest

LONG = "word other thing here there " * 20_000


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame of documents from (doc_id, text, lang, source) rows, with columns that clash with the operators' own."""

    def make(rows, clash=()):
        full = [(*r, None if r[1] is None else len(r[1]), *["x"] * len(clash)) for r in rows]
        extra = "".join(f", {c} string" for c in clash)
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long{extra}")

    return make


#: Rows that every operator must take: null and empty texts, null columns, ties, repeated rows, a very long text.
ODD = [
    (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \n\t ", None, "s1"), (4, "one two", "en", None), (None, "no id here", None, None),
    (5, "same text twice over again", "en", "s1"), (5, "same text twice over again", "en", "s1"), (6, "same text twice over again", "de", "s2"),
    (7, LONG, "en", "s1"), (8, "#" * 5000, "en", "s1"), (9, "naïve café 日本語 🤷🏽‍♂️ \x00 end", "fr", "s2"),
]
