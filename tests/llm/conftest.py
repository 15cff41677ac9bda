import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x_id string, first int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns whose names operators might use."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or ""), "x", 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"word{i % 997}" for i in range(30_000))
#: Null and empty texts, white space, very long and repeated ones, null ids.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, LONG), (5, LONG + " end"), (6, "same text here"), (7, "same text here"), (7, "same text here"),
    (None, "same text here"), (None, None), (8, "x" * 50_000), (9, "ñandú über naïve 😀 words"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
