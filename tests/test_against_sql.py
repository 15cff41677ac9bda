"""Queries against their SQL on documents that the tables seldom have."""

import collections

import duckdb
import pytest

import __spark_entry__ as driver

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query and of its SQL on documents, given as ``(doc_id, text)`` and, if it matters, a source."""

    def run(name, rows):
        folder = str(tmp_path / "tables")
        spark.createDataFrame([(i, t, "en", *(source or ["web"]), len(t or "")) for i, t, *source in rows], DOCUMENT).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        got = driver.queries()[name](spark, folder)
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
            want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({driver.oracle_sql()[name]})").fetchall()
        return collections.Counter(map(tuple, got.collect())), collections.Counter(want)

    return run


def test_article_titles_with_bars(both):
    """A block of many words at the top begins with what stands before the title's bar, but doesn't hold the title."""
    rest = "| six | more | words | stand | here | and | others | follow | them | to | the | end"
    got, want = both("article_clean", [(1, f"alpha | bravo charlie | delta.\nEcho foxtrot golf hotel india {rest}\nAlphabet {rest}\nLast one."), (2, f"alpha - bravo | charlie {rest}\nAlpha {rest}")])
    assert got == want


@pytest.mark.parametrize(
    "rows",
    [
        [(1, ""), (2, "a title"), (3, "")],
        [(1, None), (2, "a title"), (3, None), (4, "")],
        [(1, "a title"), (1, "A title!"), (2, "a title"), (2, "b")],
        [(None, "a title"), (None, "b"), (1, "b")],
        [(1, "È È, Ç"), (2, "È È, Ç"), (3, "Ç")],
        [(1, "\u0130stanbul"), (2, "istanbul"), (3, "\u212aelvin"), (4, "kelvin")],
    ],
)
def test_dedup_document_of_odd_titles(both, rows):
    """Empty and null titles, ids that repeat, null ids, titles without a letter that a key keeps, capitals of other alphabets."""
    got, want = both("dedup_document", rows)
    assert got == want


def test_dedup_duplicates_of_odd_titles(both):
    got, want = both("dedup_duplicates", [(1, ""), (2, None), (3, ""), (4, "a title"), (5, None), (6, "A title.")])
    assert got == want


def test_core_metrics_counts_all(both):
    """More repeated n-grams and sources than a display has, and a stage that only the last of many sentences has."""
    many = " ".join(f"word{i}x" for i in range(700)) + ". "
    long = "7 is how a sentence of some length but of no mark begins. " * 100 + "8 is how a sentence of some length begins and stops."
    got, want = both("core_metrics", [(1, many * 2), (2, long), *[(i, f"text {i}", f"s{i}") for i in range(3, 603)]])
    assert got == want
    row = next(iter(got))
    assert row[-2] == 601 and row[-1] > 1398 and row[-3] > 0
