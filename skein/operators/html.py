"""Web pages: the text that is seen, by lines."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import articles

# Elements that are not seen, and where a line ends: before an element, after it.
UNSEEN = frozenset(("canvas", "footer", "header", "nav", "noscript", "script", "style", "svg"))
LINE_BEFORE = frozenset(("article", "br", "div", "h1", "h2", "h3", "li", "p", "section"))
LINE_AFTER = frozenset(("article", "div", "li", "p", "section"))


class Events(HTMLParser):
    """What stands in a page, in order: ``open``, ``close`` and ``text`` with a name or the text."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag))

    def handle_endtag(self, tag):
        self.found.append(("close", tag))

    def handle_data(self, data):
        self.found.append(("text", data))


def visible_text(page: str | None) -> str:
    """Lines of a page that are seen, a blank line between them; the title is one of them.

    Unseen elements are a stack of those that are open. One that is closed takes
    those with it that were opened inside it and never closed; an end without a
    beginning ends nothing.
    """
    lines, unseen = [""], []
    for kind, value in Events(page or "").found:
        if kind == "text":
            if not unseen:
                first, *more = value.split("\n")
                lines[-1] += first
                lines += more
            continue
        if value in (LINE_BEFORE if kind == "open" else LINE_AFTER):
            lines.append("")
        if kind == "open" and value in UNSEEN:
            unseen.append(value)
        elif kind == "close" and value in unseen:
            while unseen.pop() != value:
                pass
    return "\n\n".join(line for line in (" ".join(x.split()) for x in lines) if line)


def visible_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text_visible``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pa.array([visible_text(p.as_py()) for p in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), seen], names=["page_id", "url", "text_visible"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text_visible string")


def clean_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text_visible`` and the columns of :func:`articles.clean`, with the first line as the title."""
    return articles.clean(visible_pages(pages).withColumn("title", F.split("text_visible", "\n", 2)[0]), "text_visible").drop("title")
