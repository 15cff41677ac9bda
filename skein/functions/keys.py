"""Keys of addresses and documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compare_key, dedup_text, first_set, squeeze

DOI = r"(?i)10\.[0-9]{4,9}/[^\s\"<>]+"


def domain(url: Column, anywhere: bool = False) -> Column:
    """Host without ``www.`` in front (or anywhere); what has no scheme is taken for a host."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))
    return F.replace(host, F.lit("www."), F.lit("")) if anywhere else F.regexp_replace(host, r"^www\.", "")


def url_key(url: Column) -> Column:
    """Address in lower case without scheme, ``www.``, query, fragment and slashes at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^https?://", ""), r"^www\.", "")
    return F.rtrim(F.split(bare, "[#?]", 2)[0], F.lit("/"))


def url_path_key(url: Column) -> Column:
    """Host and path only, with a prefix; what has no host is compared as text."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)"
    text = F.trim(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.lower(F.regexp_extract(text, parts, 1)), r"^www\.", "")
    path = F.rtrim(F.regexp_extract(text, parts, 2), F.lit("/"))
    return F.when(text == "", "").when(host != "", F.concat(F.lit("url:"), host, path)).otherwise(compare_key(F.regexp_replace(text, "[^A-Za-z0-9áéíóúüñÁÉÍÓÚÜÑ]", " ")))


def doi_key(*values: Column) -> Column:
    """The first DOI in any of the values, in lower case, without punctuation at its end."""
    found = F.regexp_extract(F.concat_ws(" ", *values), DOI, 0)
    return F.rtrim(F.lower(found), F.lit(".,;)"))


def document_key(url: Column, title: Column, year: Column, medium: Column, pdf_url: Column | None = None) -> Column:
    """DOI, else title with year and medium, else address, else title with year, else empty."""
    pdf = pdf_url if pdf_url is not None else F.lit("")
    doi, address, name, source = doi_key(F.coalesce(url, F.lit("")), F.coalesce(pdf, F.lit(""))), url_key(url), dedup_text(title), dedup_text(medium)
    when = F.coalesce(F.nullif(year.cast("string"), F.lit("0")), F.lit(""))
    short = F.substring(name, 1, 180)
    return (
        F.when(doi != "", F.concat(F.lit("doi:"), doi))
        .when((name != "") & (when != "") & (source != ""), F.concat_ws(":", F.lit("title_year_medium"), when, source, short))
        .when(address != "", F.concat(F.lit("url:"), address))
        .when((name != "") & (when != ""), F.concat_ws(":", F.lit("title_year"), when, short))
        .otherwise("")
    )


def custody_hash(*values: Column) -> Column:
    """SHA-256 of the values without surplus white space, joined by a pipe; null counts as empty."""
    return F.sha2(F.array_join(F.array(*[squeeze(v.cast("string")) for v in values]), "|"), 256)


def record_custody_hash() -> Column:
    return custody_hash(*[F.col(c) for c in ("url", "title", "published_date", "fetched_at", "status", "text_clean")])


def record_text() -> Column:
    return first_set(F.col("text_normalized"), F.col("text_clean"), F.col("title"))


def event_key() -> Column:
    """The address of a record, else its year, medium and title."""
    return F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat_ws("|", F.col("year").cast("string"), "medium", "title"))
