"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Three stages, each of which groups by the *content*, not only its digest:

1. locally: the map side of the first aggregation leaves one row per content,
   length and salt in each input partition;
2. salted: these rows meet by digest, salt and content, so that a text that is
   a third of all rows is spread over ``salts`` groups;
3. globally: the salts' winners, ``salts`` rows for a content and length at
   most, meet by digest.

Only then are documents joined to their group, by digest and salt: a group says
at which salts it has rows and stands there once each, so the join spreads the
copies of one text as stage 2 did. A digest that stands for several contents is
found in stage 3; its documents are joined by content instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare_text, cut, quoted, unused

#: Groups that copies of one text are spread over before they meet; 62 at most, a bit of a long each.
SALTS = 16


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def content_groups(rows: DataFrame) -> DataFrame:
    """``x_digest, x_content, x_keep, x_len, x_size, x_salts``: one row per content; bit s of ``x_salts`` is set if salt s has rows of it."""
    local = rows.groupBy("x_digest", "x_salt", "x_content", "x_len").agg(F.min("x_id").alias("x_id"), F.count(F.lit(1)).alias("x_n"))
    return (
        local.withColumn("x_bit", F.expr("shiftleft(1L, x_salt)"))
        .repartition("x_digest")
        .groupBy("x_digest", "x_content", "x_len")
        .agg(F.min("x_id").alias("x_id"), F.sum("x_n").alias("x_n"), F.bit_or("x_bit").alias("x_bit"))
        .groupBy("x_digest", "x_content")
        .agg(F.max_by("x_id", "x_len").alias("x_keep"), F.max("x_len").alias("x_len"), F.sum("x_n").alias("x_size"), F.bit_or("x_bit").alias("x_salts"))
    )


def prepared(docs: DataFrame, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    content = bare_text(F.col("text"))
    return docs.select(
        F.col("doc_id").alias("x_id"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("x_salt"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).alias("x_len"),
        content.alias("x_content"),
        digest(content).alias("x_digest"),
    )


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row per digest, with how many contents it stands for; of several the rest means nothing."""
    several = F.count(F.lit(1)).alias("x_contents")
    return cut(
        content_groups(rows)
        .groupBy("x_digest")
        .agg(several, F.min("x_keep").alias("x_keep"), F.max("x_len").alias("x_len"), F.sum("x_size").alias("x_size"), F.bit_or("x_salts").alias("x_salts"))
    )


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without ASCII white space. The row
    with the most code points in its original text stays, of these the one with
    the smallest ``doc_id``.

    Null text counts as empty. A null ``doc_id`` is the largest; a group whose
    longest texts have none keeps a null. Rows that repeat a ``doc_id`` count
    one by one in ``group_size``; those with the kept id are all ``kept``
    (:func:`drop_copies` leaves one of them). Other columns of ``docs`` are
    ignored. An empty table gives no rows.
    """
    rows = prepared(docs, digest, salts)
    groups = digest_groups(rows)
    sha = F.lower(F.hex("x_digest")) if digest is sha256 else F.sha2("x_content", 256)
    narrow = rows.select("x_id", "x_salt", "x_digest", *([] if digest is sha256 else [sha.alias("x_sha")]))
    at = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit(F.col("x_salts"), s) == 1)
    spread = groups.filter("x_contents = 1").select("x_digest", "x_keep", "x_size", F.explode(at).alias("x_salt"))
    out = narrow.join(spread, ["x_digest", "x_salt"]).select("x_id", "x_keep", "x_size", sha.alias("x_sha") if digest is sha256 else "x_sha")
    clashing = groups.filter("x_contents > 1").select("x_digest")
    if not clashing.isEmpty():
        those = rows.join(clashing, "x_digest", "left_semi")
        whole = content_groups(those).select("x_digest", "x_content", "x_keep", "x_size")
        out = out.unionByName(those.join(whole, ["x_digest", "x_content"]).select("x_id", "x_keep", "x_size", F.sha2("x_content", 256).alias("x_sha")))
    return out.select(
        F.col("x_id").alias("doc_id"),
        F.col("x_keep").alias("keep_id"),
        F.col("x_size").alias("group_size"),
        F.col("x_id").eqNullSafe(F.col("x_keep")).alias("kept"),
        F.col("x_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """``docs`` with one row of each text: the longest, of these that with the smallest ``doc_id``; all columns stay.

    Rows are told apart, not ids: of the rows of one text that repeat the kept id
    at the kept length one stays, whichever, and a row with an id that another
    text keeps goes like any other copy. A null ``doc_id`` is the largest. Null
    text counts as empty; an empty table gives no rows.
    """
    here = unused(docs, "digest", "id", "len")
    d, i, n = (F.col(c) for c in here)
    rows = docs.withColumns(dict(zip(here, (digest(bare_text(F.col("text"))), F.col("doc_id"), F.length(F.coalesce(F.col("text"), F.lit("")))), strict=True)))
    groups = digest_groups(prepared(docs, digest, salts))
    names = unused(rows, "w_digest", "w_id", "w_len")
    winners = groups.filter("x_contents = 1").select(*(F.col(c).alias(w) for c, w in zip(("x_digest", "x_keep", "x_len"), names, strict=True)))
    wins = (d == F.col(names[0])) & i.eqNullSafe(F.col(names[1])) & (n == F.col(names[2]))
    tied = rows.select(here).join(winners, wins, "left_semi").groupBy(d.alias("x_digest")).count().filter("count > 1")
    hard = cut(tied.select("x_digest").unionByName(groups.filter("x_contents > 1").select("x_digest")).select(F.col("x_digest").alias(names[0])))
    kept = rows.join(winners, wins, "left_semi")
    if hard.isEmpty():
        return kept.drop(*here)
    is_hard = d == F.col(names[0])
    order = F.struct(-n, i.isNull(), i)
    of = rows.join(hard, is_hard, "left_semi").groupBy(d, bare_text(F.col("text")))
    one = of.agg(F.min_by(F.struct(*quoted(docs)), order).alias("row")).select("row.*")
    return kept.join(hard, is_hard, "left_anti").drop(*here).unionByName(one)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents),
w AS (
  SELECT bare, first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) AS group_size
  FROM t GROUP BY bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.bare) AS text_sha256
FROM t JOIN w ON t.bare = w.bare
"""
