"""The prefix trie of conversations, by preorder intervals.

Each prefix of a conversation is a node, known by its depth and 128 bits: the
exclusive or of hashes of its turns with their places, so that prefixes come out
of a distributed scan (:mod:`scans`) however long one conversation is. Nodes are
counted by one aggregation.

Lexicographic order of whole paths would need a path's length for each node. But
a path only matters where it forks: a node's key is the list of those of its
ancestors (itself included) that have siblings, then its depth. Sorted by it
every subtree is an interval. A node's interval ends at the last of the nodes at
which its members end, so leaves and savings of a subtree are differences of
prefix sums over the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, release
from .scans import scanned

#: A conversation's first turns come from the one with the largest id that this divides and that isn't above it.
EVERY = 20
#: How many turns: the checksum of the id modulo this.
HEADS = 4
#: Bytes of ids that are joined before they are hashed in turn.
PIECE = 1 << 16
NODE = ["depth", "a", "b"]


def positions(conversations: DataFrame) -> DataFrame:
    """``conv_id, digest, n_words, place``: the turns of each conversation numbered from 1 by ``turn``, null first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text)))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("tie")
    )
    return scanned(rows, ["conv_id", "turn", "digest", "tie"], {"place": "one"}, segment="conv_id").select("conv_id", "digest", "n_words", "place")


def rebuilt(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, depth, digest, n_words, total`` and conversations ``conv_id, total`` after the heads are exchanged.

    Conversation c gets the first h turns of conversation ``c - c % every``, then
    its own after its first h, with h the checksum of c modulo ``heads``.
    """
    own = positions(conversations)
    head = own.filter((F.col("conv_id") % every == 0) & (F.col("place") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n_words"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    sizes = own.groupBy("conv_id").agg(F.max("place").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    taken = F.filter(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:binary,n_words:bigint>>")), lambda t: t["place"] <= F.col("h"))
    convs = sizes.join(head, "base", "left").withColumn("head", taken).withColumn("k", F.size("head").cast("long")).withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = cut(convs.select("conv_id", "h", "k", "total", "head"))
    first = convs.select("conv_id", "total", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.n_words", "total")
    rest = own.join(convs.select("conv_id", "h", "k", "total"), "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "digest", "n_words", "total")
    return first.unionByName(rest), convs.select("conv_id", "total")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``depth, a, b, conv_id`` -> the ids of a node joined, in pieces of bounded length, with the first id of each."""
    node, ids, length = None, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*node, ids[0])), pa.array([",".join(map(str, ids))])], names=[*NODE, "first", "ids"])

    for batch in batches:
        for *of, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (of != node or length > PIECE):
                yield out()
                ids, length = [], 0
            node = of
            ids.append(conv)
            length += 20
    if ids:
        yield out()


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id -> one hash for each node."""
    node, sha = None, None

    def out() -> tuple:
        return (*node, sha.hexdigest())

    for batch in batches:
        done = []
        for *of, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != node:
                if sha:
                    done.append(out())
                node, sha = of, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pa.RecordBatch.from_arrays([*(pa.array([d[i] for d in done], pa.int64()) for i in range(3)), pa.array([d[3] for d in done], pa.string())], names=[*NODE, "ends_sha256"])
    if sha:
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([sha.hexdigest()])], names=[*NODE, "ends_sha256"])


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """``depth, a, b, conv_id`` -> ``depth, a, b, ends_sha256``: a hash over the ascending ids of each node.

    A hash over a list is one stream; its ids come joined from all tasks, and the
    last one holds a piece at a time.
    """
    order = [*NODE, "conv_id"]
    joined = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "depth long, a long, b long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns and conversations as of :func:`rebuilt` -> one row per node.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` and the node's interval in preorder, ``at`` to
    ``until``. Siblings are in the order of their hashes. No conversation, no row.
    """
    word = [F.xxhash64("digest", "depth", *(F.lit(x) for x in lane)).alias(c) for c, lane in (("own_a", ()), ("own_b", (1,)))]
    paths = scanned(turns.select("conv_id", "depth", "n_words", "total", *word), ["conv_id", "depth"], {}, {"a": "own_a", "b": "own_b"}, segment="conv_id")
    up = [F.first(F.col(c).bitwiseXOR(F.col(f"own_{c}"))).alias(f"up_{c}") for c in "ab"]
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", zero.alias("n_words"), zero.alias("up_a"), zero.alias("up_b"))
    nodes = paths.groupBy(NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_words").alias("n_words"), *up).unionByName(root)
    above = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    nodes = cut(nodes)
    children = nodes.filter("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    tree = cut(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    over = tree.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("forked"))
    tree = cut(tree.join(over, ["depth", "up_a", "up_b"], "left"))
    forks = paths.join(tree.filter("forked").select(NODE), NODE, "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*NODE))).alias("forks"))
    path = F.transform(F.filter("forks", lambda f: f["depth"] <= F.col("depth")), lambda f: F.struct(f["a"].alias("a"), f["b"].alias("b")))
    path = F.coalesce(path, F.array().cast("array<struct<a:bigint,b:bigint>>"))
    saves = (F.col("n_convs") - 1) * F.col("n_words")
    keyed = tree.join(forks, "conv_id", "left").select("conv_id", *NODE, "parent_conv_id", "n_convs", "n_children", path.alias("path"), saves.alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"), F.lit(1).cast("long").alias("one"))
    ranked = scanned(keyed, ["path", "depth"], {"at": "one", "leaves": "leaf", "saved": "saves"}).drop("path")
    release(turns.sparkSession)
    ends = paths.filter("depth = total").select("conv_id", *NODE).unionByName(convs.filter("total = 0").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b")))
    last = F.struct("at", "leaves", "saved")
    ended = ends.join(ranked.select(*NODE, "at", "leaves", "saved"), NODE).select("conv_id", last.alias("last"))
    every = ended.agg(F.max("last").alias("last")).select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "last")
    until = paths.select("conv_id", *NODE).join(ended, "conv_id").groupBy(NODE).agg(F.max("last").alias("last")).unionByName(every)
    return (
        ranked.join(until, NODE)
        .join(digests_of_ends(ends), NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "at", F.col("last.at").alias("until"),
            (F.col("last.leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
            (F.col("last.saved") - F.col("saved") + F.col("saves")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """The trie of the rebuilt conversations of a table ``conv_id, turn, role, text``: see :func:`rebuilt` and :func:`prefix_trie`.

    Null role and text count as empty, a null ``turn`` comes first. Turns with one
    number are in the order of a hash of role and text, and rows that repeat all
    four are turns of their own. Rows without ``conv_id`` belong to no
    conversation and are left out; other columns are ignored; an empty table has
    no nodes. Texts of any length are hashed where they are read and don't move.
    """
    return prefix_trie(*rebuilt(conversations, every, heads))


ORACLE = r"""
WITH RECURSIVE
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ' ' || coalesce(role, '') || coalesce(text, ''))) AS p,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
steps AS (
  SELECT conv_id, list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::UBIGINT, 1000, 1000, 1000, 1000, 1000, 1000, 1000, 1000]))) AS s
  FROM (SELECT DISTINCT conv_id FROM t)),
h AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         (xor(list_reduce(s, lambda c, x: CASE WHEN x = 1000 THEN xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT)) ELSE xor(c, x) END), 4294967295::UBIGINT) % 4)::BIGINT AS h
  FROM steps),
r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, role, text
  FROM (SELECT h.conv_id, t.p, role, text FROM h JOIN t ON t.conv_id = h.base AND t.p <= h.h
        UNION ALL SELECT h.conv_id, t.p, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.p > h.h)),
chain AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS k, NULL::VARCHAR AS up, 0::BIGINT AS n_words FROM h
  UNION ALL
  SELECT c.conv_id, r.d, sha256(c.k || '/' || length(role)::VARCHAR || ' ' || role || text), c.k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT
  FROM chain c JOIN r ON r.conv_id = c.conv_id AND r.d = c.d + 1),
ends AS (SELECT conv_id, arg_max(k, d) AS k FROM chain GROUP BY conv_id),
lists AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY k),
n AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, any_value(n_words) AS n_words, min(conv_id) AS conv_id, count(*) AS n_convs FROM chain GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children, (n_convs - 1) * n_words AS saves FROM n LEFT JOIN kids USING (k)),
below AS (SELECT k AS top, k FROM f UNION ALL SELECT below.top, f.k FROM below JOIN f ON f.up = below.k),
sums AS (SELECT top AS k, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saves)::BIGINT AS saved_tokens FROM below JOIN f USING (k) GROUP BY top)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM f JOIN sums USING (k) LEFT JOIN lists USING (k) LEFT JOIN f p ON p.k = f.up
"""
