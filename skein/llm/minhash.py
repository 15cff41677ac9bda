"""MinHash near-duplicates with sequential Bayesian verification.

A document is the set of its distinct shingles of ``SHINGLE`` words, and two link
if 100 x intersection >= 80 x union. Candidates are documents that share one of
``BANDS`` keys, each over ``ROWS`` of ``BANDS * ROWS`` minimum hashes: a pair at
the threshold shares none with probability (1 - 0.8 ** 4) ** 32, 5 in 10 ** 8.

Candidates are compared ``BATCH`` hashes at a time. With a uniform prior, m equal
ones of n leave the similarity a Beta(m + 1, n - m + 1), so the chance that it is
0.8 or more is that of at most m successes of n + 1 at 0.8. A pair for which that
falls below ``MISS`` is dropped; what is left after the last batch is compared by
its whole sets.

No key gives all its pairs. First every document of a key meets one leader, the
same for all keys that it leads; then, in keys that aren't one component yet,
another leader, drawn by the key. What is left are keys whose documents outside
their largest component meet all others in blocks of bounded size. Only links go
on, and only pairs that are known to be linked already are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, row_key
from .components import components
from .simhash import shingle_hashes

SHINGLE, ROWS, BANDS = 2, 4, 32
#: The least similarity of a link, as a fraction of whole numbers.
LEAST = (80, 100)
#: Hashes that are compared before a pair is judged again, and the chance below which it is dropped.
BATCH, MISS = 16, 1e-6
#: Shingles that a group holds, at most but for one document, and those of its probes, in the same way; probes pass by one batch at a time.
BLOCK, PROBES = 1 << 19, 1 << 16
#: Shingles that go through the permutations in one go.
PERMUTED = 1 << 9
#: Hashes of rows that are told apart before texts are shuffled.
SLOTS = 1 << 20
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"minhash %d" % i) | 1 for i in range(ROWS * BANDS)], np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the least hashes of a set, one for each permutation; none of an empty one."""
    if not len(shingles):
        return np.empty(0, np.uint32)
    least = np.full(len(MULTIPLIERS), ~np.uint64(0))
    for i in range(0, len(shingles), PERMUTED):
        part = shingles[i : i + PERMUTED, None]
        np.minimum(least, ((part ^ (part >> np.uint64(29))) * MULTIPLIERS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(prints: Column) -> Column:
    """A key for each ``ROWS`` hashes of a signature."""
    return F.array(*(F.xxhash64(F.substring(prints, 1 + 4 * ROWS * b, 4 * ROWS), F.lit(b)) for b in range(BANDS)))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def least_equal(batch: int = BATCH, miss: float = MISS, least: tuple[int, int] = LEAST) -> list[int]:
    """For each number of hashes compared, how many must be equal for the pair to go on."""
    t = least[0] / least[1]

    def reached(m: int, n: int) -> float:
        return sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))

    return [next(m for m in range(n + 1) if reached(m, n) >= miss) for n in range(batch, len(MULTIPLIERS) + 1, batch)]


NEEDED = least_equal()


def likely(held: np.ndarray, probes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs marked in ``left`` (held by probes) those that no batch drops."""
    counts = np.zeros(left.shape, np.uint8)
    for i in range(BATCH):
        counts += held[:, i, None] == probes[None, :, i]
    a, b = np.nonzero(left & (counts >= NEEDED[0]))
    same = counts[a, b].astype(np.int32)
    for k, needed in enumerate(NEEDED[1:], 1):
        part = slice(k * BATCH, (k + 1) * BATCH)
        same += (held[a, part] == probes[b, part]).sum(axis=1, dtype=np.int32)
        on = same >= needed
        a, b, same = a[on], b[on], same[on]
    order = np.argsort(-same, kind="stable")
    return a[order], b[order]


#: Of the pairs marked in an array of held by probes, those that go on to their whole sets.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Group:
    """One group's held sets; probes meet them as they come. ``judge`` tells by their prints which pairs are compared."""

    def __init__(self, judge: Judge) -> None:
        self.judge = judge
        self.nodes, self.sets, self.prints, self.comps = [], [], [], []
        self.ready, self.root = False, {}

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = self.root.get(up, up)
            x = up
        return x

    def meet(self, nodes: list[int], comps: list[int], main: list[bool], prints: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links of the probes, enough to join what links join: pairs of one component are passed over, likelier ones go first."""
        if not self.nodes:
            return []
        if not self.ready:
            self.prints, self.ready = np.array(self.prints), True
            self.sizes, self.at, self.of = np.array([len(s) for s in self.sets]), np.array(self.nodes), np.array(self.comps)
        sizes, at = np.array([len(s) for s in sets]), np.array(nodes)
        fits = (np.minimum(self.sizes[:, None], sizes) * LEAST[1] >= LEAST[0] * np.maximum(self.sizes[:, None], sizes)) & (self.of[:, None] != np.array(comps))
        fits &= np.array(main) | (at < self.at[:, None])
        out = []
        for h, p in zip(*(x.tolist() for x in self.judge(self.prints, prints, fits)), strict=True):
            a, b = self.find(self.comps[h]), self.find(comps[p])
            if a != b:
                common = len(np.intersect1d(self.sets[h], sets[p], assume_unique=True))
                if common * sum(LEAST) >= LEAST[0] * (len(self.sets[h]) + len(sets[p])):
                    self.root[a] = b
                    out.append((self.nodes[h], nodes[p]))
        return out


#: Cells of held sets by probes that are compared in one go.
CELLS = 1 << 19


def compare(batches: Iterator[pa.RecordBatch], judge: Judge) -> Iterator[pa.RecordBatch]:
    """``x, y, z, role, node, comp, main, print, shingles`` sorted by group and role (0: held, 1: probe) -> links ``a, b``."""
    now, group = None, Group(judge)
    waiting: list[tuple] = []

    def met() -> list[tuple[int, int]]:
        found = group.meet(*(list(c) for c in list(zip(*waiting, strict=True))[:3]), np.array([w[3] for w in waiting]), [w[4] for w in waiting]) if waiting else []
        waiting.clear()
        return found

    for batch in batches:
        out = []
        for x, y, z, role, node, comp, main, prints, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (x, y, z) != now:
                out += met()
                now, group = (x, y, z), Group(judge)
            signs, own = np.frombuffer(prints, np.uint32), np.frombuffer(shingles, np.uint64)
            if role:
                waiting.append((node, comp, main, signs, own))
                if len(waiting) * len(group.nodes) >= CELLS or len(waiting) >= 4096:
                    out += met()
            else:
                group.nodes.append(node)
                group.comps.append(comp)
                group.prints.append(signs)
                group.sets.append(own)
        yield links_of(out)
    yield links_of(met())


def links_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def prints_of(rows: DataFrame, shingle: int, sign: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``x_id, x_row, text`` -> ``x_id, x_row, digest, size, print``: what a text's set is known by."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sign(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["x_id", "x_row", "digest", "size", "print"])

    return rows.mapInArrow(make, "x_id long, x_row binary, digest binary, size long, print binary")


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, print, text`` -> ``node, print, shingles``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(2)], pa.binary())], names=["node", "print", "shingles"])

    return texts.mapInArrow(make, "node long, print binary, shingles binary")


MET = ["x", "y", "z", "role", "node", "comp", "main", "print", "shingles"]


def links(groups: DataFrame, sets: DataFrame, judge: Judge) -> DataFrame:
    """``x, y, z, role, node, comp, main`` -> links: every node is given its set, and groups meet."""
    rows = groups.join(sets, "node").select(MET)
    return rows.repartition("x", "y", "z").sortWithinPartitions("x", "y", "z", "role").mapInArrow(partial(compare, judge=judge), "a long, b long")


def least_of(block: int) -> int:
    return min(block, PROBES)


def led(members: DataFrame, leader: Column, block: int) -> DataFrame:
    """Groups in which the members of a key, of other components than its leader's, meet the leader: ``key, node, size, comp`` -> groups.

    A pair that several keys propose meets once. A leader's followers are dealt to
    as many groups as their shingles fill.
    """
    heads = members.groupBy("key").agg(F.min_by(F.struct("node", "comp"), F.struct(leader, "node")).alias("head"))
    pairs = members.join(heads, "key").select(F.col("head.node").alias("x"), F.col("head.comp").alias("x_comp"), "node", "size", "comp").filter("comp <> x_comp").distinct()
    salts = pairs.groupBy("x", "x_comp").agg(F.ceil(F.sum("size") / least_of(block)).cast("long").alias("salts"))
    probes = pairs.join(salts.select("x", "salts"), "x").select("x", F.lit(0).cast("long").alias("y"), F.pmod(F.xxhash64("node"), F.col("salts")).alias("z"), F.lit(1).alias("role"), "node", "comp", F.lit(True).alias("main"))
    held = salts.select("x", F.lit(0).cast("long").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("z"), F.lit(0).alias("role"), F.col("x").alias("node"), F.col("x_comp").alias("comp"), F.lit(False).alias("main"))
    return held.unionByName(probes)


def blocked(members: DataFrame, block: int) -> DataFrame:
    """Groups in which a key's documents outside its largest component meet all of its documents."""
    comps = members.groupBy("key", "comp").agg(F.sum("size").alias("size"))
    keys = comps.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"), F.max("size").alias("most"), F.sum("size").alias("all"))
    keys = keys.withColumn("ys", F.ceil((F.col("all") - F.col("most")) / block).cast("long")).withColumn("zs", F.ceil(F.col("all") / least_of(block)).cast("long")).filter("ys > 0")
    rows = members.join(keys.select("key", "largest", "ys", "zs"), "key").withColumn("main", F.col("comp") == F.col("largest"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own_y, own_z = F.pmod(F.xxhash64("node"), F.col("ys")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("zs"))
    held = rows.filter("NOT main").select(F.col("key").alias("x"), own_y.alias("y"), F.explode(upto("zs")).alias("z"), F.lit(0).alias("role"), "node", "comp", "main")
    probes = rows.select(F.col("key").alias("x"), F.explode(upto("ys")).alias("y"), own_z.alias("z"), F.lit(1).alias("role"), "node", "comp", "main")
    return held.unionByName(probes)


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows ``w_id, w_row`` of ``wanted``, with their texts.

    Before texts are shuffled, those whose hash, of ``SLOTS``, no wanted row has
    are left out: what is broadcast is that many numbers at most.
    """
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SLOTS))
    some = F.broadcast(wanted.select(slot("w_id", "w_row").alias("slot")).distinct())
    near = rows.withColumn("slot", slot("x_id", "x_row")).join(some, "slot", "left_semi")
    return near.join(wanted, near["x_id"].eqNullSafe(wanted["w_id"]) & (near["x_row"] == wanted["w_row"]))


def distinct_sets(rows: DataFrame, shingle: int, sign: Callable[[np.ndarray], bytes]) -> tuple[DataFrame, DataFrame]:
    """``x_id, x_row, text`` -> each row's ``x_id, x_row, digest, size``, and ``node, digest, x_of, size, print`` of each set that isn't empty."""
    prints = cut(prints_of(rows, shingle, sign))
    known = cut(prints.select("x_id", "x_row", "digest", "size"))
    one = prints.filter("size > 0").groupBy("digest").agg(F.min(F.struct("x_id", "x_row")).alias("x_of"), F.first("size").alias("size"), F.first("print").alias("print"))
    nodes = cut(one.withColumn("node", F.monotonically_increasing_id()))
    return known, nodes


def linked(rows: DataFrame, nodes: DataFrame, members: DataFrame, shingle: int, block: int, judge: Judge) -> DataFrame:
    """``key, node, size, comp`` (each node its own component) -> ``digest, component``, linked by whole sets of those of a key.

    ``nodes`` are ``node, digest, x_of, print``, ``judge`` reads their prints.
    """
    spark = rows.sparkSession
    wanted = cut(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "print", F.col("x_of.x_id").alias("w_id"), F.col("x_of.x_row").alias("w_row")))
    of = cut(nodes.select("node", "digest"))
    del nodes
    texts = texts_of(rows, wanted).select("node", "print", "text")
    sets = cut(sets_of(texts, shingle).dropDuplicates(["node"]))
    release(spark)
    every, by_key = F.xxhash64("node"), F.xxhash64("node", "key")
    found = cut(links(led(members, every, block), sets, judge))
    for before, groups in ((every, lambda m: led(m, by_key, block)), (by_key, lambda m: blocked(m, block))):
        release(spark)
        comp = components(found)
        leaders = members.groupBy("key").agg(F.min_by("node", F.struct(before, "node")).alias("node"))  # they have met all others of the key
        left = members.drop("comp").join(comp.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(leaders, ["key", "node"], "left_anti")
        split = left.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("key")
        members = cut(left.join(split, "key", "left_semi").select("key", "node", "size", "comp"))
        if members.isEmpty():
            break
        found = cut(found.unionByName(links(groups(members), sets, judge)))
    release(spark)
    return of.join(components(found), "node", "left").select("digest", F.coalesce("component", "node").alias("component"))


def similar_sets(docs: DataFrame, block: int = BLOCK, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Each row's ``x_id, x_row, digest, size``, and for each digest of a set that isn't empty the node and component that it belongs to."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("x_id"), row_key().alias("x_row"), "text")
    known, nodes = distinct_sets(rows, shingle, lambda s: signature(s).tobytes())
    release(spark)
    keyed = nodes.select("node", "size", F.explode(band_keys(F.col("print"))).alias("key"))
    # Near copies share most of their keys: of keys with the same documents, by 128 bits of their hashes, one is enough.
    who = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"who{k}") for k in (0, 1)]
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *who).filter("n > 1").groupBy("n", "who0", "who1").agg(F.min("key").alias("key")).select("key"))
    release(spark)
    members = cut(keyed.join(shared, "key").select("key", "node", "size", F.col("node").alias("comp")))
    del keyed, shared
    release(spark)
    return known, linked(rows, nodes, members, shingle, block, likely)


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    The component is the least ``doc_id`` that links reach. Texts without words,
    null among them, have no shingles and link to nothing: each is its own
    component; of repeated rows each. A null ``doc_id`` is no component's: its
    row takes that of the documents it links to, or null, and isn't kept.
    Repeated rows get equal results; other columns are ignored; an empty table
    gives no rows. Texts are hashed whole; a very long one is one set of 8 bytes
    a distinct shingle.
    """
    rows, of = similar_sets(docs, block)
    known = cut(rows.join(of, "digest", "left"))
    least = known.filter("component IS NOT NULL").groupBy("component").agg(F.min("x_id").alias("component_id"))
    out = known.join(least, "component", "left").withColumn("component_id", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("x_id")))
    return out.select(F.col("x_id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id", F.coalesce(F.col("x_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN both_ways l ON l.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
"""
