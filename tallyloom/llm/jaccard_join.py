"""Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, exact recursion.

Two facts carry the operator. Jaccard distance is a metric on sets and, with least and greatest counts for intersection and
union, on multisets. And merging shingles into hash classes turns a set into a multiset of counts whose distances are never
larger than those of the sets, so what is far apart in counts is far apart in full.

Against pivots drawn from the corpus nearly every document has distance 1, and windows of twice the threshold would hold
everything. So the first pivots are not whole documents: the shingle space is cut into hash classes, and in each class the
documents' parts themselves are the pivots, a region being all documents with one and the same part. Two sets of sizes a <= b
within the threshold differ in at most ``slack(a)`` shingles, so in at most as many classes: a document that is listed with
``slack + 1`` of its parts, those of most shingles first, meets every partner in a region. Regions are then joined
recursively, with pivots that are documents and windows from the triangle inequality over class counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import BROADCAST_ROWS, sized, staged_keys
from .near_dedup import components, mix, shingles

#: Rows of a region that one task compares with as many others at most.
BLOCK_ROWS = 1000
SALTS = 16
#: Classes of a sketch for each class that regions are made of.
FINE = 4


@dataclass(frozen=True)
class JaccardJoin:
    """``words`` a shingle; link at ``percent`` of the union; ``pivots`` a region at each level of the recursion, which
    ends with comparisons inside regions of at most ``leaf`` rows, or of any size where windows no longer shrink them."""

    words: int = 3
    percent: int = 90
    pivots: tuple[int, ...] = (8, 64)
    leaf: int = 64

    def __post_init__(self):
        if not 50 < self.percent <= 100:
            raise ValueError("percent must be above 50 and at most 100")

    def slack(self, size: int) -> int:
        """Most shingles by which a set of ``size`` differs from one that it links with: |x ^ y| <= |x| (100 - p) / p."""
        return size * (100 - self.percent) // self.percent

    def classes(self, bracket: int) -> int:
        """Hash classes for sets of 2^bracket to 2^(bracket+1) - 1 shingles: the least power of two beyond their slack."""
        return 1 << self.slack(2 ** (bracket + 1) - 1).bit_length()


def parts(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, size, content hash) of the non-empty classes of sorted shingle hashes among ``m``; one shingle each if m = 0."""
    where = ((values >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32) if m else np.arange(len(values), dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    sizes = np.diff(np.append(first, len(values)))
    return where[first].astype(np.int64), sizes, np.add.reduceat(mix(values), first)


def regions(values: np.ndarray, config: JaccardJoin) -> np.ndarray:
    """The regions of a set: for each bracket that its partners may look at, its ``slack + 1`` parts of most shingles.

    A set whose shingles fall into no more classes than its slack might share no part with a partner; then that partner
    has too few classes as well, and both are listed again with four times as many classes, at last with one a shingle.
    """
    n = len(values)
    slack, own = config.slack(n), n.bit_length() - 1
    if not slack:
        return np.empty(0, np.uint64)  # linked with equal sets only
    found = []
    for bracket in {own, (-(-n * config.percent // 100)).bit_length() - 1}:
        m, level = config.classes(bracket), 0
        while True:
            _, sizes, content = parts(values, m)
            keys = mix(content + np.uint64(1_000_003 * (64 * bracket + level) + 1))
            found.append(keys[np.lexsort((keys, -sizes))[:slack + 1]])
            if len(keys) > slack or not m:
                break
            m, level = (4 * m if 4 * m < 2 ** bracket else 0), level + 1
    return np.unique(np.concatenate(found))


def sketch(values: np.ndarray, config: JaccardJoin) -> np.ndarray:
    """Counts of hash classes, about one for each of the set's shingles: few bytes beside the set itself, but near its distances."""
    m = FINE * config.classes(len(values).bit_length() - 1)
    where, sizes, _ = parts(values, m)
    counts = np.zeros(m, "<u2")
    counts[where] = sizes
    return counts


def fold(counts: np.ndarray, m: int) -> np.ndarray:
    """Counts in ``m`` classes, each a run of the given ones."""
    return counts.reshape(m, -1).sum(axis=1, dtype=np.int64)


def level(rows: list[bytes], m: int | None = None) -> np.ndarray:
    """Sketches of unequal brackets as one matrix of ``m`` classes, by default the coarsest."""
    counts = [np.frombuffer(r, "<u2") for r in rows]
    m = m or min(map(len, counts))
    return np.stack([fold(c, m) for c in counts])


def _signed(config: JaccardJoin):
    """Batches (doc_id, text) -> (doc_id, n_shingles, set_key, regions, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, keys, places, sketches = [], [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py(), config.words)
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    places.append(regions(s, config).view(np.int64) if len(s) else None)
                    sketches.append(sketch(s, config).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int64())),
                     pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set_key", "regions", "sketch"])
    return run


def _sets(config: JaccardJoin):
    """Batches (doc_id, text) -> (id, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), config.words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])
    return run


def _placed(config: JaccardJoin):
    """Batches (region, id, component, home, sketch, width, pivots) -> (region, id, home, among, cells, near), ``among`` pivots.

    ``cells`` are the row's nearest pivot and, after it, each one not farther than that by twice the threshold: who is within
    the threshold of a row whose home is p is itself no farther from p. ``near`` are the pivots that it may link with.
    One region's distances are all in as many classes as its coarsest sketch of ``width`` bytes has.
    """
    wide = 2.0 * (100 - config.percent) / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, close = [], []
            for row in batch.to_pylist():
                pivots = row["pivots"]
                counts = level([row["sketch"], *[p["sketch"] for p in pivots]], row["width"] // 2)
                apart = np.abs(counts[1:] - counts[0]).sum(axis=1)
                both = counts[1:].sum(axis=1) + counts[0].sum()
                far = 2.0 * apart / np.maximum(both + apart, 1)
                possible = (100 + config.percent) * (both - apart) >= 2 * config.percent * both
                nearest = int(far.argmin())
                cells.append([pivots[nearest]["id"]] + [pivots[k]["id"] for k in np.flatnonzero(far <= far[nearest] + wide).tolist() if k != nearest])
                close.append([p["id"] for p, yes in zip(pivots, possible) if yes and p["component"] != row["component"]])
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("id"), batch.column("home"), pa.array([len(row) for row in batch.column("pivots")], pa.int32()),
                                              pa.array(cells, pa.list_(pa.int64())), pa.array(close, pa.list_(pa.int64()))], ["region", "id", "home", "among", "cells", "near"])
    return run


def _compared(config: JaccardJoin):
    """Sorted batches (region, i, j, block, id, component, home, sketch) -> (a, b): pairs of different components of one
    region that class counts do not rule out. Rows of one (region, i, j) lie together: at most two blocks of a region."""
    def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ids, component, home, block = (table.column(c).to_numpy() for c in ("id", "component", "home", "block"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        counts = level(table.column("sketch").to_pylist()).astype(np.int32)
        size = counts.sum(axis=1, dtype=np.int64)
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        for x in left:
            y = right[(component[right] != component[x]) & (home[right] | home[x])]
            if i == j:
                y = y[y > x]
            y = y[100 * np.minimum(size[y], size[x]) >= config.percent * np.maximum(size[y], size[x])]
            for at in range(0, len(y), 256):
                z = y[at:at + 256]
                both = size[z] + size[x]
                apart = np.abs(counts[z] - counts[x]).sum(axis=1, dtype=np.int64)
                z = z[(100 + config.percent) * (both - apart) >= 2 * config.percent * both]
                if len(z):
                    a, b = np.minimum(ids[z], ids[x]), np.maximum(ids[z], ids[x])
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("region", "i", "j")])
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    now = tuple(keys[:, lo])
                    if held and now != key:
                        yield from group(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    key = now
        if held:
            yield from group(held)
    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets share ``percent`` of their union. Sizes are compared before sets."""
    pairs = stage(pairs.where("a <> b").distinct(), "join-pairs")
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(first, "a").join(second, "b")
            .where(100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))).withColumn("shared", shared)
            .where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) of linked ids after more ``links``."""
    left, right = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    roots = stage(links.join(left, "a", "left").join(right, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ra"), F.coalesce("cb", "b").alias("rb")), "roots")
    merged = components(roots.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    known = labels.unionByName(roots.select(F.col("a").alias("id"), F.col("ra").alias("component"))).unionByName(
        roots.select(F.col("b").alias("id"), F.col("rb").alias("component"))).distinct()
    return stage(known.join(merged.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
                 .select("id", F.coalesce("top", "component").alias("component")), "labels")


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (region, id, home) with components, of those regions that still hold several; with the region's rows."""
    placed = rows.join(labels, "id", "left").select("region", "id", "home", F.coalesce("component", "id").alias("component"))
    several = placed.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    return stage(placed.join(staged_keys(several.select("region", "size"), "several"), "region"), "open")


def _with(rows: DataFrame, small: DataFrame, key: str, limit: int, how: str = "left") -> DataFrame:
    """Join with a table of unique keys, broadcast if its counted rows are few; else the key is salted, since one may hold many rows."""
    n = small.count()
    if n <= limit:
        return rows.join(sized(small, n, limit), key, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(small.withColumn("_salt", salts), [key, "_salt"], how).drop("_salt"))


def joined(docs: DataFrame, config: JaccardJoin = JaccardJoin(), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored): the least doc_id
    that links of at least ``percent`` of the union reach.

    Equal sets are one class, represented by its least id; only representatives are listed in regions. Regions with the same
    members count once. A region's members are first compared with its least id. While it holds several components,
    it is split around pivots of different components: a row goes to its nearest pivot and to those within the window, and
    is compared with these pivots; parts are split again. Small regions, and those that windows do not shrink, are compared
    in blocks by class counts, across components only; pairs that these cannot rule out are confirmed on full sets. So no link
    between different components is lost, and none is looked for inside one.

    A null or word-less text has an empty set and is linked with nothing. Rows without doc_id are linked with nothing and
    have a null component. Rows that repeat a doc_id are one node (of several texts if these differ) and give a row
    each. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(rows.mapInArrow(_signed(config), "doc_id long, n_shingles long, set_key binary, regions array<long>, sketch binary"), "signed")
    copies = stage(signed.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
                   .where("n > 1").select("set_key", "least"), "copies")
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    mine = F.col("set_key").isNotNull() & (F.col("doc_id") == rep)
    nodes = stage(_with(signed, copies, "set_key", broadcast_rows)
                  .select("doc_id", "n_shingles", rep.alias("rep"), F.when(mine, F.col("regions")).alias("regions"), F.when(mine, F.col("sketch")).alias("sketch")), "nodes")

    listed = nodes.where("regions is not null").select(F.col("rep").alias("id"), F.explode("regions").alias("region"))
    code = lambda k: F.sum(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 31)))
    same = ["lo", "hi", "size", "s", "t"]
    shared = (listed.groupBy("region").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("size"), code(1).alias("s"), code(2).alias("t"))
              .where("lo < hi").groupBy(*same).agg(F.min("region").alias("region")).select("region", F.col("lo").alias("pivot")))
    members = stage(listed.join(staged_keys(shared, "regions", broadcast_rows), "region").select("region", "pivot", "id").distinct(), "members")
    ids = staged_keys(members.select(F.col("id").alias("doc_id")).distinct(), "member-ids", broadcast_rows)
    sets = stage(rows.join(ids, "doc_id").mapInArrow(_sets(config), "id long, shingles array<long>").distinct(), "sets")
    sketches = nodes.where("sketch is not null").select(F.col("rep").alias("id"), "sketch")

    labels = components(_links(members.select(F.col("pivot").alias("a"), F.col("id").alias("b")), sets, config.percent))
    work = _open(members.select("region", "id", F.lit(True).alias("home")), labels)
    finished = []
    for pivots in config.pivots:
        large = work.where(F.col("size") > config.leaf)
        if not large.limit(1).count():
            break
        finished.append(work.where(F.col("size") <= config.leaf).select("region", "id", "home"))
        chosen = (large.groupBy("region", F.pmod(F.xxhash64("component"), F.lit(pivots)).alias("c")).agg(F.min("id").alias("id")).select("region", "id").distinct()
                  .join(labels, "id", "left").join(sketches, "id")
                  .groupBy("region").agg(F.collect_list(F.struct("id", F.coalesce("component", "id").alias("component"), "sketch")).alias("pivots")))
        drawn = stage(large.join(sketches, "id"), "drawn")
        coarsest = drawn.groupBy("region").agg(F.min(F.octet_length("sketch")).alias("width"))
        dealt = stage(drawn.join(chosen.join(coarsest, "region"), "region").select("region", "id", "component", "home", "sketch", "width", "pivots")
                      .mapInArrow(_placed(config), "region long, id long, home boolean, among int, cells array<long>, near array<long>"), "dealt")
        close = dealt.select("id", F.explode("near").alias("pivot")).select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))
        labels = _relabelled(labels, _links(close, sets, config.percent))
        # worth a split if the cells, were they of one size, hold at most half of the pairs
        shrunk = staged_keys(dealt.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.size("cells")).alias("held"), F.max("among").alias("among"))
                             .where(2.0 * F.col("held") * F.col("held") <= 1.0 * F.col("among") * F.col("n") * F.col("n")).select("region"), "shrunk")
        split = (dealt.join(shrunk, "region").select("region", "id", "home", F.posexplode("cells").alias("k", "pivot"))
                 .select(F.xxhash64("region", "pivot").alias("region"), "id", (F.col("home") & (F.col("k") == 0)).alias("home")))
        whole = large.join(shrunk, "region", "left_anti").select("region", "id", "home")
        work = _open(split.unionByName(whole), labels)
    finished.append(work.select("region", "id", "home"))

    rest = finished[0]
    for more in finished[1:]:
        rest = rest.unionByName(more)
    rest = _open(rest, labels)
    if rest.limit(1).count():
        blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("long")
        tiles = (rest.join(sketches, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
                 .select("region", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "component", "home", "sketch"))
        pairs = tiles.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(_compared(config), "a long, b long")
        labels = _relabelled(labels, _links(pairs, sets, config.percent))
    return (nodes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")))
