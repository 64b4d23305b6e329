"""Near-duplicate groups by one-permutation MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import stage
from .common import BROADCAST_ROWS, staged_keys

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Longs of a set's bit map: bit h % 2048 is set for each of its shingles h.
BITS = 32
#: Members of a bucket that one task compares with as many others at most.
BLOCK_ROWS = 1000


@dataclass(frozen=True)
class MinHash:
    """``words`` a shingle; link at ``percent`` of the union; ``bands`` buckets of ``rows`` bins each.

    40 bands of 4 bins miss a pair of similarity 0.75 with probability (1 - 0.75^4)^40, about 3e-7.
    """

    words: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 4


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's ``width``-word shingles; of a shorter text, one for all its words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h)
    span = min(width, n)
    factors = mix((np.arange(1, span + 1, dtype=np.uint64) + np.uint64(1000 * span)) * GOLDEN) | np.uint64(1)
    total = np.zeros(n - span + 1, np.uint64)
    for i in range(span):
        total += h[i:n - span + 1 + i] * factors[i]
    return np.unique(mix(total))


@lru_cache(maxsize=4)
def probes(bins: int, attempts: int) -> np.ndarray:
    """For each bin the places it looks at, in order, when it is empty."""
    return (mix(np.arange(1, bins * attempts + 1, dtype=np.uint64) * GOLDEN) % np.uint64(bins)).astype(np.int64).reshape(bins, attempts)


def signature(values: np.ndarray, bins: int) -> np.ndarray:
    """The least value of each of ``bins`` ranges of one permutation; an empty bin borrows from the first
    non-empty one on its own pseudo-random probe sequence (optimal densification)."""
    where = (((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))  # values are sorted, so bins ascend and the first is least
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    at = where[first]
    out[at], full[at] = values[first], True
    empty, attempts = np.flatnonzero(~full), 32
    while len(empty):
        looked = probes(bins, attempts)[empty]
        hit = full[looked]
        where = hit.argmax(axis=1)
        done = hit[np.arange(len(empty)), where]
        out[empty[done]] = out[looked[done, where[done]]]
        empty, attempts = empty[~done], attempts * 8
    return out


def bit_map(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITS, np.uint8)
    bits[(values % np.uint64(64 * BITS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _signed(config: MinHash):
    """Batches (doc_id, text) -> (doc_id, n_shingles, set_key, buckets, bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = config.bands * config.rows
        salt = mix(np.arange(1, bins + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
        for batch in batches:
            sizes, keys, buckets, bits = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), config.words)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    rows = (signature(s, bins) * salt).reshape(config.bands, config.rows)
                    buckets.append(mix(rows.sum(axis=1, dtype=np.uint64) + salt[:config.bands]).view(np.int64))
                    bits.append(bit_map(s))
                else:
                    buckets.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())),
                 pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "buckets", "bits"])
    return run


def _sets(config: MinHash):
    """Batches (doc_id, text) -> (id, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), config.words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])
    return run


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): the least id that each linked id reaches.

    Each round every id hooks onto its least neighbour, paths are halved, and the links are contracted; about log n
    rounds, each written to the shared folder. Hot ids are pre-aggregated by ``min`` in the map tasks.
    """
    links = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = stage(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("component", F.col("id")), "labels")
    while links.limit(1).count():
        both = links.union(links.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        over = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
        moved = stage(hook.join(over, "up", "left").select("a", F.coalesce("top", "up").alias("top")), "hooks")
        new = moved.select(F.col("a").alias("component"), "top")
        labels = stage(labels.join(new, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "labels")
        left, right = moved.select("a", F.col("top").alias("a2")), moved.select(F.col("a").alias("b"), F.col("top").alias("b2"))
        links = stage(links.join(left, "a").join(right, "b").where("a2 <> b2")
                      .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs whose full sets share ``percent`` of their union."""
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    near = (100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    shared = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(first, "a").join(second, "b").where(near).withColumn("shared", shared)
            .where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b"))


def _likely(config: MinHash):
    """Sorted batches (bucket, i, j, block, id, component, hub, old, n, bits) -> (a, b): pairs of different components of one
    bucket, not tested before, whose bit maps do not rule them out.

    A bit that one map has and the other lacks stands for a shingle that is not shared, so the bound is exact. Rows of one
    (bucket, i, j) lie together: at most two blocks of a bucket, compared slice by slice.
    """
    def pairs(rows: dict[str, np.ndarray], bits: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.flatnonzero(rows["block"] == rows["i"])
        right = left if same else np.flatnonzero(rows["block"] == rows["j"])
        n, old, hub, component = rows["n"], rows["old"], rows["hub"], rows["component"]
        for at in range(0, len(left), 64):
            x, y = left[at:at + 64, None], right[None, :]
            open_ = (component[x] != component[y]) & (hub[x] | hub[y]) & ~(old[x] | old[y])
            open_ &= 100 * np.minimum(n[x], n[y]) >= config.percent * np.maximum(n[x], n[y])
            if same:
                open_ &= x < y
            where = np.nonzero(open_)
            for cut in range(0, len(where[0]), 20_000):
                p, q = left[at + where[0][cut:cut + 20_000]], right[where[1][cut:cut + 20_000]]
                own, other = bits[p], bits[q]
                shared = np.minimum(n[p] - np.bitwise_count(own & ~other).sum(axis=1, dtype=np.int64), n[q] - np.bitwise_count(other & ~own).sum(axis=1, dtype=np.int64))
                ok = (100 + config.percent) * shared >= config.percent * (n[p] + n[q])
                yield np.minimum(rows["id"][p[ok]], rows["id"][q[ok]]), np.maximum(rows["id"][p[ok]], rows["id"][q[ok]])

    def group(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        rows = {c: table.column(c).to_numpy() for c in table.column_names if c != "bits"}
        bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), BITS)
        for a, b in pairs(rows, bits, rows["i"][0] == rows["j"][0]):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
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


def _candidates(rest: DataFrame, maps: DataFrame, old: int, new: int | None, config: MinHash) -> DataFrame:
    """Untested pairs (a, b) with a hub: the least id of each of ``new`` hash classes of a bucket, or any member if None.
    Pairs with a hub of ``old`` classes have been tested. Buckets are compared in pairs of blocks, each a piece of work."""
    hubs = lambda n: rest.groupBy("bucket", F.pmod("h", F.lit(n)).alias("c")).agg(F.min("id").alias("id")).select("bucket", "id").distinct()
    marked = rest.join(hubs(old).withColumn("old", F.lit(True)), ["bucket", "id"], "left")
    if new is not None:
        marked = marked.join(hubs(new).withColumn("hub", F.lit(True)), ["bucket", "id"], "left")
    else:
        marked = marked.withColumn("hub", F.lit(True))
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("long")
    dealt = (marked.join(maps, "id").withColumn("block", F.pmod("h", blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "component",
                     F.coalesce("hub", F.lit(False)).alias("hub"), F.coalesce("old", F.lit(False)).alias("old"), "n", "bits"))
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_likely(config), "a long, b long").distinct()


def _looked_up(rows: DataFrame, table: DataFrame, large: DataFrame | None, key: str) -> DataFrame:
    """``rows`` with what ``table`` or else ``large`` (both one row a key) holds for ``key``, null if neither does.

    Rows of the keys of ``large``, a table short enough to broadcast, never meet in a task; those of other keys are shuffled.
    """
    if large is None:
        return rows.join(table, key, "left")
    spread = F.broadcast(large)
    return rows.join(spread, key).unionByName(rows.join(spread, key, "left_anti").join(table, key, "left"))


def near_duplicates(docs: DataFrame, config: MinHash = MinHash(), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Signatures put each distinct shingle set into ``bands`` buckets. In a bucket only star-shaped pairs are made: all
    members with the least id. Pairs are confirmed on full sets and joined into components. A bucket whose members are
    then still in several components is starred again around 8, then 64 more centres, and what is then still apart is
    compared with all of its bucket, so stars lose no link and a bucket of alike texts costs one pair a member. These
    later comparisons are of bit maps of 2,048 bits, in blocks; only pairs that the maps cannot rule out are made.

    Exact copies are grouped first, by a hash of the whole set, and are represented by their least id. A null or
    word-less text has an empty set and is linked with nothing. Rows without doc_id are linked with nothing, have a
    null component and are kept. Rows that repeat a doc_id are one node (of several texts if these differ) and give a
    row each. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(rows.mapInArrow(_signed(config), "doc_id long, n_shingles long, set_key binary, buckets array<long>, bits array<long>"), "signed")
    usable = signed.where("doc_id is not null and set_key is not null")
    classes = stage(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1"), "classes")
    most = signed.count() // max(broadcast_rows, 1)  # larger classes are fewer than broadcast_rows
    large = classes.where(F.col("size") > most).select("set_key", "rep") if broadcast_rows else None
    nodes = stage(_looked_up(signed, classes.where(F.col("size") <= most).select("set_key", "rep"), large, "set_key")
                  .withColumn("rep", F.when(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull(), F.coalesce("rep", "doc_id")))
                  .select("doc_id", "n_shingles", "rep",
                          F.when(F.col("doc_id") == F.col("rep"), F.col("buckets")).alias("buckets"),
                          F.when(F.col("doc_id") == F.col("rep"), F.col("bits")).alias("bits")), "nodes")
    maps = nodes.where("bits is not null").select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "bits")

    buckets = nodes.where("buckets is not null").select(F.explode("buckets").alias("bucket"), F.col("rep").alias("id")).distinct()
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").select("bucket", "centre")
    members = stage(buckets.join(shared, "bucket"), "members")
    ids = staged_keys(members.select(F.col("id").alias("doc_id")).distinct(), "members-ids", broadcast_rows)
    sets = stage(rows.join(ids, "doc_id").mapInArrow(_sets(config), "id long, shingles array<long>").distinct(), "sets")

    pairs = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    labels = components(_confirmed(pairs, sets, config.percent))
    for old, new in ((1, 8), (8, 64), (64, None)):
        placed = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        open_ = (placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
                 .where("lo < hi").select("bucket", "size"))
        rest = stage(placed.join(open_, "bucket").withColumn("h", F.xxhash64("id")), "open")
        if not rest.limit(1).count():
            break
        pairs = _candidates(rest, maps, old, new, config)
        found = _confirmed(pairs, sets, config.percent)
        left, right = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        merged = components(found.join(left, "a", "left").join(right, "b", "left")
                            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        known = members.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        labels = stage(known.join(merged.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
                       .select("id", F.coalesce("top", "component").alias("component")), "labels")

    tops = labels.select(F.col("id").alias("rep"), "component")
    named = None if large is None else stage(large.select("rep").distinct().join(tops, "rep", "left"), "large")
    return (_looked_up(nodes.select("doc_id", "n_shingles", "rep"), tops, named, "rep")
            .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, config: MinHash = MinHash(), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the least (doc_id, hash of its text).

    A row is told by its doc_id and text: equal ones are one document, of which one row stays, and unlike texts under one
    doc_id are documents of their own. Rows without doc_id all stay. Other columns are carried, whatever their names.
    """
    id_, mark = F.col("doc_id").cast("long"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    row = docs.select(F.struct("*").alias("row"), id_.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), mark.alias("mark"))
    texts = stage(row.where("doc_id is not null").groupBy("doc_id", "mark").count(), "texts")
    shared = staged_keys(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared-ids", broadcast_rows)
    first = texts.agg(F.least(F.min("doc_id"), F.lit(0)).alias("least")).collect()[0]["least"] or 0
    own = texts.join(shared, "doc_id").select("doc_id", "mark", (F.lit(first - 1) - F.monotonically_increasing_id()).alias("node"))
    nodes = staged_keys(own, "nodes", broadcast_rows)  # texts that share an id are numbered below all ids
    numbered = row.select("doc_id", "mark", "text").join(nodes, ["doc_id", "mark"], "left").select(F.coalesce("node", "doc_id").alias("doc_id"), "text")
    found = stage(near_duplicates(numbered, config, broadcast_rows).where("doc_id is not null").select(F.col("doc_id").alias("node"), "component_id").distinct(), "groups")
    known = texts.join(nodes, ["doc_id", "mark"], "left").select(F.coalesce("node", "doc_id").alias("node"), "doc_id", "mark")
    stays = F.struct("doc_id", "mark")
    best = found.join(known, "node").groupBy("component_id").agg(F.min(stays).alias("best"))
    gone = found.join(known, "node").join(best, "component_id").where(stays != F.col("best")).select("doc_id", "mark")
    left = row.join(staged_keys(gone, "gone", broadcast_rows), ["doc_id", "mark"], "left_anti")
    twice = staged_keys(texts.where("count > 1").select("doc_id", "mark"), "repeated", broadcast_rows)
    once = left.join(twice, ["doc_id", "mark"], "left_anti").select("row.*")
    return once.unionByName(left.join(twice, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark").agg(F.first("row").alias("row")).select("row.*"))
