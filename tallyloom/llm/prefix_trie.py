"""Conversation prefix trie with totals over subtrees by centroid decomposition.

A node is a distinct sequence of first turns. Its least member conversation and its depth name it: no other node has both. A
conversation owns the nodes that it names, always the lower end of its own path, so the size of a subtree is a plain sum over
its members. These sizes find the centroids; totals over subtrees come from the decomposition, in log n rounds for any shape.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import staged_keys

#: Turns of one conversation that one window spans at most, and ids that one string of ends holds at most.
SPAN, ENDS = 1024, 4096


@dataclass(frozen=True)
class PrefixTrie:
    """Components of at most ``leaf`` nodes are decomposed in one task, larger ones by joins."""

    leaf: int = 2000


def ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, rank, role, text): turns by turn number (null first), then role and text, ranked from 0.

    Rows are dealt by ranges of this order, so one conversation may span many tasks; ranks are places in a task's rows plus
    what earlier tasks hold of the conversation.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .select("conv_id", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("conv_id", "part", (F.col("before") - F.col("first")).alias("shift"))
    return stage(dealt.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("rank"), "role", "text"), "ranked")


def crossed(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, role, text), (conv_id, length)): each conversation rebuilt to share its first turns with its family.

    Its first h = crc32(id) % ``most`` turns are those of the conversation ``conv_id - conv_id % family`` (all if that has
    fewer, none if it is absent); its own from the h-th on follow. Depths count from 1.
    """
    own = ranked(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stage(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
                  .select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    heads = own.where(F.col("rank") < most - 1).select(F.col("conv_id").alias("base"), "rank", "role", "text")
    first = convs.join(heads, "base").where("rank < taken").select("conv_id", (F.col("rank") + 1).alias("depth"), "role", "text")
    later = own.join(convs, "conv_id").where("rank >= h").select("conv_id", (F.col("rank") - F.col("h") + F.col("taken") + 1).alias("depth"), "role", "text")
    return first.unionByName(later), convs.select("conv_id", "length")


def _paths(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, owner) for each turn and the root, and the nodes (conv, depth, n_convs, words).

    A sequence is known by two 64-bit sums (exclusive or) of hashes of its turns with their depths, so prefixes are running
    sums: inside spans of turns, and over the spans.
    """
    keyed = stage(turns.select("conv_id", "depth", F.floor(F.col("depth") / SPAN).alias("span"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
                               F.xxhash64("depth", "role", "text").alias("a"), F.xxhash64("text", "role", "depth", F.lit(1)).alias("b")), "keyed")
    spans = keyed.groupBy("conv_id", "span").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", F.coalesce(F.bit_xor("sa").over(earlier), F.lit(0)).alias("sa"), F.coalesce(F.bit_xor("sb").over(earlier), F.lit(0)).alias("sb"))
    inside = Window.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    entries = stage(keyed.withColumn("ra", F.bit_xor("a").over(inside)).withColumn("rb", F.bit_xor("b").over(inside)).join(spans, ["conv_id", "span"])
                    .select("conv_id", "depth", "words", F.col("ra").bitwiseXOR(F.col("sa")).alias("a"), F.col("rb").bitwiseXOR(F.col("sb")).alias("b")), "entries")
    found = stage(entries.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "found")
    root = stage(lengths.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0"), "root")
    top = root.select(F.col("conv").alias("owner"), F.lit(0).cast("long").alias("depth"))
    paths = entries.join(found.select("depth", "a", "b", "owner"), ["depth", "a", "b"]).select("conv_id", "depth", "owner").unionByName(
        lengths.select("conv_id").join(F.broadcast(top), F.lit(True)).select("conv_id", "depth", "owner"))  # one row
    nodes = found.select(F.col("owner").alias("conv"), "depth", "n_convs", "words").unionByName(
        root.select("conv", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words")))
    return stage(paths, "paths"), stage(nodes, "nodes")


def decomposed(conv, depth, parent, top, top_depth, inside, totals) -> np.ndarray:
    """Totals over the subtrees of whole components, all split at the same time; arrays of one length, ``totals`` with a
    column for each total: what hangs below from earlier rounds in the first half, own weights in the second."""
    order = np.lexsort((conv, depth))
    conv, depth, parent, top, top_depth, inside = (a[order] for a in (conv, depth, parent, top, top_depth, inside))
    width = totals.shape[1] // 2
    below, own = totals[order, :width].copy(), totals[order, width:]
    place = {k: i for i, k in enumerate(zip(conv.tolist(), depth.tolist()))}
    up = np.array([place.get(k, -1) for k in zip(parent.tolist(), (depth - 1).tolist())], np.int64)
    comp = np.array([place[k] for k in zip(top.tolist(), top_depth.tolist())], np.int64)
    index, alive, out = np.arange(len(conv)), np.ones(len(conv), bool), np.zeros_like(below)
    edges = np.append(np.flatnonzero(np.diff(depth, prepend=depth[0] - 1)), len(depth))
    while alive.any():
        heavy = alive & (2 * inside >= inside[comp])
        centre = np.full(len(conv), -1, np.int64)
        np.maximum.at(centre, comp[heavy], index[heavy])  # sorted by depth: the deepest
        is_centre = alive & (centre[comp] == index)
        under, after = is_centre.copy(), comp.copy()
        for lo, hi in zip(edges, edges[1:]):
            i = index[lo:hi][alive[lo:hi] & (comp[lo:hi] != index[lo:hi])]
            i = i[under[up[i]]]
            under[i] = True
            after[i] = np.where(is_centre[up[i]], i, after[up[i]])
        total = np.zeros_like(below)
        np.add.at(total, comp[under], own[under])
        at = index[is_centre]
        out[at] = below[at] + total[comp[at]]
        cut, home = inside[at].copy(), comp[at]
        walk = np.where(at == home, -1, up[at])
        while (walk >= 0).any():
            on = walk >= 0
            below[walk[on]] += total[home[on]]
            inside[walk[on]] -= cut[on]
            walk = np.where(on & (walk != home), up[np.maximum(walk, 0)], -1)
        comp, alive = after, alive & ~is_centre
    back = np.empty_like(out)
    back[order] = out
    return back


STATE = ["conv", "depth", "parent", "top", "top_depth", "inside", "below_leaves", "below_saved", "leaves", "saved"]


def _finished(leaf: int):
    """Batches of STATE sorted by component -> (conv, depth, n_leaves, saved_tokens). Components are whole and small; some are taken at once."""
    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        column = {c: table.column(c).to_numpy().copy() for c in STATE}
        out = decomposed(*[column[c] for c in STATE[:6]], np.stack([column[c] for c in STATE[6:]], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(column["conv"]), pa.array(column["depth"]), pa.array(out[:, 0]), pa.array(out[:, 1])], ["conv", "depth", "n_leaves", "saved_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for batch in batches:
            tops = np.stack([batch.column("top").to_numpy(), batch.column("top_depth").to_numpy()])
            edges = [0, *(np.flatnonzero((np.diff(tops) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    key = tuple(tops[:, lo])
                    if key != last and rows >= 10 * leaf:
                        yield done(held)
                        held, rows = [], 0
                    held.append(batch.slice(lo, hi - lo))
                    rows, last = rows + hi - lo, key
        if held:
            yield done(held)
    return run


def rolled_up(paths: DataFrame, state: DataFrame, config: PrefixTrie) -> DataFrame:
    """(conv, depth, n_leaves, saved_tokens): sums of ``leaves`` and ``saved`` over each node's subtree.

    Each round takes the centroid of every large component: the deepest node with half of its nodes or more below. The
    total below the centroid is added to the nodes on the path from it to the component's top; then each child's part and
    the part above are components of their own, of half the nodes at most.
    """
    comp = ["top", "top_depth"]
    finished, small = [], []
    while True:
        sizes = state.groupBy(*comp).agg(F.max("inside").alias("size")).where(F.col("size") > config.leaf)
        large = staged_keys(sizes, "large")
        small.append(stage(state.join(large, comp, "left_anti").select(*STATE), "small"))
        state = stage(state.join(large, comp), "state")
        if not state.limit(1).count():
            break
        centres = staged_keys(state.where("2 * inside >= size").groupBy(*comp).agg(F.max(F.struct("depth", "conv", "inside")).alias("c")).select(
            *comp, F.col("c.depth").alias("c_depth"), F.col("c.conv").alias("c_conv"), F.col("c.inside").alias("c_inside")), "centres")
        # where the owners of a component's nodes stand at the centroid's depth, and one below it
        owners = state.select(*comp, "conv").distinct().join(centres, comp)
        step = paths.select(F.col("conv_id").alias("conv"), F.col("depth").alias("c_depth"), F.col("owner").alias("met"))
        below = owners.join(step, ["conv", "c_depth"]).where("met = c_conv").select(*comp, "conv", "c_conv", (F.col("c_depth") + 1).alias("c_depth"))
        child = below.join(step.withColumnRenamed("met", "child"), ["conv", "c_depth"], "left").select(*comp, "conv", "child", F.lit(True).alias("under"))
        placed = stage(state.join(centres, comp).join(child, [*comp, "conv"], "left")
                       .withColumn("under", F.coalesce("under", F.lit(False)) & (F.col("depth") >= F.col("c_depth"))), "placed")
        totals = staged_keys(placed.where("under").groupBy(*comp).agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved")), "totals")
        way = (centres.join(paths.select(F.col("conv_id").alias("c_conv"), "depth", F.col("owner").alias("conv")), "c_conv")
               .where("depth >= top_depth and depth < c_depth").select(*comp, "conv", "depth", F.lit(True).alias("on_way")))
        moved = stage(placed.join(totals, comp).join(way, [*comp, "conv", "depth"], "left"), "moved")
        is_centre = F.col("under") & (F.col("depth") == F.col("c_depth"))
        finished.append(moved.where(is_centre).select("conv", "depth", (F.col("below_leaves") + F.col("t_leaves")).alias("n_leaves"),
                                                      (F.col("below_saved") + F.col("t_saved")).alias("saved_tokens")))
        add = lambda c, t: (F.col(c) + F.when(F.col("on_way"), F.col(t)).otherwise(0)).alias(c)
        state = stage(moved.where(~is_centre).select(
            "conv", "depth", "parent", F.when(F.col("under"), F.col("child")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            (F.col("inside") - F.when(F.col("on_way"), F.col("c_inside")).otherwise(0)).alias("inside"),
            add("below_leaves", "t_leaves"), add("below_saved", "t_saved"), "leaves", "saved"), "state")
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    out = (rest.repartition(*comp).sortWithinPartitions(*comp).mapInArrow(_finished(config.leaf), "conv long, depth long, n_leaves long, saved_tokens long"))
    for part in finished:
        out = out.unionByName(part)
    return stage(out, "rolled")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (conv, depth, text) sorted by node and place -> (conv, depth, ends_sha256): the hash of the node's texts, comma-joined."""
    key, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "text"))):
            if (conv, depth) == key:
                state.update(b"," + text.encode())
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (conv, depth), hashlib.sha256(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["conv", "depth", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["conv", "depth", "ends_sha256"])


def ends(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of nodes at which conversations end: their ids, ascending, comma-joined and hashed.

    Ids are joined in strings of up to ``ENDS`` ids first; a node's strings then pass through its hash one by one.
    """
    last = paths.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    texts = last.groupBy(F.col("owner").alias("conv"), "depth", F.floor(F.col("conv_id") / ENDS).alias("place")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    return (texts.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "place").select("conv", "depth", "text")
            .mapInArrow(_hashed, "conv long, depth long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, config: PrefixTrie = PrefixTrie()) -> DataFrame:
    """One row for each node of the trie of all conversations of ``turns`` (conv_id, turn, role, text), rebuilt by ``crossed``.

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (over the subtree, words of each node's last text times its members but one), ends_sha256.

    Null roles and texts are empty; null turns come first; equal turns are ordered by role, then text, and repeated rows are
    turns of their own. Rows without conv_id belong to no conversation. A conversation that ends up without turns is a
    member of the root. An empty table has no node; other columns are ignored.
    """
    rebuilt, lengths = crossed(turns)
    paths, nodes = _paths(rebuilt, lengths)
    up = paths.select(F.col("conv_id").alias("conv"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    linked = stage(nodes.join(up, ["conv", "depth"], "left"), "linked")
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    owned = nodes.groupBy(F.col("conv").alias("conv_id")).agg(F.count("*").alias("own"))
    sizes = (paths.join(owned, "conv_id", "left").groupBy(F.col("owner").alias("conv"), "depth").agg(F.sum(F.coalesce("own", F.lit(0))).alias("all"),
             F.sum(F.when(F.col("conv_id") == F.col("owner"), F.coalesce("own", F.lit(0)))).alias("mine")))
    full = stage(linked.join(children, ["conv", "depth"], "left").join(sizes, ["conv", "depth"])
                 .join(lengths.withColumnRenamed("conv_id", "conv"), "conv")
                 .select("conv", "depth", "parent", "n_convs", "words", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                         (F.col("all") - F.col("mine") + F.col("length") - F.col("depth") + 1).alias("inside")), "full")
    first = full.where("depth = 0").select(F.col("conv").alias("top"), F.lit(0).cast("long").alias("top_depth"))
    zero = F.lit(0).cast("long")
    state = full.join(F.broadcast(first), F.lit(True)).select(  # the root: one row
        "conv", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), "top", "top_depth", "inside", zero.alias("below_leaves"), zero.alias("below_saved"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = rolled_up(paths, stage(state, "state"), config)
    nothing = hashlib.sha256(b"").hexdigest()
    return (full.join(totals, ["conv", "depth"]).join(ends(paths, lengths), ["conv", "depth"], "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))
