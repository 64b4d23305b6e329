"""Reply trees to conversations: root-to-leaf paths, ranked branches, a reversible template and its loss mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: What marks a turn: <|turn|> role <|text|> text <|end|> and a line break.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings, of this template and of common others, as first character and rest. An escaped one has one backslash
#: more between the two, so that escaping adds one to any number of them and unescaping takes one away.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


@dataclass(frozen=True)
class Branches:
    """``best``: how many branches of a tree to format, those of highest summed score; None for all."""

    best: int | None = 1


def thread(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row answers the one before it.

    Rows go by turn, nulls first; rows of one turn go by role and text. Null roles and texts are empty.
    """
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return clean.withColumn("node", node).select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(trees: DataFrame, branches: Branches = Branches()) -> DataFrame:
    """(conv_id, leaf, rank, place, role, text): the chosen root-to-leaf paths of ``trees``, a row for each turn.

    ``trees`` has conv_id, node, parent (null at a root), role, text and score. A branch is a leaf with all above it; it
    ranks by the sum of its scores, then by its leaf. Both ways use pointer doubling, a self-join for each power of two:
    upwards, each node learns its ancestor 1, 2, 4, ... levels up, its depth and its sum; downwards, each chosen path is
    halved until its pieces are single nodes. So n turns take log n joins however deep a tree is, and no row grows.

    A node whose parent is missing is a root. Null scores count 0. Nodes on a cycle lie on no path. Rows that repeat a
    node of a conversation are one node, that of least role and text. Null conv_ids form one conversation; rows without
    node are dropped, since nothing can name them.
    """
    one = F.min(F.struct("parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("r")
    nodes = stage(trees.where("node is not null").groupBy("conv_id", "node").agg(one)
                  .select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("tree"), "conv_id", "node", "r.*"), "nodes")
    real = nodes.select("tree", F.col("node").alias("parent")).withColumn("there", F.lit(True))
    jump = stage(nodes.join(real, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"),
        F.col("score").cast("double").alias("total")), "jumps")
    n = jump.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, own = [], jump.select("tree", "node", F.col("total").alias("own"))
    levels = max(n - 1, 0).bit_length()
    for level in range(levels + 1):
        jumps.append(jump.select("tree", "node", "up"))
        above = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        jump = stage(jump.join(above, ["tree", "up"], "left").select(
            "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total")), "jumps")
        if not jump.where("up is not null").limit(1).count():
            break
    leaves = jump.where("up is null").join(nodes.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node")))
    if branches.best is not None:
        ranked = ranked.where(F.col("rank") <= branches.best)
    parts = ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("depth").alias("place"), (F.col("depth") + 1).alias("length"))
    for level in reversed(range(len(jumps))):
        half = 1 << level
        upper = parts.where(F.col("length") > half).join(jumps[level], ["tree", "node"]).select(
            "tree", "leaf", "rank", F.col("up").alias("node"), (F.col("place") - half).alias("place"), (F.col("length") - half).alias("length"))
        parts = stage(parts.withColumn("length", F.least("length", F.lit(half).cast("long"))).unionByName(upper), "parts")
    return parts.join(nodes, ["tree", "node"]).select("conv_id", "leaf", "rank", "place", "role", "text")


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, leaf, rank, n_turns, text, loss): each path of ``paths`` as one text; ``loss`` holds the (start, end) code
    points of the escaped texts of role ``learn``. Places of turns are running sums in Spark, not in a row."""
    turn = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END))
    path = Window.partitionBy("conv_id", "leaf").orderBy("place")
    laid = (turns.withColumn("turn", turn).withColumn("after", F.sum(F.length("turn").cast("long")).over(path))
            .withColumn("end", F.col("after") - len(END)).withColumn("start", F.col("end") - F.length(escape(F.col("text")))))
    rows = F.array_sort(F.collect_list(F.struct("place", "turn")))
    spans = F.array_sort(F.collect_list(F.when(F.col("role") == learn, F.struct("start", "end"))))
    return laid.groupBy("conv_id", "leaf", "rank").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(rows, lambda r: r["turn"]), "").alias("text"), spans.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, leaf, rank, place, role, text, learnt) from the formatted text and loss spans alone.

    A text is cut at its turn ends; each turn's places are running sums again. ``learnt`` holds where a loss span covers
    the turn's text and nothing else.
    """
    pieces = (chats.select("conv_id", "leaf", "rank", F.posexplode(F.split("text", END.replace("|", r"\|"))).alias("place", "piece"))
              .where("piece <> ''"))
    path = Window.partitionBy("conv_id", "leaf").orderBy("place")
    turns = (pieces.withColumn("end", F.sum(F.length("piece").cast("long") + len(END)).over(path) - len(END))
             .withColumn("role", unescape(F.expr(f"substring(piece, {len(TURN) + 1}, instr(piece, '{TEXT}') - {len(TURN) + 1})")))
             .withColumn("raw", F.expr(f"substring(piece, instr(piece, '{TEXT}') + {len(TEXT)})"))
             .withColumn("start", F.col("end") - F.length("raw")))
    loss = chats.select("conv_id", "leaf", F.explode("loss").alias("s")).select(
        F.col("conv_id").alias("c"), F.col("leaf").alias("l"), "s.start", "s.end", F.lit(True).alias("hit"))
    t, s = turns.alias("t"), loss.alias("s")
    return t.join(s, F.expr("t.conv_id <=> s.c and t.leaf = s.l and t.start = s.start and t.end = s.end"), "left").select(
        "conv_id", "leaf", "rank", "t.place", "role", unescape(F.col("raw")).alias("text"), F.coalesce("hit", F.lit(False)).alias("learnt"))


def format_trees(trees: DataFrame, branches: Branches = Branches(), learn: str = "assistant") -> DataFrame:
    """The chosen branches of reply trees as conversations; see ``paths`` and ``formatted``. No rows give no rows."""
    return formatted(paths(trees, branches), learn)
