"""Token totals for every context limit from an exact histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Lengths of one block: sums are suffixed inside blocks, and over the short list of blocks.
BLOCK = 4096


def length_histogram(lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The exact histogram of ``n_tokens`` with suffix sums, one row for each length that occurs.

    Columns: n_tokens, n_docs, tokens (of documents of that length), docs_longer and tokens_longer (strictly),
    docs_within (at most that length), share_within, truncated_tokens (all documents cut at that length), total_docs and
    total_tokens. Rows without length are ignored; an empty table gives an empty histogram.

    Documents are counted in the map tasks, once: the short histogram is staged. Suffix sums are windows inside blocks of ``block`` lengths; what lies beyond
    a block comes from one row per block, so no task sorts all lengths.
    """
    counts = stage(lengths.where("n_tokens is not null").groupBy(F.col("n_tokens").cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / block))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_beyond"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_beyond"),
                           F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = lambda c, b: (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(b)).cast("long")
    out = counts.join(beyond, "block").withColumn("docs_longer", longer("n_docs", "d_beyond")).withColumn("tokens_longer", longer("tokens", "t_beyond"))
    within = F.col("total_docs") - F.col("docs_longer")
    return out.select("n_tokens", "n_docs", "tokens", "docs_longer", "tokens_longer", within.alias("docs_within"), (within / F.col("total_docs")).alias("share_within"),
                      (F.col("total_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
                      "total_docs", "total_tokens")


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row of ``limits`` (context_limit): docs_within, tokens_within and truncated_tokens, from the histogram alone.

    Between two lengths that occur, the sums of the next lower one hold; below all of them, nothing is within. Null limits
    give null answers. ``limits`` is a short list of asked-for sizes; each is met with its own row of the histogram by
    a maximum over the lengths within it.
    """
    asked = F.broadcast(limits.select("context_limit").distinct())
    met = (asked.join(histogram, F.col("n_tokens") <= F.col("context_limit"), "left").groupBy("context_limit")
           .agg(F.max_by(F.struct("docs_within", "docs_longer", "tokens_longer", "total_tokens"), "n_tokens").alias("h")))
    total = histogram.agg(F.max("total_docs").alias("all_docs"))
    return (met.join(F.broadcast(total), F.lit(True), "left").select(
        "context_limit", F.when(F.col("context_limit").isNotNull(), F.coalesce("h.docs_within", F.lit(0))).alias("docs_within"),
        F.when(F.col("context_limit").isNotNull(), F.coalesce(F.col("h.total_tokens") - F.col("h.tokens_longer"), F.lit(0))).alias("tokens_within"),
        F.coalesce(F.col("h.total_tokens") - F.col("h.tokens_longer") + F.col("context_limit") * F.col("h.docs_longer"),
                   F.col("context_limit") * F.col("all_docs")).alias("truncated_tokens")))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length within which at least ``share`` of the documents lie."""
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return (histogram.select("n_tokens", "docs_within", "total_docs", asked).where("docs_within >= share * total_docs")
            .groupBy("share").agg(F.min("n_tokens").alias("n_tokens")))
