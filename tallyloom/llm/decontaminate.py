"""Benchmark passages in training texts: found by a broadcast hash set of n-grams, verified, and removed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import ascii_lower, let, staged_keys

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Distinct benchmark windows broadcast at once; a longer list is worked off in blocks of about this many.
BLOCK_WINDOWS = 300_000


def words_of(text: Column) -> Column:
    """Words of the lower-cased whole text: runs of a-z, 0-9 and of all that is not ASCII. Null has none."""
    return F.array_remove(F.split(ascii_lower(text.cast("string")), BETWEEN_WORDS), "")


def _windows(hashes: Column, length: int) -> Column:
    """The hash of each window of ``length`` of the word hashes, in order; empty if there are fewer words."""
    made = F.transform(F.sequence(F.lit(0), F.size(hashes) - length),
                       lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(length)]))
    return F.when(F.size(hashes) >= length, made).otherwise(F.array().cast("array<bigint>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, hash, passage, item_id): each distinct window of each item; a shorter item is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    length = F.least(F.lit(window), F.size("words"))
    cut = items.withColumn("length", length).select(
        "item_id", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1),
                                                   lambda i: F.slice("words", i, F.col("length")))).alias("part"))
    return cut.select("length", F.xxhash64("part").alias("hash"), F.array_join("part", " ").alias("passage"), "item_id").distinct()


def _same_window_hash(length: int) -> Column:
    """The hash that ``_windows`` gives to the words of ``passage``."""
    return let(_hashes(F.split("passage", " ")), lambda h: F.xxhash64(*[F.get(h, F.lit(k)) for k in range(length)]))


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], markers: bool) -> DataFrame:
    """(doc_id, mark, n_words, start, length, passage) for each verified window; with ``markers`` also one row a document
    whose passage is null. ``windows`` (slot, hash, passage) is broadcast; documents are neither moved nor copied."""
    base = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("\0"))).alias("mark"), words_of(F.col("text")).alias("words"))
    lists = let(_hashes(F.col("words")), lambda h: F.array(F.array(F.lit(0).cast("long")), *[_windows(h, n) for n in lengths]))
    each = (base.select("doc_id", "mark", "words", F.posexplode(lists).alias("slot", "list"))
            .select("doc_id", "mark", "words", "slot", F.posexplode("list").alias("start", "hash")))
    length = F.element_at(F.array(F.lit(0), *[F.lit(n) for n in lengths]), each["slot"] + 1)
    passage = F.array_join(F.slice(each["words"], each["start"] + 1, length), " ")
    same = (each["slot"] == windows["slot"]) & (each["hash"] == windows["hash"]) & (passage == windows["passage"])
    joined = each.join(F.broadcast(windows), same, "left" if markers else "inner")
    if markers:
        joined = joined.where((each["slot"] == 0) | windows["passage"].isNotNull())
    return joined.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"), "start", length.alias("length"), "passage")


def _covered(spans: Column) -> Column:
    """Places inside the union of sorted (start, end) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("reach"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"])).cast("long")).alias("n"),
        F.greatest(a["reach"], s["end"]).cast("int").alias("reach"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, mark, spans, items) per document.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A document word inside a
    window of ``window`` words of an item is hit; a document is contaminated if ``share`` times its hit words reach its
    words. ``spans`` are the (start, end) word places of the hits, sorted, possibly overlapping. The windows of the
    benchmark are broadcast in blocks of about ``block_windows``, each block read against all documents, so a large
    benchmark costs more passes, not more memory; hash hits are confirmed by comparing the words.

    Null and empty texts have no words and are clean. Rows equal in doc_id and text are one document and give one row
    (``mark`` is the text's hash); a null doc_id is an id like others. Items repeated or without words add nothing. An
    empty benchmark finds nothing; no documents give no rows.
    """
    grams = stage(benchmark_windows(benchmark, window), "grams")
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most ``window`` numbers
    passages = grams.select("length", "hash", "passage").distinct()
    slot = reduce(lambda c, x: c.when(F.col("length") == x[1], x[0] + 1), enumerate(lengths), F.when(F.lit(False), 0))
    hashed = reduce(lambda c, n: c.when(F.col("length") == n, _same_window_hash(n)), lengths, F.when(F.lit(False), F.lit(0).cast("long")))
    passages = stage(passages.select(slot.alias("slot"), hashed.alias("hash"), "passage"), "passages")
    blocks = -(-passages.count() // block_windows) or 1
    hits = reduce(DataFrame.unionByName, [
        _hits(docs, passages.where(F.pmod(F.col("hash"), F.lit(blocks)) == b) if blocks > 1 else passages, lengths, markers=b == 0)
        for b in range(blocks)])
    hits = stage(hits, "hits")

    spans = (hits.groupBy("doc_id", "mark").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("passage").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("end"))))).alias("spans"))
        .withColumn("n_hit", _covered(F.col("spans"))))
    items = (hits.where("passage is not null").select("doc_id", "mark", "passage").distinct()
             .join(grams.select("passage", "item_id").distinct(), "passage").select("doc_id", "mark", "item_id").distinct()
             .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    both = spans.alias("s").join(items.alias("i"), F.expr("s.doc_id <=> i.doc_id and s.mark = i.mark"), "left")
    listed = F.coalesce(F.col("i.items"), F.array().cast("array<string>"))
    return both.select(
        "s.doc_id", "n_words", "n_hit", F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "s.mark", "spans", listed.alias("items"))


def _marked(docs: DataFrame, found: DataFrame, how: str):
    """``docs`` joined with ``found`` (doc_id, mark, ...) by id and text, whatever other columns either has."""
    keys = found.withColumnsRenamed({c: f"__{c}" for c in found.columns})
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("\0")))
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["__doc_id"]) & (mark == keys["__mark"]), how)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns and texts as they are."""
    found = contamination(docs, benchmark, **options).where("contaminated").select("doc_id", "mark")
    return _marked(docs, staged_keys(found, "contaminated"), "left_anti").select(*[docs[c] for c in docs.columns])


def drop_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with all hit words cut out of ``text``; what stands between them stays."""
    found = stage(contamination(docs, benchmark, **options).where("n_hit > 0").select("doc_id", "mark", "spans"), "spans")
    joined = _marked(docs, found, "left")
    whole = docs["text"].cast("string")
    words, gaps = F.regexp_extract_all(whole, F.lit(WORD_ANY_CASE), F.lit(0)), F.split(whole, WORD_ANY_CASE)
    inside = lambda i: F.exists(F.col("__spans"), lambda p: (p["start"] <= i) & (i < p["end"]))
    left = F.transform(words, lambda w, i: F.when(inside(i), F.lit("")).otherwise(w))
    text = F.when(F.col("__spans").isNull(), docs["text"]).otherwise(
        F.array_join(F.zip_with(gaps, left, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), ""))
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
