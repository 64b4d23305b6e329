"""Byte-level BPE: long texts are pre-tokenised in overlapping chunks, stitched, and encoded piece by piece."""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Code points of a chunk's own part, and of the part it shares with the next chunk.
CHUNK, OVERLAP = 24_576, 512
#: Near a chunk's end a boundary may owe itself to the cut: the pattern looks at most so many code points ahead. It holds for
#: ``PATTERN``; a pattern that looks farther needs more.
LOOK_AHEAD = 4
#: Pre-tokens of one generation of a worker's memo; the generation before is kept as well.
MEMO_TOKENS, MEMO_LENGTH = 1 << 18, 64


class Encoder(dict):
    """Pre-token -> its ids as packed little-endian unsigned 32-bit integers; merges happen at first sight of a pre-token."""

    def __init__(self, ranks: bytes, pattern: str):
        super().__init__()
        self.before: dict[str, bytes] = {}
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)

    def __missing__(self, token: str) -> bytes:
        ids = self.before.get(token)
        if ids is None:
            merged = self.merged(token.encode("utf-8", "replace"))
            ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(token) <= MEMO_LENGTH:
            if len(self) >= MEMO_TOKENS:  # what is still in use comes back from there
                self.before = dict(self)
                self.clear()
            self[token] = ids
        return ids

    def merged(self, token: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, leftmost first, until no pair has a rank; n log n steps."""
        if token in self.ranks:
            return [self.ranks[token]]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := rank(token[i:after[j]])) is not None:
                heapq.heappush(heap, (r, i, after[j]))

        heap: list[tuple[int, int, int]] = []
        gone = bytearray(n)
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or after[j] != end:
                continue  # one of the two parts has changed since
            gone[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i:after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(ranks, pattern)


def _file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def starts(pattern: regex.Pattern, text: str) -> list[int]:
    return [m.start() for m in pattern.finditer(text)]


def cuts(found: list[int], text: str) -> list[int]:
    """Those starts at which the text may be cut: sure despite the text's end, and not after white space, since how white
    space is split depends on what follows it."""
    return [s for s in found if 0 < s <= len(text) - LOOK_AHEAD and not text[s - 1].isspace()]


def stitch(chunks: list[tuple[str, list[int], list[int], int]], chunk: int, pattern: regex.Pattern) -> Iterator[str]:
    """Pieces of one text, cut only at true pre-token boundaries.

    A chunk is (text, starts in its head, starts in its tail, last sure start of its own part); tail places count from the next chunk's
    first code point. From a place where both neighbours have a boundary on, their pre-tokens are the same. Where
    the overlap has none, the text from the last sure boundary on is pre-tokenised again together with following
    chunks, each time twice as many, until it meets one.
    """
    text, _, tail, last = chunks[0]
    begin, core, k = 0, chunk, 0
    while k + 1 < len(chunks):
        head = set(chunks[k + 1][1])
        meet = next((p for p in tail if p in head), None)
        if meet is not None:
            yield text[begin:core + meet]
            (text, _, tail, last), begin, core, k = chunks[k + 1], meet, chunk, k + 1
            continue
        sure = max(last, begin)
        if sure > begin:
            yield text[begin:sure]
        more, parts = 1, [text[sure:core]]
        while True:
            joined = chunks[k + 1:k + 1 + more]
            k += len(joined)
            parts += [c[0][:chunk] for c in joined[:-1]] + [joined[-1][0]]
            text = "".join(parts)
            core = len(text) - len(joined[-1][0]) + min(chunk, len(joined[-1][0]))
            found = cuts(starts(pattern, text), text)
            tail, last, begin = [s - core for s in found if s >= core], max((s for s in found if s <= core), default=0), 0
            if k + 1 >= len(chunks) or set(tail) & set(chunks[k + 1][1]):
                break
            parts, more = [text[:core]], 2 * more
    yield text[begin:]


def _cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, mark, k, part): the overlapping chunks of texts that are longer than one chunk."""
    t = F.col("t")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.length(t) / chunk).cast("int") - 1), lambda k: F.substring(t, k * chunk + 1, F.lit(chunk + overlap)))
    return docs.where(F.length(t) > chunk + overlap).select("doc_id", F.xxhash64(t).alias("mark"), F.posexplode(parts).alias("k", "part"))


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text): ``ids`` packed as little-endian unsigned 32-bit integers.

    A text within one chunk is a piece by itself and is encoded where it is read. A longer text is cut into overlapping
    chunks that are dealt out, pre-tokenised in parallel, stitched, and dealt out again as pieces; the ids of its pieces
    are then joined in order. No special tokens. Null and empty texts give no ids; repeated rows give repeated results; a
    null doc_id is carried through; no rows give no rows; other columns are ignored. ``ranks`` is read on the driver.
    """
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(_file(ranks))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(table.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = pa.array([own.encode(t.as_py()) for t in part.column(part.num_columns - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*part.schema.names[:-1], "ids"])

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                heads, tails, lasts = [], [], []
                for text in part.column("part"):
                    text = text.as_py()
                    found = starts(split, text)
                    sure = cuts(found, text)
                    heads.append([s for s in found if s < overlap])
                    tails.append([s - chunk for s in sure if s >= chunk])
                    lasts.append(max((s for s in sure if s <= chunk), default=0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32())), pa.array(lasts, pa.int32())],
                                                 [*part.schema.names, "head", "tail", "last"])

    def stitched(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        copies = int((rows["k"] == 0).sum())
        rows = rows.drop_duplicates("k").sort_values("k")
        chunks = [(t, list(h), list(u), e) for t, h, u, e in zip(rows["part"], rows["head"], rows["tail"], rows["last"])]
        pieces = list(stitch(chunks, chunk, regex.compile(pattern)))
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(key[0]) else int(key[0])] * len(pieces), "Int64"), "mark": key[1], "copies": copies,
                             "j": range(len(pieces)), "piece": pieces})

    texts = texts.withColumn("doc_id", F.col("doc_id").cast("long"))
    short = texts.where(F.length("t") <= chunk + overlap).mapInArrow(tokens, "doc_id long, ids binary")
    seen = (_cut(texts, chunk, overlap).repartition("doc_id", "mark", "k")
            .mapInArrow(boundaries, "doc_id long, mark long, k int, part string, head array<int>, tail array<int>, last int"))
    pieces = seen.groupBy("doc_id", "mark").applyInPandas(stitched, "doc_id long, mark long, copies int, j int, piece string")
    made = pieces.repartition("doc_id", "mark", "j").mapInArrow(tokens, "doc_id long, mark long, copies int, j int, ids binary")
    in_order = F.array_sort(F.collect_list(F.struct("j", F.hex("ids").alias("ids"))))
    long = (made.groupBy("doc_id", "mark", "copies").agg(F.unhex(F.array_join(F.transform(in_order, lambda x: x["ids"]), "")).alias("ids"))
            .select("doc_id", "ids", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "ids"))
    return short.unionByName(long)


def decode(encoded: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``encoded`` (doc_id, ids) with a binary column ``decoded``: the raw bytes of the ids, joined. Null ids are none."""
    table = encoded.sparkSession.sparkContext.broadcast(_file(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(table.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = pa.array([own.decode(x.as_py() or b"") for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, raw], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
