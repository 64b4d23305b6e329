"""WARC archives with a two-level capture index: written, indexed and read back by Spark tasks."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, stage
from .common import BROADCAST_ROWS

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
#: A task starts another archive file beyond so many bytes.
ARCHIVE_BYTES = 512 << 20
#: Index lines of one compressed block, at least, and directory rows, at most: a longer index gets longer blocks.
BLOCK_LINES, DIRECTORY_ROWS = 1000, BROADCAST_ROWS
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host(url: str | None) -> str:
    """The sort key of a URL: host labels from the right, port, then path and query: com,example,www)/path?query."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return f"){url}"
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member with one WARC record; a revisit has no payload and names the record it repeats."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is None:
        block = payload
    else:
        block = b""
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one compressed record."""
    head, rest = gzip.decompress(data).split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


def _page(urn: str | None) -> int | None:
    tail = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail not in ("", "None") else None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The shared folder as a file system that tasks can write to and read ranges from."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass(frozen=True)
class Archives:
    """Where the records are: ``blocks`` (block, first_key, last_key, lines, data) sorted by key, and their sparse
    ``directory`` (block, first_key, last_key). Both are tables in the shared folder, like the archive files."""

    blocks: DataFrame
    directory: DataFrame


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest and refers_to: of equal payloads of at least 1000 bytes that with
    the largest page_id is written in full, the others revisit it. Null html is an empty payload, null url an empty one."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    groups = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("main"), F.count("*").alias("n")).where("n > 1").select("digest", "main")
    main = F.when(large & ~F.col("page_id").eqNullSafe(F.col("main")), F.col("main"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", main.alias("refers_to"))


def write(records: DataFrame, date: str = "2024-01-01T00:00:00Z", block_lines: int = BLOCK_LINES, archive_bytes: int = ARCHIVE_BYTES) -> Archives:
    """Write every record, then the index over them.

    Each task appends its records to archive files of its own, under names that no other attempt uses, and returns their
    places; a failed attempt's files are in no index. Index lines are sorted by reversed-host key across tasks, cut into
    blocks and compressed; the directory has one row for each block.
    """
    spark = records.sparkSession
    folder = fresh_path(spark, "warc")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], date)
                out.write(data)
                lines.append((reversed_host(r["url"]), r["page_id"], name, at, len(data)))
                at += len(data)
            columns = list(zip(*lines)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                             ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = stage(records.mapInArrow(put, "key string, page_id long, file string, offset long, length long"), "captures")
    total = captures.count()
    lines_each = max(block_lines, -(-total // DIRECTORY_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def block(lines: list[list]) -> pa.RecordBatch:
            text = "\n".join(json.dumps(line, ensure_ascii=False) for line in lines).encode()
            values = [uuid.uuid4().hex], [lines[0][0]], [lines[-1][0]], [len(lines)], [zlib.compress(text)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()))],
                                              ["block", "first_key", "last_key", "lines", "data"])
        for batch in batches:
            held += [[*r.values(), folder] for r in batch.to_pylist()]
            while len(held) >= lines_each:
                yield block(held[:lines_each])
                held = held[lines_each:]
        if held:
            yield block(held)

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    blocks = stage(ordered.mapInArrow(pack, "block string, first_key string, last_key string, lines long, data binary"), "index")
    return Archives(blocks, blocks.select("block", "first_key", "last_key"))


def lookup(archives: Archives, urls: DataFrame) -> DataFrame:
    """(key, page_id, folder, file, offset, length): the captures of each distinct URL of ``urls`` (url).

    The directory, at most ``DIRECTORY_ROWS`` rows however long the index is, goes to every task once; each key is
    binary-searched in it, only blocks that may hold a key are opened, and each of these once.
    """
    spark = urls.sparkSession
    rows = archives.directory.orderBy("first_key", "last_key").collect()
    directory = spark.sparkContext.broadcast(([r["first_key"] for r in rows], [r["last_key"] for r in rows], [r["block"] for r in rows]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, lasts, names = directory.value
        for batch in batches:
            keys, blocks = [], []
            for url in batch["url"]:
                key = reversed_host(url)
                i = bisect.bisect_right(firsts, key) - 1  # the last block that begins at or before the key
                while i >= 0 and lasts[i] >= key:
                    keys.append(key)
                    blocks.append(names[i])
                    if firsts[i] < key:
                        break
                    i -= 1
                    if i >= 0 and lasts[i] < key:
                        break
            yield pd.DataFrame({"key": keys, "block": blocks})

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                lines = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                yield pd.DataFrame(lines, columns=["key", "page_id", "file", "offset", "length", "folder"]).astype({"page_id": "Int64"})

    wanted = stage(urls.select(F.coalesce("url", F.lit("")).alias("url")).distinct().mapInPandas(search, "key string, block string"), "wanted")
    opened = archives.blocks.join(wanted.select("block").distinct(), "block").select("data")
    lines = opened.mapInPandas(unpack, "key string, page_id long, file string, offset long, length long, folder string")
    return lines.join(wanted.select("key").distinct(), "key")


def read(captures: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, payload) of the records at ``captures``, by range reads in file order."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(at, 200).to_pylist():
                    if opened != (r["folder"], r["file"]):
                        if source is not None:
                            source.close()
                        store, root = _store(r["folder"])
                        opened, source = (r["folder"], r["file"]), store.open_input_file(f"{root}/{r['file']}")
                    source.seek(r["offset"])
                    head, block = parse(source.read(r["length"]))
                    kind = head["warc-type"]
                    out.append((_page(head["warc-record-id"]), head["warc-target-uri"] if "warc-target-uri" in head else "", kind, _page(head.get("warc-refers-to")),
                                head["warc-payload-digest"].removeprefix("sha1:"), block if kind == "response" else None))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))],
                                                 ["page_id", "url", "record_type", "refers_to", "digest", "payload"])
        if source is not None:
            source.close()

    near = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(get, "page_id long, url string, record_type string, refers_to long, digest string, payload binary")


def payload_facts(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a revisit takes bytes and digest from the response
    it refers to by page and digest, since a page_id may have several; digests are computed again from the bytes read."""
    facts = stage(records.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha")), "facts")
    named = facts.where("refers_to is not null").select(F.col("refers_to").alias("page_id"), F.col("digest").alias("sha")).distinct()
    mains = (facts.where("record_type = 'response'").join(named, ["page_id", "sha"], "left_semi")
             .groupBy(F.col("page_id").alias("main"), F.col("sha").alias("main_sha")).agg(F.max("size").alias("main_size")))
    return facts.join(mains, (F.col("refers_to") == F.col("main")) & (F.col("digest") == F.col("main_sha")), "left").select(
        "page_id", F.coalesce("size", "main_size").alias("payload_bytes"), F.coalesce("sha", "main_sha").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages``, find every URL in the index again, and read all records back: the rows of ``payload_facts``.

    Every row of ``pages`` is one record: null urls are empty ones, rows that repeat the largest page_id of their payload are
    all responses, rows without page_id revisit like others but are never referred to. No pages give no rows. Other columns are ignored.
    """
    archives = write(plan_records(pages), **options)
    return payload_facts(read(lookup(archives, pages.select(F.col("url").cast("string").alias("url")))))
