"""Operator 7, WARC: a deterministic sharded writer and its reader.

Digests of equal payloads are found first, narrow: only digests that occur twice keep a row, with their smallest page. The
bounds of the ranges come from the data alone: exact running sums of the payloads' bytes in order of page, digest and url's hash, cut at every
RANGES-th of their total, between two limits, so that rows without an id, or of one page, spread over ranges too. A range's
number, place by place, deals the records out, so that any number of partitions, and any rerun, gives the same files. Every task sorts its range and writes compressed records, one gzip member
each, to files under a temporary name and rolls to the next at a compressed size; headers and digests are made anew from the
payload. Only what a successful task returns is committed: tasks give those files their final names, the manifest follows, and
the rest goes, so that retries and speculative tasks leave nothing behind. Files go through pyarrow's file systems: to any
address they know.

Defined cases: a null or empty payload has 0 bytes and its own digest; of rows with one page_id and one payload, the first by the
hash of its url is the response and the others revisit it; rows equal in all three lie beside each other in one range; a null page_id comes last; a missing url is written as an
empty target; a payload of any length is one record; an empty table gives a manifest without files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.session import scratch_dir, shared_dir, ship_package

#: A file is closed once it holds so many compressed bytes.
ROLL_BYTES = 256 << 20
#: Ranges of pages that a table is cut into, and the least and most bytes of payload that one holds (but for a page's own).
RANGES, RANGE_BYTES = 64, (8 << 20, 1 << 30)
#: Payloads from this size on are written once.
LEAST_BYTES = 0
#: Digest tables of up to this many rows (some 4 MB) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 50_000
#: Files that one task renames.
RENAMES = 256
#: One date for all records: reruns write the same bytes.
DATE = "2020-01-01T00:00:00Z"
CHUNK = 1 << 20


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(record_id: str) -> int | None:
    name = record_id.rstrip(">").rpartition(":")[2]
    return None if name == "none" else int(name)


def encode_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member, with headers regenerated from the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = b""
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    else:
        block = payload
    head += [f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: text/html", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def decode_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of a file that arrives in chunks."""
    member, out = zlib.decompressobj(31), []
    for data in chunks:
        while data:
            out.append(member.decompress(data))
            data = member.unused_data
            if member.eof:
                head, _, rest = b"".join(out).partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                headers = dict(line.split(": ", 1) for line in lines[1:])
                block = rest[: int(headers["Content-Length"])]
                if len(rest) != len(block) + 4:
                    raise ValueError("a record's length differs from its header")
                yield headers, block
                member, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("a file ends within a record")


WRITTEN = "part int, nth int, temporary string, records long, bytes long, sha256 string"


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, nth, out, done = task.partitionId(), 0, None, []
        last = None

        def close() -> None:
            nonlocal out, nth
            if out is not None:
                out.close()
                done.append((part, nth, name, records, size, digest.hexdigest()))
                out, nth = None, nth + 1

        for big in batches:
            for at in range(0, big.num_rows, 64):
                for r in big.slice(at, 64).to_pylist():
                    if out is None:
                        # the attempt's own name: a retry never meets what an earlier attempt left
                        name = f"_temporary/{part:06d}-{nth:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
                        out, size, records, digest = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0, hashlib.sha256()
                    payload = (r["html"] or "").encode()
                    same = (r["page_id"], r["digest"], r["url_hash"])
                    first = r["first"] if r["twice"] else r["page_id"]
                    revisit = len(payload) >= r["least"] and r["twice"] and ((first, r["first_url"]) != (r["page_id"], r["url_hash"]) or same == last)
                    last = same
                    data = encode_record(r["page_id"], r["url"], payload, first, revisit)
                    out.write(data)
                    digest.update(data)
                    size, records = size + len(data), records + 1
                    if size >= roll:
                        close()
        close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "nth", "temporary", "records", "bytes", "sha256"), x, strict=True)) for x in done],
            schema=pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]),
        )

    return run


#: What orders records: a missing page last, then page, digest and url, the last two by hash.
ORDER = ("none", "page", "digest_hash", "url_hash")


def record_bounds(records: DataFrame, ranges: tuple[int, tuple[int, int]] = (RANGES, RANGE_BYTES)) -> list[tuple]:
    """The first key of every range but the first, from (*ORDER, bytes) rows: a record goes to the number of bounds up to it."""
    by_key = records.groupBy(*ORDER).agg(F.sum("bytes").alias("bytes"))
    # the order's partitions may fall anywhere: running sums don't depend on them
    ordered = by_key.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()).checkpoint()
    parts = ordered.groupBy("part").agg(F.sum("bytes").alias("held")).select("part", "held").orderBy("part").collect()
    if not parts:
        return []
    held = np.array([r.held for r in parts], np.int64)
    least, most = ranges[1]
    size = int(min(max(held.sum() // ranges[0], least), most))
    base = ordered.sparkSession.createDataFrame([(r.part, int(at)) for r, at in zip(parts, held.cumsum() - held, strict=True)], "part int, base long")
    inside = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))
    numbered = ordered.join(F.broadcast(base), "part").withColumn("at", at).select(F.struct(*ORDER).alias("key"), F.expr(f"at div {size}").alias("nth"))
    first = numbered.groupBy("nth").agg(F.min("key").alias("first")).where("nth > 0").orderBy("nth").collect()
    return [tuple(r.first) for r in first]


def _renamer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for old, new in zip(b.column("temporary").to_pylist(), b.column("name").to_pylist(), strict=True):
                # a retry finds what an earlier attempt has renamed
                if store.get_file_info(f"{base}/{old}").type != fs.FileType.NotFound:
                    store.move(f"{base}/{old}", f"{base}/{new}")
                elif store.get_file_info(f"{base}/{new}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{old}")
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    return run


def write_warc(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", roll: int = ROLL_BYTES, least: int = LEAST_BYTES, ranges: tuple[int, tuple[int, int]] = (RANGES, RANGE_BYTES)
) -> list[dict]:
    """Writes pages as WARC files under folder, with manifest.json; returns the manifest's entries (a row for every file)."""
    spark = pages.sparkSession
    ship_package(spark)
    shared_dir(spark)
    html = F.coalesce("html", F.lit(""))
    rows = (
        pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))
        .withColumn("digest", F.unhex(F.sha1(html.cast("binary"))))
        .withColumns({"none": F.col("page_id").isNull(), "page": F.coalesce("page_id", F.lit(0)), "digest_hash": F.xxhash64("digest"), "url_hash": F.xxhash64("url")})
    )
    narrow = rows.select("page_id", "digest", *ORDER, (F.octet_length(html) + 64).cast("long").alias("bytes")).checkpoint()
    first = F.min(F.struct("none", "page_id", "url_hash"))
    twice = narrow.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.url_hash").alias("first_url"), F.lit(True).alias("twice")).checkpoint()
    if twice.count() <= BROADCAST_ROWS:
        twice = F.broadcast(twice)
    bounds = record_bounds(narrow.select(*ORDER, "bytes"), ranges)

    @F.arrow_udf("int")
    def place(none: pa.Array, page: pa.Array, digest_hash: pa.Array, url_hash: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, x) for x in zip(*(c.to_pylist() for c in (none, page, digest_hash, url_hash)), strict=True)], pa.int32())

    records = (
        rows.join(twice, "digest", "left")
        .select("page_id", "url", "html", "digest", "first", "first_url", F.coalesce("twice", F.lit(False)).alias("twice"), F.lit(least).alias("least"), *ORDER)
        .withColumn("part", place(*ORDER))
        .repartitionById(len(bounds) + 1, "part")
        .drop("part")
        .sortWithinPartitions(*ORDER, "digest", F.col("url").asc_nulls_last())
    )
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{base}/_temporary")
    written = records.mapInArrow(_writer(folder, roll), WRITTEN).collect()
    names = [(w, f"part-{w.part:06d}-{w.nth:04d}.warc.gz") for w in sorted(written, key=lambda w: (w.part, w.nth))]
    if names:
        moves = spark.createDataFrame([(w.temporary, name) for w, name in names], "temporary string, name string")
        moves.repartition(-(-len(names) // RENAMES)).mapInArrow(_renamer(folder), "name string").count()
    manifest = [{"name": name, "records": w.records, "bytes": w.bytes, "sha256": w.sha256} for w, name in names]
    with store.open_output_stream(f"{base}/_temporary/manifest.json") as f:
        f.write(json.dumps({"files": manifest}, indent=1).encode())
    store.move(f"{base}/_temporary/manifest.json", f"{base}/manifest.json")
    store.delete_dir(f"{base}/_temporary")
    return manifest


READ = "page_id long, url string, html binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest names; digests of payloads are computed again and must agree."""
    ship_package(spark)
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column("name").to_pylist():
                made, size = [], 0
                with there.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for head, block in decode_records(iter(lambda f=f: f.read(CHUNK), b"")):
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (base64.b32encode(hashlib.sha1(block).digest()).decode() != digest or len(block) != int(head["X-Payload-Length"])):
                            raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} differs from its headers")
                        made.append({"page_id": _page(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "html": block, "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": _page(head["WARC-Refers-To"]) if kind == "revisit" else None})
                        size += len(block)
                        if size > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(made, schema=schema)
                            made, size = [], 0
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    # one file a task
    files = spark.createDataFrame([(n,) for n in names], "name string").repartitionByRange(max(1, len(names)), "name")
    return files.mapInArrow(run, READ)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id) AS first,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest
  FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
