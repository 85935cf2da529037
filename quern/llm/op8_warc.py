"""Deterministic sharded WARC archives: range-sorted records, rolled files, fresh headers and digests, manifests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, shared_dir, small_side, text_batches
from .files import Store

#: Payload bytes that a shard is meant to hold, and compressed bytes at which a file is rolled.
SHARD_BYTES, FILE_BYTES = 16 << 20, 8 << 20
#: Tasks that write shards; of more shards, a task writes several.
TASKS = 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BROADCAST_ROWS = 500_000
_NAMES = uuid.UUID("6f3a8c1e-5d0b-4a53-9c0e-2f6a7c1d9b42")


def bounds(pages: DataFrame, target: int) -> list[int]:
    """Ids at which shards begin: the same for the same table, however it is split.

    Ids are sorted in ranges and the bytes before each are summed up, within a range and over the ranges before it; a shard
    begins where that passes a multiple of target. An id's rows stay together. The driver gets a number for each shard."""
    sizes = pages.where("page_id is not null").groupBy("page_id").agg(F.sum(F.octet_length("payload")).alias("n"))
    ranged = cut(sizes.repartitionByRange("page_id").withColumn("part", F.spark_partition_id()))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = ranged.groupBy("part").agg(F.sum("n").alias("held")).select("part", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("offset"))
    own = Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.select("page_id", "part", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before")).join(F.broadcast(offsets), "part")
    shard = F.floor((F.col("before") + F.col("offset")) / F.lit(target))
    return sorted(r[0] for r in before.groupBy(shard.alias("shard")).agg(F.min("page_id").alias("first")).select("first").collect())


def _clean(url: str | None, page_id) -> str:
    """A target URI that fits on a header line: controls, blanks and non-ASCII characters percent-encoded."""
    text = url if url else f"urn:page:{page_id}"
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], text.encode()).decode()


def _b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One record with header and block; a revisit (refers_to a page) has the HTTP header alone as its block."""
    digest = _b32(hashlib.sha1(payload).digest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Target-URI: {_clean(url, page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).digest())}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member of its own, without a time stamp."""
    return gzip.compress(data, 6, mtime=0)


_MANIFEST = "file string, shard long, records long, bytes long, sha1 string"


def _write_rows(top: str, file_bytes: int):
    """(shard, page_id, url, payload, refers_to), sorted, to archive files; a row of the manifest for each."""

    def run(batches):
        store, out, rows, key, seq = Store(top), None, [], None, 0

        def close():
            nonlocal out
            temporary, stream, done, n, digest = out
            stream.close()
            name = f"shard-{key:06d}-{seq:05d}.warc.gz"
            store.commit(temporary, name)
            rows.append((name, key, n, done, digest.hexdigest()))
            out = None

        for batch in batches:
            for shard, page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out and (shard != key or out[2] >= file_bytes):
                    close()
                    seq = seq + 1 if shard == key else 0
                if shard != key:
                    seq = 0
                key = shard
                if out is None:
                    out = [*store.create(), 0, 0, hashlib.sha1()]
                data = _member(record(page_id, url, payload, refers_to))
                out[1].write(data)
                out[4].update(data)
                out[2], out[3] = out[2] + len(data), out[3] + 1
        if out:
            close()
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["file", "shard", "records", "bytes", "sha1"])

    return run


def write_archives(pages: DataFrame, top: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) below top; returns the manifest.

    Of records with equal payloads of at least `least` bytes, the one with the largest page_id is the response
    and the others are revisits that refer to it. Records are sorted by page_id within shards of id ranges; a
    file is rolled when its compressed bytes reach file_bytes, so files depend on the rows alone. Files appear
    under their names when complete, and count only once the manifest, written last, lists them: a lost
    executor or a failed job leaves nothing that a reader takes for an archive.

    Null html is an empty payload; a null page_id stands in a shard of its own and never is the response of
    others; rows that share page_id and payload are all responses; an empty table gives an empty manifest.
    Extra columns are ignored.
    """
    spark = pages.sparkSession
    text_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.select("*", F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("check"))
    again = keyed.where(F.octet_length("payload") >= least).groupBy("digest", "check").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1 and top is not null").select("digest", "check", "top")
    starts = bounds(rows, shard_bytes)
    marks = np.array(starts, dtype=np.int64)

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        own = ids.notna()
        return pd.Series(np.where(own, np.searchsorted(marks, ids.fillna(0).astype("int64"), side="right"), 0), dtype="int64")

    refers = F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    marked = keyed.join(small_side(cut(again), BROADCAST_ROWS), ["digest", "check"], "left").select(shard_of("page_id").alias("shard"), "page_id", "url", "payload", refers.alias("refers_to"))
    tasks = min(len(starts) + 1, TASKS)
    dealt = marked.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "page_id", "url", "payload")
    dealt.mapInArrow(_write_rows(top, file_bytes), _MANIFEST).write.mode("overwrite").parquet(f"{top}/manifest")
    return spark.read.parquet(f"{top}/manifest")


def parse(stream) -> dict:
    """The next record of an uncompressed stream: its header fields by lower-cased name, and its block; None at the end."""
    line = stream.readline()
    if not line:
        return None
    if line.strip() != b"WARC/1.1":
        raise ValueError("no record starts here")
    head = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.partition(b":")
        head[name.strip().lower().decode()] = value.strip().decode()
    block = stream.read(int(head["content-length"]))
    if len(block) != int(head["content-length"]) or stream.read(4) != b"\r\n\r\n":
        raise ValueError("record is cut short")
    if head["warc-block-digest"] != "sha1:" + _b32(hashlib.sha1(block).digest()):
        raise ValueError("block digest differs")
    return head | {"block": block}


_FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read_rows(top: str, keep: bool):
    def run(batches):
        store = Store(top)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open(name) as raw, gzip.open(raw) as unzipped, io.BufferedReader(unzipped, 1 << 20) as stream:
                    while (r := parse(stream)) is not None:
                        first = r["warc-type"] == "response"
                        digest, size = r["warc-payload-digest"].removeprefix("sha1:"), int(r["x-payload-length"])
                        payload = r["block"].partition(b"\r\n\r\n")[2] if first else None
                        if first and (len(payload) != size or _b32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError("payload differs from its digest")
                        rows.append((int(r["x-page-id"]) if r["x-page-id"] else None, r["warc-target-uri"], size, digest, r["warc-type"], None if first else int(r["x-refers-to-page"]), payload if keep else None))
                        if len(rows) >= 512:
                            yield _found(rows)
                            rows = []
                if rows:
                    yield _found(rows)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_archives(spark: SparkSession, top: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that top's manifest lists; digests are checked; a task reads whole files."""
    files = spark.read.parquet(f"{top}/manifest").select("file")
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n).mapInArrow(_read_rows(top, payloads), _FOUND)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages", "page_id", "url", "html"), top)
    return read_archives(spark, top, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS h, octet_length(encode(html))::BIGINT AS n FROM p),
b AS (
  SELECT page_id, array_to_string(list_transform(range(0, 40), lambda i:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][
      list_position(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], h[i + 1])]), '') AS bits FROM d),
e AS (
  SELECT page_id, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) + 1]), '') AS digest FROM b),
m AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT d.page_id, d.n AS payload_bytes, e.digest AS payload_digest,
  CASE WHEN d.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> m.top THEN m.top END AS refers_to
FROM d JOIN e USING (page_id) JOIN m ON m.html = d.html
"""
