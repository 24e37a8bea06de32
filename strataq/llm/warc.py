"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing: payloads of at least ``LEAST`` bytes that are equal are kept once; the
record of the largest page_id is a response, the others are revisits that name
it.  Digests with more than one record are found by a pre-aggregated count and
written as a table, so that joining them back is a plain join of two shuffled
sides, whose large partitions Spark can split.  Each partition streams one
archive to the shared folder; its dictionary is trained on the partition's
first payloads (``TRAIN_BYTES`` at most) and made of the fixed header text
where those are too few.

Reading: an archive's leading skippable frame gives the dictionary; then each
frame is decoded by itself and must hold one whole record: version line,
header lines, a block of Content-Length bytes, and two line ends.  A response's
payload must have the length and digest that its headers state.  Anything else
raises ``ValueError``.

Defined cases: a null payload is empty; a null url is left out, and control
characters in a url are percent-encoded; a null page_id is "null" in the
record's name, never the largest while others exist, and read back as null;
rows that repeat the largest page_id with the same payload are all responses;
an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm._store import drop, kept, new_dir, opened, put

# Fixed values of the format.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

LEAST = 0
TRAIN_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
LEVEL = 3
READ_BYTES = 1 << 20


def _name(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(null|-?\d+)>", name)
    if not found:
        raise ValueError(f"no record of a page: {name!r}")
    return None if found[1] == "null" else int(found[1])


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record's bytes."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page)), ("WARC-Date", DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    lines.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode().split("\r\n") if raw else []:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"no header line: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(headers: dict[str, str]) -> int:
    if not re.fullmatch(r"[0-9]+", text := headers.get("content-length", "")):
        raise ValueError("Content-Length is missing or no number")
    return int(text)


def parsed(raw: bytes) -> dict:
    """A record's fields, after all checks."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not gap:
        raise ValueError("no WARC record")
    headers = _headers(lines)
    size = _length(headers)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1."):
        raise ValueError("a block is no HTTP response")
    length = _length(_headers(http.partition(b"\r\n")[2]))
    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "")
    if kind not in ("response", "revisit") or not digest.startswith("sha1:"):
        raise ValueError("a header is missing")
    digest = digest[5:]
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload differs from its length or digest")
    if kind == "revisit" and payload:
        raise ValueError("a revisit has a payload")
    return {
        "page_id": _page(headers.get("warc-record-id", "")), "url": headers.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": length,
        "payload_digest": digest, "record_type": kind, "refers_to": _page(headers.get("warc-refers-to", "")) if kind == "revisit" else None,
    }


def archive(records: Iterable[tuple]) -> Iterator[bytes]:
    """An archive's bytes from the arguments of its records."""
    records = iter(records)
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r[2])
        if size >= TRAIN_BYTES:
            break
    if not first:
        return
    samples = [record(*r)[: DICTIONARY_BYTES * 4] for r in first]
    try:
        content = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        content = record(0, "", b"", "", None, False) + record(0, "", b"", "", 0, True)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(content)
    yield struct.pack("<II", SKIPPABLE, len(packed)) + packed
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
    for r in itertools.chain(first, records):
        yield pack.compress(record(*r))


def frames(file) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    head = file.read(8)
    if len(head) < 8:
        raise ValueError("an archive ends in its first frame")
    magic, size = struct.unpack("<II", head)
    content = file.read(size) if magic == SKIPPABLE else b""
    if magic != SKIPPABLE or len(content) != size:
        raise ValueError("an archive has no leading dictionary frame")
    if content[:4] == zstandard.FRAME_HEADER:
        content = zstandard.ZstdDecompressor().decompress(content)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    ahead = b""
    while True:
        ahead = ahead or file.read(READ_BYTES)
        if not ahead:
            return
        frame, out = unpack.decompressobj(), []
        while True:
            out.append(frame.decompress(ahead))
            if frame.eof:
                break
            ahead = file.read(READ_BYTES)
            if not ahead:
                raise ValueError("an archive ends in a frame")
        ahead = frame.unused_data
        yield b"".join(out)


def _writing(folder: str, key: str, url: str, payload: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.zst"
        n = 0

        def records() -> Iterator[tuple]:
            nonlocal n
            for batch in batches:
                columns = [batch.column(c) for c in (key, url, payload, "sha1", "refers_to", "revisit")]
                for i in range(batch.num_rows):
                    page, address, body, digest, refers, revisit = (c[i].as_py() for c in columns)
                    n += 1
                    yield page, address, body, base64.b32encode(bytes.fromhex(digest)).decode(), refers, revisit

        rows = records()
        head = next(rows, None)
        if head is not None:
            size = put(uri, archive(itertools.chain((head,), rows)))
            yield pa.RecordBatch.from_pylist([{"path": uri, "records": n, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_archives(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> list[dict]:
    """Writes an archive a partition; lists path, records and bytes of each."""
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    rows = pages.select(F.col(key).cast("long").alias(key), F.col(url).cast("string").alias(url), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias(payload)).withColumn("sha1", F.sha1(payload))
    several = rows.where(F.octet_length(payload) >= least).groupBy("sha1").agg(F.max(key).alias("largest"), F.count("*").alias("n")).where("n > 1").select("sha1", "largest")
    several, at_several = kept(several, "warc-digests")
    again = F.col("largest").isNotNull() & ~F.col(key).eqNullSafe(F.col("largest"))
    marked = rows.join(several, "sha1", "left").select(key, url, payload, "sha1", F.when(again, F.col("largest")).alias("refers_to"), again.alias("revisit"))
    written = marked.mapInArrow(_writing(folder, key, url, payload), "path string, records long, bytes long").collect()  # a row an archive
    drop(spark, at_several)
    return [r.asDict() for r in written]


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def _reading(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, FIELDS[n]) for n in names])
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            with opened(path) as file:
                rows, size = [], 0
                for raw in frames(file):
                    found = parsed(raw)
                    rows.append({n: found[n] for n in names})
                    size += len(raw) if "payload" in names else 256
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, archives: list[dict], columns: list[str] | None = None) -> DataFrame:
    """The archives' records, every one checked; a task for each archive."""
    kinds = {"page_id": "long", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}
    names = columns or list(kinds)
    listed = spark.createDataFrame(spark.sparkContext.parallelize([(a["path"],) for a in archives], max(1, len(archives))), "path string")
    return listed.mapInArrow(_reading(names), ", ".join(f"{n} {kinds[n]}" for n in names))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back."""
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read_archives(spark, archives, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


QUERIES = {"op10_warc_zstd": op10_warc_zstd}
ORACLE_SQL = {
    "op10_warc_zstd": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    ((strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1) >> (3 - (5 * i) % 4)::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m"""
}
