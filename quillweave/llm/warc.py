"""WARC archives in Zstandard: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
itself compressed, and then has one frame for each record. The reader loads the dictionary
from that frame, decodes frame by frame and checks the version line, the mandatory headers,
Content-Length, the record's end, the block digest and the payload digest; a fault raises
ValueError with the archive and the offset.

Archives are rows (archive, n_records, blob) of about ARCHIVE_BYTES in a table in the shared
folder, as any store that Spark can write holds them; export() puts them out as .warc.zst
files in a mounted folder, and read_files() reads such files back through Spark.

Defined cases: a null or empty page is a response with an empty payload; pages with equal
ids are records of their own; a null id is kept; a null address becomes urn:none; control
characters of addresses are escaped; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 4 << 20
SAMPLE = 400  # pages that the dictionary is trained on, and bytes of each
SAMPLE_BYTES = 8192
DICT_BYTES = 64 << 10
LEVEL = 3
MIN_REVISIT = 1000
RECORDS = "archive string, page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _b32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit if it refers to another page."""
    sha = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: {_b32(sha)}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return struct.pack("<II", MAGIC, len(packed)) + packed


def frames(blob: bytes, name: str = "") -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame."""
    if len(blob) < 8:
        raise ValueError(f"{name}: no dictionary frame")
    magic, size = struct.unpack_from("<II", blob)
    if magic != MAGIC or 8 + size > len(blob):
        raise ValueError(f"{name}: no dictionary frame")
    packed = blob[8 : 8 + size]
    raw = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == b"\x28\xb5\x2f\xfd" else packed
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    view, at = memoryview(blob), 8 + size
    while at < len(blob):
        one, out, pos, step = reader.decompressobj(), [], at, 8192
        try:
            while not one.eof:
                if pos >= len(blob):
                    raise ValueError(f"{name} at {at}: the frame is cut off")
                part = view[pos : pos + step]
                out.append(one.decompress(part))
                pos += len(part)
                step *= 2
        except zstandard.ZstdError as e:
            raise ValueError(f"{name} at {at}: {e}") from e
        yield at, b"".join(out)
        at = pos - len(one.unused_data)


def parse(data: bytes, where: str = "") -> dict:
    """Headers and payload of one record, checked."""

    def need(ok: object, what: str) -> None:
        if not ok:
            raise ValueError(f"{where}: {what}")

    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    need(sep and lines[0] == "WARC/1.1", "not a WARC/1.1 record")
    h = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        need(colon, f"bad header {line[:60]!r}")
        h[k.strip().lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        need(k in h, f"no {k}")
    need(h["content-length"].isdigit(), "bad content-length")
    n = int(h["content-length"])
    need(len(rest) == n + 4 and rest[n:] == b"\r\n\r\n", "content-length does not fit the record")
    block = rest[:n]
    need(h.get("warc-block-digest") in (None, _b32(hashlib.sha1(block).digest())), "block digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    need(sep, "no HTTP header")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    need(size is not None, "no HTTP content-length")
    kind = h["warc-type"]
    need(kind in ("response", "revisit"), f"unknown type {kind}")
    if kind == "response":
        need(len(payload) == size, "HTTP content-length does not fit the payload")
        need(_b32(hashlib.sha1(payload).digest()) == h["warc-payload-digest"], "payload digest")
    else:
        need(not payload and "warc-refers-to" in h, "bad revisit")
    page = lambda x: int(x[len("<urn:page:") : -1]) if x and x[len("<urn:page:") : -1] else None
    return {
        "page_id": page(h["warc-record-id"]), "uri": h.get("warc-target-uri"), "record_type": kind, "refers_to": page(h.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "payload": payload if kind == "response" else None,
    }


def train(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample: SAMPLE pages, SAMPLE_BYTES of each."""
    rows = pages.where("html <> ''").select(F.encode(F.substring("html", 1, SAMPLE_BYTES), "utf-8").alias("b")).limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(r["b"]) for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        return b""


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds refers_to: of equal payloads of at least MIN_REVISIT bytes the largest page_id is
    the response. Payloads are equal if length and SHA-1 are. Only payloads that repeat reach
    the join, by a table whose size the planner knows."""
    p = pages.withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("n", F.octet_length("html")).withColumn("sha", F.when(F.col("n") >= MIN_REVISIT, F.sha1(F.col("html").cast("binary"))))
    top = stored(
        p.where("sha IS NOT NULL").groupBy("sha", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1").drop("c"), "payloads"
    )
    return p.join(top, ["sha", "n"], "left").select("page_id", "url", "html", F.when(F.col("top") != F.col("page_id"), F.col("top")).alias("refers_to"))


def write(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> a stored table of archives."""
    dictionary = train(pages)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        comp = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        head, task, k = dictionary_frame(dictionary), TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"part-{task:05d}-{k:05d}"], "n_records": pa.array([len(parts) - 1], pa.int64()), "blob": pa.array([b"".join(parts)], pa.binary())})

        for b in batches:
            for page_id, url, html, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not parts:
                    parts, size = [head], 0
                parts.append(comp.compress(record(page_id, url, html.encode(), ref)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    parts, k = [], k + 1
        if parts:
            yield out()

    return stored(with_revisits(pages).mapInArrow(build, "archive string, n_records long, blob binary"), "warc")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """archives (archive, n_records or null, blob) -> RECORDS, checked one by one."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    names = names if payloads else names[:-1]
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, n, blob = (c[i].as_py() for c in b.columns)
                seen, rows, size = 0, [], 0
                for at, data in frames(blob, name):
                    rows.append(parse(data, f"{name} at {at}") | {"archive": name})
                    seen, size = seen + 1, size + len(data)
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names)
                        rows, size = [], 0
                if n is not None and n != seen:
                    raise ValueError(f"{name}: {seen} records, not {n}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names)

    return archives.select("archive", "n_records", "blob").mapInArrow(decode, RECORDS if payloads else RECORDS.rpartition(",")[0])


def export(archives: DataFrame, folder: str) -> None:
    """Writes <archive>.warc.zst files into a folder that all executors mount."""

    def put(rows: Iterable) -> None:
        import os

        for r in rows:
            with open(f"{folder}/.{r['archive']}.tmp", "wb") as f:
                f.write(r["blob"])
            os.replace(f"{folder}/.{r['archive']}.tmp", f"{folder}/{r['archive']}.warc.zst")

    archives.foreachPartition(put)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return read(files.select(F.col("path").alias("archive"), F.lit(None).cast("long").alias("n_records"), F.col("content").alias("blob")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages").select("page_id", "url", "html")), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> top THEN top END AS refers_to
FROM q"""
