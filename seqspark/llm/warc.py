"""WARC archives: one gzip stream a file, rewritten with one gzip member a record and an offset index beside it."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, settle, table

DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Put:
    """Writes under a name of its own and renames when all is written: a task that is run again replaces the whole file."""

    def __init__(self, path: str):
        self.fs, self.path = _fs(path)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own, compression=None)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(kind: str, page_id: int | None, url: str | None, sha1: str, size: int, refers_to: int | None, block: bytes) -> bytes:
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{sha1}')}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode()


def record(page_id: int | None, url: str | None, payload: bytes) -> tuple[bytes, str]:
    """A response record, and the payload's digest."""
    sha1 = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return _header("response", page_id, url, sha1, len(payload), None, block) + block + b"\r\n\r\n", sha1


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an inflated stream: header fields and block. Holds one record and one chunk."""
    held, ended = bytearray(), False
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and not ended:
            more = next(stream, None)
            ended = more is None
            held += more or b""
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        head = fields(bytes(held[:end]))
        need = end + 4 + int(head["Content-Length"]) + 4
        while len(held) < need:
            more = next(stream, None)
            if more is None:
                raise ValueError("the archive ends within a record")
            held += more
        yield head, bytes(held[end + 4 : need - 4])
        del held[:need]


def inflated(file) -> Iterator[bytes]:
    """A whole-file gzip stream, inflated once from front to end; members that follow each other are taken as one stream."""
    z = zlib.decompressobj(31)
    while raw := file.read(CHUNK):
        while raw:
            if out := z.decompress(raw):
                yield out
            raw = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Each task writes its rows (page_id, url, html) as one gzip stream; returns (file, seq, page_id, sha1, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, put, seq = f"part-{TaskContext.get().partitionId():06d}", None, 0
        z = zlib.compressobj(level, wbits=31)
        for batch in batches:
            if not batch.num_rows:
                continue
            put = put or _Put(f"{folder}/{name}.warc.gz")
            ids, urls, html = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            rows = []
            for i, (page_id, url) in enumerate(zip(ids, urls, strict=True)):
                payload = html[i].as_py() or b""
                data, sha1 = record(page_id, url, payload)
                put.out.write(z.compress(data))
                rows.append((name, seq, page_id, sha1, len(payload)))
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["file", "seq", "page_id", "sha1", "size"])
        if put:
            put.out.write(z.flush())
            put.done()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "file string, seq long, page_id long, sha1 string, size long")


def revisits(index: DataFrame, least: int = 0) -> DataFrame:
    """(file, seq, page_id, sha1, size, refers_to): the smallest page with the same payload, null for that page itself, for pages
    without id and for payloads under least bytes. Groups are folded to one row before the shuffle; the join back moves
    narrow rows, and Spark splits a digest that many pages share."""
    first = index.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("sha1", "size").agg(F.min("page_id").alias("least"), F.max("page_id").alias("most")).where("least < most")
    joined = index.join(first.select("sha1", "size", "least"), ["sha1", "size"], "left")
    return joined.select("file", "seq", "page_id", "sha1", "size", F.when(F.col("least") < F.col("page_id"), F.col("least")).alias("refers_to"))


def normalise(decided: DataFrame, source: str, target: str, level: int = 4) -> DataFrame:
    """Rewrite every monolithic archive named in decided with one gzip member a record, and write its index beside it.

    A task takes one file, which holds what one input split held: it inflates the stream once, writes revisit records for the
    rows with refers_to, and notes offset and length of each member. Returns (file, n_records)."""

    def run(rows: pa.Table) -> pa.Table:
        name = rows.column("file")[0].as_py()
        refers = {s: r for s, r in zip(rows.column("seq").to_pylist(), rows.column("refers_to").to_pylist(), strict=True) if r is not None}
        fs, path = _fs(f"{source}/{name}.warc.gz")
        put, index, at, n = _Put(f"{target}/{name}.warc.gz"), _Put(f"{target}/{name}.idx.jsonl"), 0, 0
        with fs.open_input_stream(path, compression=None) as file:
            for seq, (head, block) in enumerate(records(inflated(file))):
                page_id = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
                sha1, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                to = refers.get(seq)
                if to is not None:
                    block = block[: block.index(b"\r\n\r\n") + 4]
                kind = "response" if to is None else "revisit"
                z = zlib.compressobj(level, wbits=31)
                member = z.compress(_header(kind, page_id, head["WARC-Target-URI"], sha1, size, to, block) + block + b"\r\n\r\n") + z.flush()
                put.out.write(member)
                index.out.write((json.dumps({"offset": at, "length": len(member), "type": kind, "page_id": page_id, "url": head["WARC-Target-URI"], "digest": sha1}) + "\n").encode())
                at, n = at + len(member), n + 1
        put.done()
        index.done()
        return pa.table({"file": [name], "n_records": [n]})

    return decided.select("file", "seq", "refers_to").groupBy("file").applyInArrow(run, "file string, n_records long")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Read the records of the archives in files (file) by their indexes: (page_id, payload_bytes, payload_digest, record_type, refers_to, url).

    Digest and length of a response are taken from its payload, those of a revisit from its header."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            fs, path = _fs(f"{folder}/{name}")
            out = []
            with fs.open_input_file(f"{path}.warc.gz") as file, fs.open_input_stream(f"{path}.idx.jsonl", compression=None) as index:
                for line in io.BufferedReader(index):
                    entry = json.loads(line)
                    file.seek(entry["offset"])
                    (head, block), *rest = records(iter([zlib.decompress(file.read(entry["length"]), 31)]))
                    if rest or head["WARC-Type"] != entry["type"]:
                        raise ValueError(f"the index of {name} doesn't fit its archive")
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    whole = entry["type"] == "response"
                    out.append((int(head["X-Page-ID"]) if "X-Page-ID" in head else None, len(body) if whole else int(head["X-Payload-Length"]), digest(body) if whole else head["WARC-Payload-Digest"].removeprefix("sha1:"), entry["type"], int(head["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in head else None, entry["url"]))
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return files.select("file").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html; more columns are left out) to WARC files under folder and read them back.

    Null html is an empty payload; payloads that are equal and at least least bytes are stored once, by the smallest page_id,
    and the other pages' records revisit it. Rows that repeat that page_id are responses too; pages without id are always
    responses and nothing refers to them; null URLs become urn:page:<id>. An empty table gives no files and no rows. Texts are
    streamed a record at a time. folder is reached by executors as a path of pyarrow's file systems; by default it lies in
    spark.checkpoint.dir. The monolithic files are deleted when the rewritten ones and the index are complete.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    index = settle(write_monolithic(pages, f"{folder}/whole"), "warc")
    n_files = max(1, index.select("file").distinct().count())
    decided = revisits(index, least).repartition(n_files, "file")  # a number of its own: few bytes would else be put into one task
    files = settle(normalise(decided, f"{folder}/whole", f"{folder}/members"), "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/whole")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return read_archives(files.repartition(n_files, "file"), f"{folder}/members")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}
# Base 32 takes 5 bits a letter: 5 hexadecimal digits give 4 letters.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)) & 31)::INT + 1, 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f"""
ORACLE = {"op2_warc": ORACLE_SQL}
