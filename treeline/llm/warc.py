"""WARC records in ZIP packages, read by ranges.

A package is a ZIP archive whose members are stored, not compressed: `archive/data.warc.gz` of one gzip member for each
record, `indexes/index.cdxj` with each record's place, and a `datapackage.json`. The reader parses the end record, the
ZIP64 end record and locator and the central directory, finds where the stored members begin, reads the index, and then
reads stretches of records by range; nothing is extracted. Any file system that Arrow knows serves.

Records with equal payloads of at least `least` bytes: the one with the smallest identifier is a response, the others are
revisits that refer to it. Null payloads count as empty. A row repeated with the same identifier is a record each time,
of the same kind. Rows without an identifier are no pages and are left out. An empty table gives no package and an empty
result. Columns besides these three are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._common import fresh_path, lookup, materialise, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def kinds(df: DataFrame, id_col: str, url_col: str, text_col: str, least: int) -> DataFrame:
    """id, url, payload (null for revisits), size, sha (hex), first: the identifier of the response to refer to, or null."""
    own = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("key", F.sha2("payload", 256))
    # which payloads are equal is told from digests alone; payloads are dealt by identifier, so that a frequent one is spread
    marks = materialise(own.where(F.col("size") >= least).select("id", "key"), "marks")
    again = materialise(marks.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    refers = materialise(lookup(marks, again, ["key"], "n").where("id <> first").select("id", "key", "first").distinct(), "refers")
    rows = own.join(refers, ["id", "key"], "left")
    return rows.select("id", "url", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "size", "sha", "first")


def record(row: dict) -> bytes:
    """One WARC record. A revisit has no payload; its digest and length are those of the payload it stands for."""
    revisit = row["first"] is not None
    body = b"" if revisit else row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{row['id']}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {row['url'].translate({10: '%0A', 13: '%0D'})}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(row['sha']))}", f"WARC-Payload-Length: {row['size']}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(http + body).digest())}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['first']}>"]
    head.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; its digests are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).digest()):
        raise ValueError("a damaged record")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and (fields["WARC-Payload-Digest"] != "sha1:" + base32(hashlib.sha1(payload).digest()) or int(fields["WARC-Payload-Length"]) != len(payload)):
        raise ValueError("a damaged payload")
    return fields, payload


class Package:
    """Writes one package straight to the file system."""

    def __init__(self, uri: str, zip64: bool = True):
        self.uri, self.lines, self.at, self.zip64 = uri, [], 0, zip64
        files, path = fs.FileSystem.from_uri(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64)

    def add(self, row: dict) -> None:
        packed = gzip.compress(record(row), 1, mtime=0)
        self.data.write(packed)
        self.lines.append(f"{row['url'].translate({10: '%0A', 13: '%0D', 32: '%20'}) or '-'} 19700101000000 " + json.dumps({"offset": self.at, "length": len(packed), "digest": base32(bytes.fromhex(row["sha"])), "id": row["id"]}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(x + "\n" for x in self.lines))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}], "records": len(self.lines)}))
        self.zip.close()
        self.out.close()


def write_packages(rows: DataFrame, folder: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Writes rows of kinds() to packages of about most_bytes. The result lists them, and only those that a finished task
    wrote: a task that was lost leaves a file that no list names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        part = TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.to_pylist():
                package = package or Package(f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.wacz")
                package.add(row)
                if package.at >= most_bytes:
                    package.close()
                    done.append(package)
                    package = None
        if package:
            package.close()
            done.append(package)
        yield pa.RecordBatch.from_arrays([pa.array([p.uri for p in done], pa.string()), pa.array([len(p.lines) for p in done], pa.int64())], names=["uri", "records"])

    return materialise(rows.mapInArrow(run, "uri string, records bigint"), "packages")


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP archive, as name: (method, offset of the data, length). read(offset, length) gives bytes."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("not a ZIP archive")
    _, _, _, n, length, start, _ = struct.unpack("<4H2IH", tail[at + 4 : at + 22])
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        record = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        n, length, start = struct.unpack("<3Q", record[32:56])
    central, at, out = read(start, length), 0, {}
    for _ in range(n):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a damaged central directory")
        method, packed, whole, names, extras, comments = struct.unpack("<H8x2I3H", central[at + 10 : at + 34])
        local = struct.unpack("<I", central[at + 42 : at + 46])[0]
        name = central[at + 46 : at + 46 + names].decode()
        extra, k = central[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, many = struct.unpack("<2H", extra[k : k + 4])
            if kind == 1:  # those of the sizes and the place that did not fit, in this order
                more = iter(struct.unpack(f"<{many // 8}Q", extra[k + 4 : k + 4 + many // 8 * 8]))
                whole = next(more) if whole == 0xFFFFFFFF else whole
                packed = next(more) if packed == 0xFFFFFFFF else packed
                local = next(more) if local == 0xFFFFFFFF else local
            k += 4 + many
        names_here, extras_here = struct.unpack("<2H", read(local + 26, 4))
        out[name] = (method, local + 30 + names_here + extras_here, packed)
        at += 46 + names + extras + comments
    return out


def _reader(uri: str):
    files, path = fs.FileSystem.from_uri(uri)
    f = files.open_input_file(path)
    return f, lambda offset, length: f.read_at(length, offset)


def locate(packages: DataFrame, stretch: int = 4 << 20) -> DataFrame:
    """uri, offset, lengths: stretches of neighbouring records, from the packages' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris, offsets, lengths = [], [], []
            for uri in batch.column(0).to_pylist():
                f, read = _reader(uri)
                with f:
                    members = directory(read, f.size())
                    if members[DATA][0] or members[INDEX][0]:
                        raise ValueError("members must be stored")
                    base = members[DATA][1]
                    places = [json.loads(x.split(b" ", 2)[2]) for x in read(*members[INDEX][1:]).splitlines()]
                size = stretch
                for p in places:
                    if size >= stretch:
                        uris.append(uri)
                        offsets.append(base + p["offset"])
                        lengths.append([])
                        size = 0
                    lengths[-1].append(p["length"])
                    size += p["length"]
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["uri", "offset", "lengths"])

    return packages.select("uri").mapInArrow(run, "uri string, offset bigint, lengths array<bigint>")


def read_records(places: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and on request the payload (null in revisits)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f, read = _reader(uri)
                with f:
                    data, at, rows = read(offset, sum(lengths)), 0, []
                for n in lengths:
                    fields, payload = parse(gzip.decompress(data[at : at + n]))
                    at += n
                    page = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
                    refers = page(fields["WARC-Refers-To"]) if fields["WARC-Type"] == "revisit" else None
                    rows.append((page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], refers, None if refers is not None else payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    spread = places.repartition(max(places.sparkSession.sparkContext.defaultParallelism, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "uri", "offset")
    return spread.select("uri", "offset", "lengths").mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads)


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes all rows to packages; gives the list of them."""
    return write_packages(kinds(df, id_col, url_col, text_col, least), folder or fresh_path(df.sparkSession, "warc"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = archive(table(spark, sf_dir, "pages"))
    return read_records(locate(packages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
