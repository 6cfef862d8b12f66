"""Operator 13: WARC archives with a two-level capture index.

*Archives.*  Each page becomes one gzip member of a WARC file in the shared
folder: a ``response`` with its payload, or a ``revisit`` of the page with the
largest id among those of equal payloads of ``REVISIT_BYTES`` or more.  A task
writes a file under a name of its own attempt; only the rows of tasks that
committed name files, so a lost or repeated task leaves an unnamed file at most.

*Index.*  A capture's key is its address with the host's labels reversed.  Keys
are sorted by range; each range is one index file of compressed blocks of
``BLOCK_LINES`` lines with a sparse directory (first and last key, place of each
block) at its end.  The list of index files, one for each range, is all that the
driver holds.

*Reading.*  A lookup deals the wanted keys out by range, finds the index file and
the block by binary search, and the lines in the block by binary search again;
records are then read by their byte ranges, neighbouring ones together.  A full
read takes all lines of the index.  A revisit's payload is found through the index
by the address of the page that it revisits.

A null html is an empty payload, a null url stands as ``urn:page:<id>``; characters
that no header line may hold are percent-encoded in addresses.  Pages without id
are archived too; they are revisits where a page with id has the same payload, else
responses.  Of repeated rows each is archived; all rows that have the largest id
are responses.  Payloads are written and read whole, one at a time.  Further
columns are ignored, clashing names included; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, shuffle_width, written

REVISIT_BYTES = 1000
BLOCK_LINES = 1000
LEVEL = 5
DATE = "2000-01-01T00:00:00Z"
#: Neighbouring ranges are read at once up to this many bytes.
READ_BYTES = 1 << 23
#: Keys that hold more than this share of all rows are dealt out over all tasks.
HOT_SHARE = 1000

_ADDRESS = re.compile(r"(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", re.I)
_PLAIN = "!#$%&'()*+,/:;=?@[]~"
_RECORD = uuid.UUID("8d5b0a5e-52f6-5d0c-9d5c-6f9b0a1c7e11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "key string, page_id long, kind string, digest string, n_bytes long, record string, file string, offset long, length long"
_CAPTURE = pa.schema(
    [("key", pa.string()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("record", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
RECORD = "page_id long, url string, kind string, record string, digest string, n_bytes long, refers_url string, refers_record string, payload binary"
_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("record", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("refers_url", pa.string()), ("refers_record", pa.string()), ("payload", pa.binary())]
)


@dataclass
class Archive:
    """Where an archive's files are: ``captures`` as a table, index files as
    (first key, last key, path) in order of keys."""

    spark: SparkSession
    folder: str
    captures: DataFrame
    index: list[tuple[str, str, str]]


def address(url: str | None, page_id: int | None) -> str:
    """The address as it stands in headers and lines."""
    return quote(url, safe=_PLAIN) if url else f"urn:page:{'' if page_id is None else page_id}"


def capture_key(url: str) -> str:
    """``http://www.Example.org:80/a?b#c`` -> ``org,example,www:80)/a?b``."""
    m = _ADDRESS.match(url)
    return ",".join(reversed(m[1].lower().split("."))) + (m[2] or "") + ")" + m[3] if m else url


def record_id(page_id: int | None, digest: str) -> str:
    return uuid.uuid5(_RECORD, f"{page_id}/{digest}").urn


def file_system(path: str):
    """(file system, path in it) of a folder or file that all tasks see."""
    from pyarrow import fs

    scheme = urlsplit(path).scheme
    return (fs.LocalFileSystem(), urlsplit(path).path if scheme else path) if scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _record(kind: str, url: str, page_id, record: str, digest: str, payload: bytes, n_bytes: int, refers) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [] if page_id is None else [f"WARC-Page-ID: {page_id}"]
    head += [] if refers is None else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers[1]}>", f"WARC-Refers-To-Target-URI: {refers[0]}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http)}", "", ""]
    return "\r\n".join(head).encode() + http + b"\r\n\r\n"


def parsed(member: bytes) -> dict:
    """A record of an archive: its headers and, for responses, its payload."""
    raw = zlib.decompress(member, 31)
    at = raw.index(b"\r\n\r\n")
    lines = raw[:at].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    body = raw[at + 4 : at + 4 + int(head["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(body) != int(head["Content-Length"]):
        raise ValueError("not a whole WARC record")
    found = {"kind": head["WARC-Type"], "record": head["WARC-Record-ID"][1:-1], "url": head.get("WARC-Target-URI"), "page_id": int(head["WARC-Page-ID"]) if "WARC-Page-ID" in head else None}
    if found["kind"] == "warcinfo":
        return found
    cut = body.index(b"\r\n\r\n") + 4
    length = int(re.search(rb"Content-Length: (\d+)", body[:cut])[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if found["kind"] == "revisit":
        return found | {"digest": digest, "n_bytes": length, "refers_url": head["WARC-Refers-To-Target-URI"], "refers_record": head["WARC-Refers-To"][1:-1], "payload": None}
    payload = body[cut:]
    if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {found['url']} differs from its digest")
    return found | {"digest": digest, "n_bytes": length, "refers_url": None, "refers_record": None, "payload": payload}


def spread_join(big: DataFrame, small: DataFrame, key: str, counts: DataFrame, n_rows: int) -> DataFrame:
    """Left join on ``key``, of which ``small`` has each value once.  Values that
    ``counts`` (``key``, n) gives to over one row in ``HOT_SHARE`` of ``big`` (so
    that many at most) are dealt out over all tasks, and ``small``'s row with
    them; so are rows without a key."""
    width = shuffle_width(big.sparkSession)
    hot = F.broadcast(counts.where(F.col("n") * HOT_SHARE > n_rows).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(width))).otherwise(0)
    salts = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(width - 1))).otherwise(F.array(F.lit(0))))
    left = big.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    right = small.join(hot, key, "left").withColumn("_salt", salts).drop("_hot")
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> Archive:
    """Writes the pages' records and their index; both are jobs of this call."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/tallywick/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    n_bytes = F.octet_length("payload")
    rows = rows.withColumn("same", F.when(n_bytes >= revisit_bytes, F.concat_ws("-", F.sha2("payload", 256), n_bytes)))
    first = F.max(F.struct("page_id", "url")).alias("first")
    groups = rows.where("same IS NOT NULL").groupBy("same").agg(first, F.count("*").alias("n")).where("n > 1 AND first.page_id IS NOT NULL")
    groups = written(groups.select("same", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "payload-groups")
    planned = spread_join(rows, groups.drop("n"), "same", groups, pages.count()).select("page_id", "url", "payload", "first_id", "first_url")

    def write(batches):
        from pyspark import TaskContext

        where, root = file_system(folder)
        where.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for batch in batches:
                found = []
                for r in batch.to_pylist():
                    if out is None:
                        out = where.open_output_stream(f"{root}/{name}", compression=None)
                        info = b"software: tallywick\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid5(_RECORD, name).urn}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        at += out.write(_member(head.encode() + info + b"\r\n\r\n"))
                    body, i, first = r["payload"], r["page_id"], r["first_id"]
                    digest, url = hashlib.sha1(body).hexdigest(), address(r["url"], i)
                    if first is None or first == i:
                        kind, record, refers = "response", record_id(i, digest), None
                    else:
                        kind, record, refers = "revisit", uuid.uuid5(_RECORD, f"{name}/{at}").urn, (address(r["first_url"], first), record_id(first, digest))
                    length = out.write(_member(_record(kind, url, i, record, digest, b"" if refers else body, len(body), refers)))
                    found.append((capture_key(url), i, kind, digest, len(body), record, name, at, length))
                    at += length
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _CAPTURE.types, strict=True)], schema=_CAPTURE)
        finally:
            if out is not None:
                out.close()

    captures = written(planned.mapInArrow(write, CAPTURE), "captures")
    return Archive(spark, folder, captures, _write_index(captures, folder))


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _write_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    def write(batches):
        from pyspark import TaskContext

        where, root = file_system(folder)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        out, at, directory, lines = None, 0, [], []

        def flush():
            nonlocal at
            block = zlib.compress("\n".join("\t".join(x) for x in lines).encode())
            directory.append((lines[0][0], lines[-1][0], at, len(block)))
            at += out.write(block)
            lines.clear()

        try:
            for batch in batches:
                for r in batch.to_pylist():
                    out = out or where.open_output_stream(f"{root}/{name}", compression=None)
                    lines.append(["" if x is None else str(x) for x in r.values()])
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
            if out:
                tail = zlib.compress(json.dumps(directory).encode())
                out.write(tail)
                out.write(at.to_bytes(8, "little"))
        finally:
            if out:
                out.close()
        if directory:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (directory[0][0], directory[-1][1], name)], ["first", "last", "file"])

    order = ["key", "page_id", "file", "offset"]
    ranges = captures.repartitionByRange(shuffle_width(captures.sparkSession), *order).sortWithinPartitions(*order)
    found = ranges.mapInArrow(write, "first string, last string, file string").collect()  # one row a range
    return sorted((r["first"], r["last"], r["file"]) for r in found)


class IndexFile:
    """One range of the index: its directory, blocks on demand."""

    def __init__(self, folder: str, name: str):
        where, root = file_system(folder)
        self.source = where.open_input_file(f"{root}/{name}")
        size = self.source.size()
        at = int.from_bytes(self.source.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.source.read_at(size - 8 - at, at)))
        self.first, self.last = [d[0] for d in self.directory], [d[1] for d in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def lines(self, k: int) -> list[list[str]]:
        if self.held[0] != k:
            _, _, at, n = self.directory[k]
            self.held = k, [x.split("\t") for x in zlib.decompress(self.source.read_at(n, at)).decode().split("\n")]
        return self.held[1]

    def find(self, key: str) -> Iterator[list[str]]:
        for k in range(bisect_left(self.last, key), bisect_right(self.first, key)):
            lines = self.lines(k)
            i = bisect_left(lines, key, key=lambda x: x[0])
            while i < len(lines) and lines[i][0] == key:
                yield lines[i]
                i += 1


def _captures(lines: list[list[str]]) -> pa.RecordBatch:
    columns = list(zip(*lines, strict=True)) if lines else [[]] * len(_CAPTURE)
    cast = [[(int(x) if x else None) if pa.types.is_integer(t) else x for x in c] for c, t in zip(columns, _CAPTURE.types, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cast, _CAPTURE.types, strict=True)], schema=_CAPTURE)


def lookup(archive: Archive, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """The captures of the given keys (see :func:`capture_key`), by binary search
    in the list of ranges, the range's directory and the block."""
    folder, index = archive.folder, archive.index

    def find(batches):
        lasts, firsts = [x[1] for x in index], [x[0] for x in index]
        opened: tuple[int, IndexFile | None] = (-1, None)
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                for k in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    if opened[0] != k:
                        opened = k, IndexFile(folder, index[k][2])
                    found += opened[1].find(key)
            yield _captures(found)

    wanted = keys.select(F.col(key_col).alias("key")).where("key IS NOT NULL").distinct()
    return wanted.repartitionByRange(shuffle_width(archive.spark), "key").sortWithinPartitions("key").mapInArrow(find, CAPTURE)


def all_captures(archive: Archive) -> DataFrame:
    """Every line of the index."""
    folder = archive.folder

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                part = IndexFile(folder, name)
                for k in range(len(part.directory)):
                    yield _captures(part.lines(k))

    files = archive.spark.createDataFrame([(x[2],) for x in archive.index], "file string")
    return files.repartition(max(1, len(archive.index))).mapInArrow(read, CAPTURE)


def fetch(archive: Archive, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of captures, read by their byte ranges (``payloads``: with the
    payloads of responses; their digests are checked in any case)."""
    folder = archive.folder

    def read(batches):
        where, root = file_system(folder)
        opened = (None, None)
        for batch in batches:
            file, offset, length = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            found, size, i = [], 0, 0
            while i < len(file):
                j, end = i + 1, offset[i] + length[i]
                while j < len(file) and file[j] == file[i] and offset[j] == end and end - offset[i] < READ_BYTES:
                    end += length[j]
                    j += 1
                if opened[0] != file[i]:
                    opened = file[i], where.open_input_file(f"{root}/{file[i]}")
                raw = opened[1].read_at(end - offset[i], offset[i])
                for k in range(i, j):
                    r = parsed(raw[offset[k] - offset[i] : offset[k] - offset[i] + length[k]])
                    found.append(r if payloads else r | {"payload": None})
                    size += len(found[-1]["payload"] or b"")
                i = j
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(found, _READ)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, _READ)

    order = ["file", "offset"]
    return captures.select("file", "offset", "length").repartitionByRange(shuffle_width(archive.spark), *order).sortWithinPartitions(*order).mapInArrow(read, RECORD)


def resolved(archive: Archive) -> DataFrame:
    """Every record with the payload's length and digest; those of a revisit are
    read from the record that it refers to, found through the index."""
    read = written(fetch(archive, all_captures(archive), payloads=False).drop("payload"), "records")
    key = F.udf(lambda url: capture_key(url), "string")
    visits = read.where("kind = 'revisit'").groupBy("refers_url", "refers_record").agg(F.count("*").alias("n"))
    targets = visits.select("refers_url", "refers_record")
    hits = lookup(archive, targets.select(key("refers_url").alias("key"))).where("kind = 'response'")
    # repeated rows may share an id, and then their record's name too
    hits = hits.join(targets.select(F.col("refers_record").alias("record")).distinct(), "record", "left_semi").groupBy("record").agg(F.min(F.struct("file", "offset", "length")).alias("at")).select("at.*")
    origin = fetch(archive, hits, payloads=False).select(F.col("record").alias("refers_record"), F.col("page_id").alias("refers_to"), F.col("digest").alias("full_digest"), F.col("n_bytes").alias("full_bytes"))
    both = spread_join(read, origin, "refers_record", visits.groupBy("refers_record").agg(F.sum("n").alias("n")), read.count())
    own = F.col("kind") == "response"
    return both.select(
        "page_id", "url", "kind", F.when(own, F.col("n_bytes")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.col("full_digest")).alias("payload_digest"), "refers_to",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages and reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    return resolved(write_archive(pages)).select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
