import gzip
import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tallywick.llm import warc

SCHEMA = "page_id long, url string, html string, key string, file string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "f", None) for i, u, h in rows], SCHEMA)


def brute(rows):
    largest = defaultdict(list)
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            largest[h].append(i)
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max(largest[h]) if h in largest and largest[h] else None
        revisit = top is not None and i != top
        yield (i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None)


def same(frame, rows):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


LONG = "<p>" + "same é text " * 100 + "</p>"
ROWS = [
    (1, "http://a.example.org/x", LONG),
    (2, "http://b.example.org/x#part", LONG),
    (9, "https://user@A.Example.org:8080/y?q=1", LONG),
    (3, "http://a.example.org/short", "short"),
    (4, "http://a.example.org/short", "short"),
    (5, None, None),
    (6, "", ""),
    (7, "no address at all\r\nWARC-Type: forged\twith tab", "x" * 999),
    (8, "http://ünïcode.example/ä b", "x" * 999 + "é"),
    (10, "http://ünïcode.example/ä b", "x" * 999 + "é"),
    (None, "http://none.example/", LONG),
    (None, "http://none.example/", "y" * 1000),
    (None, "http://none.example/", "y" * 1000),
    (11, "http://a.example.org/x", "\r\n\r\nHTTP/1.1 Content-Length: 3\r\n\r\n" * 40),
    (12, "http://big.example/", "z" * 3_000_000),
]


def test_round_trip(spark):
    same(warc.round_trip(pages(spark, ROWS).repartition(4)), ROWS)


def test_a_hot_payload_and_a_hot_host(spark):
    rows = [(i, f"http://hot.example/{i % 7}", LONG if i % 3 else f"page {i} " * 150) for i in range(3000)]
    same(warc.round_trip(pages(spark, rows).repartition(5)), rows)


def test_repeated_rows(spark):
    rows = [ROWS[0]] * 3 + [ROWS[2]] * 2 + [ROWS[3]] * 2
    same(warc.round_trip(pages(spark, rows)), rows)


def test_lookup_reads_payloads_by_address(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    rows = [(i, f"http://h{i % 9}.example.org/p{i % 40}", f"text {i % 50} " * 120) for i in range(400)]
    archive = warc.write_archive(pages(spark, rows).repartition(3))
    wanted = [warc.capture_key(rows[k][1]) for k in (0, 13, 399)] + ["org,example,none)/", None]
    found = warc.lookup(archive, spark.createDataFrame([(k,) for k in wanted * 2], "key string"))
    assert sorted(r.page_id for r in found.collect()) == sorted(i for i, u, _ in rows if warc.capture_key(u) in wanted)
    read = {r.page_id: r for r in warc.fetch(archive, found).collect()}
    for i, r in read.items():
        if r.kind == "response":
            assert bytes(r.payload).decode() == rows[i][2]
        else:
            origin = warc.fetch(archive, warc.lookup(archive, spark.createDataFrame([(warc.capture_key(r.refers_url),)], "key string")).where(F.col("record") == r.refers_record)).collect()
            assert [bytes(o.payload).decode() for o in origin] == [rows[i][2]] and r.payload is None


def test_index_files_are_sorted_blocks(spark):
    rows = [(i, f"http://h{i % 5}.example.org/{i}", None) for i in range(2500)]
    archive = warc.write_archive(pages(spark, rows))
    keys, pieces = [], 0
    for _, _, name in archive.index:
        part = warc.IndexFile(archive.folder, name)
        pieces += len(part.directory)
        for k in range(len(part.directory)):
            assert len(part.lines(k)) <= warc.BLOCK_LINES
            keys += [x[0] for x in part.lines(k)]
    assert keys == sorted(warc.capture_key(u) for _, u, _ in rows) and pieces < len(archive.index) + 3


def test_files_are_plain_warc(spark):
    archive = warc.write_archive(pages(spark, ROWS).coalesce(1))
    where, root = warc.file_system(archive.folder)
    names = {r.file for r in archive.captures.collect()}
    records = b""
    for name in names:
        with where.open_input_stream(f"{root}/{name}", compression=None) as f:
            records += gzip.decompress(f.read())
    assert records.count(b"WARC/1.1\r\nWARC-Type: warcinfo") == len(names)
    assert records.count(b"WARC/1.1\r\n") == len(ROWS) + len(names) and b"\nWARC-Type: forged" not in records


def test_keys():
    assert warc.capture_key("http://www.Example.org:80/a?b#c") == "org,example,www:80)/a?b"
    assert warc.capture_key("//u:p@x.y") == "y,x)" and warc.capture_key("plain") == "plain"


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []
