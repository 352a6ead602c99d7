"""Operators 9 and 10."""

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections import defaultdict

from inkframe.llm import queries, sharding, warc
from inkframe.llm.scratch import shared_dir

PAGES = [(5, "http://a/\r\n", "x"), (2, None, "x"), (9, "http://b", ""), (1, "http://c", None), (7, "u", "\r\n\r\n"), (8, "u", "WARC/1.1\r\n\r\n\r\n"), (3, "é", "\r\n\r\nx\r\n"), (None, "n", "x"), (None, "n", "lone"), (2, None, "x"), (11, "u", "é" * 100_000 + "\r\n\r\n\r\n\r\n")]


def archive(spark, rows, **options):
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(df.coalesce(1), path, **options)
    return path


def test_archives_round_trip(spark):
    path = archive(spark, PAGES)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == len(PAGES) == len({r.record_id for r in records})
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id) for r in records)
    by = {r.key: r for r in records if r.key}
    assert by["5"].record_type == "revisit" and by["5"].refers_to_key == "2" and by["5"].target == "http://a/%0D%0A"
    assert by["5"].refers_to is None  # the response is a repeated row
    assert by["9"].refers_to_key == "1" and by["9"].refers_to == by["1"].record_id and by["1"].payload == b""
    for i, _, html in PAGES:
        if i in (7, 8, 3, 11):
            assert bytes(by[str(i)].payload) == html.encode()
    assert sorted(r.record_type for r in records if not r.key) == ["response", "revisit"]
    out = warc.resolve_revisits(warc.read_archives(spark, path)).collect()
    assert len(out) == len(PAGES) and all(r.found for r in out)
    sizes = {r.key: r.payload_bytes for r in out if r.record_type == "revisit"}
    assert sizes["5"] == 1 and sizes["9"] == 0


def test_revisits_without_their_response_stay(spark):
    records = warc.read_archives(spark, archive(spark, PAGES[:4])).where("key <> '1' or key is null")
    lost = [r for r in warc.resolve_revisits(records).collect() if not r.found]
    assert [(r.key, r.refers_to_key, r.payload_bytes) for r in lost] == [("9", "1", None)]


def test_archives_hold_whole_records(spark):
    path = archive(spark, PAGES[:4]).removeprefix("file:")
    from pathlib import Path

    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(path).glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 4 and data.endswith(b"\r\n\r\n")


def test_min_bytes_and_empty(spark):
    kinds = {r.key: r.record_type for r in warc.read_archives(spark, archive(spark, PAGES[:4], min_bytes=1)).collect()}
    assert kinds["9"] == kinds["1"] == "response" and kinds["5"] == "revisit"
    assert warc.resolve_revisits(warc.read_archives(spark, archive(spark, []))).count() == 0


def test_warc_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(r.html or "", r.page_id)
    want = {(r.page_id, len((r.html or "").encode()), base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode(), "response" if first[r.html or ""] == r.page_id else "revisit", None if first[r.html or ""] == r.page_id else first[r.html or ""]) for r in rows}
    assert {tuple(r) for r in queries.op9_warc(spark, sf).collect()} == want


def check_shards(rows, out, shards):
    assert sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows) == sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out)
    slots, held = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    total, largest = sum(held.values()), max(r.size for r in out)
    slack = max(largest, total // shards // sharding.WHOLE)
    assert all(abs(held[s] - total / shards) <= slack + 1 for s in range(shards))
    groups, kept = defaultdict(set), defaultdict(int)
    for r in out:
        groups[r.text_crc32].add(r.shard)
        kept[r.text_crc32] += r.size
    assert all(len(g) == 1 for c, g in groups.items() if kept[c] <= slack)


def test_shards(spark, docs):
    rows = [(i, f"t{i % 97}" * (i % 50)) for i in range(900)] + [(i, "hot text") for i in range(900, 1500)] + [(None, "n"), (3, None), (3, None), (5, ""), (7, "long" * 5000)]
    check_shards(rows, sharding.shard(docs(rows), shards=7, rows_a_range=50).collect(), 7)


def test_equal_rows_and_long_texts(spark, docs):
    """A third of all rows has the same text and no id; ranges are few."""
    rows = [(None, "the same")] * 700 + [(i, f"t{i}") for i in range(1_300)] + [(5_000, "x" * 2_000_000)]
    check_shards(rows, sharding.shard(docs(rows).repartition(5), shards=6, rows_a_range=20).collect(), 6)


def test_shards_of_little(spark, docs):
    assert sharding.shard(docs([])).collect() == []
    assert [(r.slot, r.doc_id) for r in sharding.shard(docs([(1, "a")])).collect()] == [(0, 1)]


def test_sharding_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op10_sharding(spark, sf).collect()
    check_shards(rows, out, 40)
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
