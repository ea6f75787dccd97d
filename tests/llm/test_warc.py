import hashlib
import io
import struct

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from readsift.llm import queries, warc
from readsift.llm.common import new_folder

BIG, OTHER = "<p>ü</p>" * 200, "<b>x</b>" * 200
PAGES = [(1, "u1", BIG), (2, None, BIG), (9, "http://a/%0A\r\nb", BIG), (3, "u", OTHER), (4, "s", "small"), (5, "s", "small"), (6, "n", None), (7, "e", ""), (9, "again", BIG), (None, "no id", BIG), (10, "long", "y" * 3_000_000)]


def brute(pages):
    heads = {}
    for i, _, h in pages:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            heads[raw] = max(i, heads.get(raw, i))
    for i, _, h in pages:
        raw = (h or "").encode()
        head = heads.get(raw)
        refers = head if head is not None and head != i else None
        yield i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("size", F.lit(2)).repartition(3)
    found = warc.round_trip(pages).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == sorted(brute(PAGES), key=repr)
    html = {(i, u): h for i, u, h in PAGES}
    for r in found:
        assert r.record_type == "revisit" or bytes(r.payload).decode() == (html[r.page_id, r.url] or "")
        assert (r.page_id, r.url) in html


def test_table_and_no_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert sorted(map(tuple, queries.op7_warc(spark, sf).collect())) == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_each_record_is_a_frame_after_the_dictionary():
    records = [warc.record({"page_id": i, "url": f"u{i}", "payload": b"<html>%d</html>" % i * 20, "digest": hashlib.sha1(b"<html>%d</html>" % i * 20).hexdigest(), "size": 0, "refers_to": None}) for i in range(300)]
    out = io.BytesIO()
    writer = warc.Writer(out)
    for r in records:
        writer.add(r)
    writer.close()
    archive = out.getvalue()
    magic, size = struct.unpack_from("<II", archive)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(archive[8 + size :])
    assert first == records[0]
    assert b"".join(warc.frames(io.BytesIO(archive))) == b"".join(records)
    assert len(archive) < len(b"".join(records)) / 4 and writer.written == len(archive)


def test_records_across_reads(monkeypatch):
    records = [warc.record({"page_id": i, "url": "u", "payload": b"x\r\n\r\n" * i, "digest": hashlib.sha1(b"x\r\n\r\n" * i).hexdigest(), "size": 5 * i, "refers_to": None}) for i in range(60)]
    raw = b"".join(records)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    for step in (1, 7, 1000):
        rows = list(warc.parse(raw[a : a + step] for a in range(0, len(raw), step)))
        assert [(r["page_id"], r["payload"]) for r in rows] == [(i, b"x\r\n\r\n" * i) for i in range(60)]
    with pytest.raises(ValueError):
        list(warc.parse([raw[:-30]]))


def test_memory_of_a_task_does_not_grow_with_its_pages(tmp_path):
    """A task of 160 MB of pages holds no more than a sample and a batch."""
    import tracemalloc

    rng = np.random.default_rng(1)
    row = lambda i: {"page_id": [i], "url": ["u"], "payload": [rng.bytes(400_000)], "digest": ["0"], "size": [400_000], "refers_to": pa.array([None], pa.int64())}
    batches = (pa.RecordBatch.from_pydict(row(i)) for i in range(400))
    tracemalloc.start()
    names = [b.column("name")[0].as_py() for b in warc._write(batches, f"file://{tmp_path}")]
    assert len(names) == 4
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()


def test_several_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    pages = spark.createDataFrame([(i, "u", f"{i} " * 300) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    folder = new_folder(spark, "warc")
    batches = list(warc._write(iter(warc.decide(pages).toArrow().to_batches()), folder))
    assert len(batches) > 5
    names = spark.createDataFrame([(b.column("name")[0].as_py(),) for b in batches], "name string")
    assert warc.read(names, folder).count() == 30
