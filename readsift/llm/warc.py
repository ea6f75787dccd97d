"""WARC archives in which every record is a Zstandard frame, with a dictionary built from the archive's own records.

An archive begins with a skippable frame that holds the dictionary; each record is then compressed on its own, so any
record can be read with the dictionary alone. Archives are written and read record by record: what a task holds is the
sample of the dictionary, or one batch of records. Archives are files in a folder that driver and executors share,
written through pyarrow's file systems; a manifest, written by Spark, names the files that count, so that a task that
ran twice leaves no record twice.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsift.llm import sketch
from readsift.llm.common import cut, file_system, new_folder, release, slices

#: Magic number of the skippable frame with the dictionary; any of 0x184D2A50 to 0x184D2A5F is skippable.
SKIPPABLE = 0x184D2A5D
#: Records of an archive in bytes, after which the next begins.
ARCHIVE_BYTES = 48 << 20
#: A dictionary and the records it is built from, in bytes.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
#: Only records of this size or more are replaced by revisits.
REVISIT_BYTES = 1000
#: Tasks that read archives; with more archives than that, a task reads several, one after the other.
MOST_TASKS = 20_000
#: Bytes that are read at once, and payloads and rows of a batch that is sent on.
READ_BYTES, BATCH_BYTES, BATCH_ROWS = 1 << 20, 4 << 20, 1024
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def decide(pages: DataFrame, *, page_id="page_id", url="url", html="html") -> DataFrame:
    """Per page: page_id, url, payload (binary), digest, size, refers_to (null for a response).

    Of records with equal payloads of REVISIT_BYTES or more the one with the largest page_id is the response and the
    others revisit it; a null html is an empty payload; rows that share the largest page_id are all responses; where
    all ids of a group are null, all are responses. Groups are found by digest and size alone. A bitmap of the digests
    that occur more than once, of bounded size, tells which rows meet the groups in a join; the payloads of all others
    stay where they are read.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    all_ = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    all_ = all_.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long")).withColumn("key", F.xxhash64("digest"))
    same = all_.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
    heads = cut(same.agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("z"), "head"))
    repeated = sketch.build(heads.select(F.array(F.xxhash64("d")).alias("keys")), "keys", heads.count(), 2, 1)
    shared = pages.sparkSession.sparkContext.broadcast(repeated)

    def chosen(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = shared.value(batch.column("key").to_numpy().view(np.uint64)) & (batch.column("size").to_numpy() >= REVISIT_BYTES)
            if (hit == inside).any():
                yield batch.filter(pa.array(hit == inside))
        release()

    some = all_.mapInArrow(partial(chosen, inside=True), all_.schema)
    joined = some.join(heads, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("z")), "left")
    refers = F.when(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id")), F.col("head"))
    columns = ["page_id", "url", "payload", "digest", "size"]
    alone = all_.mapInArrow(partial(chosen, inside=False), all_.schema)
    return alone.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(joined.select(*columns, refers.alias("refers_to")))


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(row: dict) -> bytes:
    """One WARC record."""
    block = HTTP + row["payload"] if row["refers_to"] is None else HTTP
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(row['page_id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Payload-Length: {row['size']}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if row["refers_to"] is not None:
        head += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """An archive that takes records one by one: held until they suffice for the dictionary, then compressed and gone."""

    def __init__(self, out):
        self.out, self.held, self.size = out, [], 0
        self.one = None
        self.records = self.taken = self.written = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        self.taken += len(raw)
        if self.one is not None:
            self._put(raw)
            return
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def _put(self, raw: bytes) -> None:
        frame = self.one.compress(raw)
        self.out.write(frame)
        self.written += len(frame)

    def _begin(self) -> None:
        import zstandard as z

        sample = [r[:SAMPLE_BYTES] for r in self.held]
        try:
            dictionary = z.train_dictionary(min(DICTIONARY_BYTES, max(1024, self.size // 8)), sample, level=3)
        except z.ZstdError:  # too few or too small records to train on: use them as they are
            dictionary = z.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=z.DICT_TYPE_RAWCONTENT)
        raw = dictionary.as_bytes()
        self.one = z.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True)
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.written += 8 + len(raw)
        del sample
        for r in self.held:
            self._put(r)
        self.held = []

    def close(self) -> None:
        if self.one is None:
            self._begin()


def frames(file) -> Iterator[bytes]:
    """What an archive holds, decompressed, READ_BYTES at a time."""
    import zstandard as z

    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with its dictionary")
    raw = file.read(size)
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    dictionary = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_FULLDICT if trained else z.DICT_TYPE_RAWCONTENT)
    with z.ZstdDecompressor(dict_data=dictionary).stream_reader(file, read_size=READ_BYTES, read_across_frames=True, closefd=False) as reader:
        while part := reader.read(READ_BYTES):
            yield part


def parse(parts: Iterator[bytes]) -> Iterator[dict]:
    """Rows of the records in a stream of bytes: page_id, url, record_type, payload (null for a revisit), digest, size,
    refers_to. One record is held at a time."""
    parts = iter(parts)
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        if at > READ_BYTES:
            del held[:at]
            at = 0
        part = next(parts, b"")
        held += part
        return bool(part)

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not more():
                if len(held) > at:
                    raise ValueError("the archive ends within a record")
                return
        lines = held[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        ahead = end - at
        while len(held) - at < ahead + 8 + size:
            if not more():
                raise ValueError("the archive ends within a record")
        block = bytes(memoryview(held)[at + ahead + 4 : at + ahead + 4 + size])
        at += ahead + 8 + size
        digest, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
        if head["WARC-Type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
        url = head.get("WARC-Target-URI")
        yield {
            "page_id": number("X-Page-ID"),
            "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "record_type": head["WARC-Type"],
            "payload": payload,
            "payload_digest": digest,
            "payload_bytes": len(payload) if payload is not None else number("X-Payload-Length"),
            "refers_to": number("X-Refers-To-Page"),
        }


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    name, out, archive = "", None, None

    def closed() -> pa.RecordBatch:
        archive.close()
        out.close()
        return pa.record_batch([pa.array([name]), pa.array([archive.records], pa.int64()), pa.array([archive.written], pa.int64())], names=["name", "n_records", "bytes"])

    for batch in slices(batches, "payload"):
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to")]
        for i in range(batch.num_rows):
            if archive is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                out = system.open_output_stream(f"{path}/{name}", compression=None)
                archive = Writer(out)
            archive.add(record(dict(zip(("page_id", "url", "payload", "digest", "size", "refers_to"), (c[i].as_py() for c in columns)))))
            if archive.taken >= ARCHIVE_BYTES:
                yield closed()
                archive = None
    if archive is not None:
        yield closed()
    release()


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Write the pages of ``decide`` to archives in ``folder`` (a URI that all machines reach); the manifest of them."""
    return cut(decided.mapInArrow(partial(_write, folder=folder), "name string, n_records long, bytes long"))


FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())]
ROWS = "page_id long, url string, record_type string, payload binary, payload_digest string, payload_bytes long, refers_to long"


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    system, path = file_system(folder)
    schema = pa.schema(FIELDS)
    for batch in batches:
        for name in batch.column("name").to_pylist():
            with system.open_input_stream(f"{path}/{name}", compression=None, buffer_size=READ_BYTES) as file:
                rows: list[dict] = []
                size = 0
                for row in parse(frames(file)):
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
    release()


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest names; each payload is held against its digest, and left out
    (null) afterwards where ``payloads`` is false."""
    spread = manifest.select("name").repartition(max(1, min(manifest.count(), MOST_TASKS)))
    return spread.mapInArrow(partial(_read, folder=folder, payloads=payloads), ROWS)


def round_trip(pages: DataFrame, payloads: bool = True, **columns) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read(write(decide(pages, **columns), folder), folder, payloads)
