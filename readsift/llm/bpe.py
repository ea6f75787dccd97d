"""Byte-level BPE over whole texts through a shuffle of distinct words.

Texts are split into pre-tokens and every pre-token becomes its number in the dictionary of a block of documents, so
that a block is a sequence of positions plus a list of distinct words. The words of all blocks are dealt out by a hash,
each distinct word is encoded once where it arrives, its ids go back to the blocks that hold it, and each block puts
its documents together by position. What is shuffled is packed: one row per block and hash bucket, compressed. The
positions of a block stay in a file of the shared folder.
Decoding looks ids up in the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from readsift.llm.common import cut, file_system, new_folder, release, slices

#: Text of a block in bytes; a longer document is a block of its own.
BLOCK_BYTES = 6 << 20
#: Text of all blocks whose words go to one bucket, in bytes; there are so many buckets, or more.
BUCKET_BYTES = 256 << 20
#: Positions that are put together at once.
POSITIONS = 1 << 19
PACKED = "block string, bucket int, body binary"
#: Tokens that are decoded at once.
TOKENS = 1 << 19


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[str, str]:
    """Path of the rank file and pattern of the pre-tokens; the public 50k byte-level vocabulary where none is named."""
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


#: A pattern that takes a pre-token whole, so that it is encoded as the piece that it is.
WHOLE = r"(?s).+"


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes by id, where each begins and how long it is (-1: no such id)."""
    ranks = {rank: token for token, rank in _ranks(path).items()}
    tokens = [ranks.get(i) for i in range(max(ranks) + 1)]
    size = np.array([-1 if t is None else len(t) for t in tokens], np.int64)
    held = np.maximum(size, 0)
    return np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8), np.cumsum(held) - held, size


def _pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of whole numbers, each byte by byte position (which compresses better), and a tail."""
    import zstandard

    head = np.array([len(arrays), *(len(a) for a in arrays)], dtype="<u4").tobytes()
    planes = b"".join(np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + planes + tail)


def _unpack(body: bytes) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at, arrays = 4 * (n + 1), []
    for size in np.frombuffer(raw, "<u4", n, 4).tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        arrays.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        at += 4 * size
    return arrays, raw[at:]


_SPACE = regex.compile(r"\s")


class _Pieces(dict):
    """Numbers of the pre-tokens of a piece of text, found once per piece; the words get numbers as they come."""

    def __init__(self, words: dict[str, int], rx, lead: str):
        self.words, self.rx, self.lead = words, rx, lead

    def __missing__(self, piece: str) -> tuple[int, ...] | None:
        """None for a piece that is empty or begins with white space: the space before it may join that."""
        words, found = self.words, None
        if not self.lead or (piece and not _SPACE.match(piece)):
            found = tuple(words.setdefault(w, len(words)) for w in self.rx.findall(self.lead + piece))
        self[piece] = found
        return found


def _split(batches: Iterator[pa.RecordBatch], pattern: str, n_buckets: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: a file with ids and positions, a row for each bucket that has words, and one in bucket -1 that
    names the block where it has no words. A task that runs twice leaves files that no row names."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    rx = regex.compile(pattern)
    words: dict[str, int] = {}
    first, later = _Pieces(words, rx, ""), _Pieces(words, rx, " ")
    ids: list[pa.Array] = []
    counts: list[int] = []
    sequences: list[np.ndarray] = []
    held = 0

    def block() -> pa.RecordBatch:
        name = uuid.uuid4().hex
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", ids[0].type)])) as out:
            for x in ids:
                out.write_batch(pa.record_batch([x], names=["id"]))
        seq = np.concatenate(sequences) if sequences else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        seq, named = rank[seq], list(words)
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(_pack(np.array(counts, np.uint32), seq, tail=sink.getvalue().to_pybytes()))
        rows = [] if named else [(-1, b"")]
        buckets: dict[int, tuple[list[int], list[bytes]]] = {}
        for number, old in enumerate(order.tolist()):
            raw = named[old].encode()
            here = buckets.setdefault(zlib.crc32(raw) % n_buckets, ([], []))
            here[0].append(number)
            here[1].append(raw)
        for bucket, (numbers, raws) in buckets.items():
            steps = np.diff(np.array(numbers, np.int64), prepend=0)
            rows.append((bucket, _pack(steps, np.array([len(r) for r in raws]), tail=b"".join(raws))))
        return pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "bucket", "body"])

    for batch in slices(batches, "text"):
        ids.append(batch.column("id"))
        for text in batch.column("text").to_pylist():
            if not text:
                counts.append(0)
                continue
            pieces = text.split(" ")
            try:
                found = list(first[pieces[0]])
                found.extend(chain.from_iterable(map(later.__getitem__, pieces[1:])))
            except TypeError:  # not a text that can be cut before each space
                found = [words.setdefault(w, len(words)) for w in rx.findall(text)]
            counts.append(len(found))
            sequences.append(np.array(found, np.uint32))
            held += len(text.encode()) if not text.isascii() else len(text)
        if held >= BLOCK_BYTES:
            yield block()
            for x in (words, first, later, ids, counts, sequences):
                x.clear()
            held = 0
    if counts:
        yield block()
    for x in (words, first, later, ids, counts, sequences):
        x.clear()
    release()


def _encode_buckets(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of the words of hash buckets, for every block that holds some, row by row; each distinct word is encoded once.
    What a task remembers are the distinct words of its buckets."""
    encode = _encoding(path, WHOLE).encode_ordinary
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        for block, bucket, body in zip(*(batch.column(c) for c in ("block", "bucket", "body"))):
            if bucket.as_py() < 0:
                yield pa.record_batch([pa.array([block.as_py()]), pa.array([-1], pa.int32()), pa.array([b""], pa.binary())], names=["block", "bucket", "body"])
                continue
            (steps, lengths), raw = _unpack(body.as_py())
            found, at = [], 0
            for end in np.cumsum(lengths, dtype=np.int64).tolist():
                word = raw[at:end]
                ids = known.get(word)
                if ids is None:
                    known[word] = ids = encode(word.decode())
                found.append(ids)
                at = end
            flat = np.fromiter(chain.from_iterable(found), np.uint32)
            out = _pack(steps, np.fromiter(map(len, found), np.uint32, len(found)), flat)
            yield pa.record_batch([pa.array([block.as_py()]), pa.array([bucket.as_py()], pa.int32()), pa.array([out], pa.binary())], names=["block", "bucket", "body"])
    known.clear()
    release()


def _assemble(encoded: pa.Table, id_type: pa.DataType, folder: str) -> pa.Table:
    """The documents of one block: ids of its words by position."""
    system, path = file_system(folder)
    with system.open_input_stream(f"{path}/{encoded.column('block')[0].as_py()}", compression=None) as file:
        (counts, sequence), tail = _unpack(file.read())
    docs = pa.ipc.open_stream(tail).read_all().column("id")
    numbers, lengths, flats = [], [], []
    for bucket, body in zip(encoded.column("bucket").to_pylist(), encoded.column("body")):
        if bucket < 0:
            continue
        arrays, _ = _unpack(body.as_py())
        numbers.append(np.cumsum(arrays[0], dtype=np.int64))
        lengths.append(arrays[1].astype(np.int64))
        flats.append(arrays[2])
    schema = pa.schema([("doc_id", id_type), ("ids", pa.list_(pa.int32()))])
    at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    long = np.concatenate(lengths) if lengths else at
    start, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    start[at], size[at] = np.cumsum(long) - long, long
    flat = np.concatenate(flats).astype(np.int32) if flats else np.zeros(0, np.int32)
    ends = np.cumsum(counts, dtype=np.int64)
    parts, a = [], 0
    docs = docs.combine_chunks()
    while a < len(counts):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + POSITIONS, side="right")))
        seq = sequence[base : ends[b - 1]]
        each = size[seq]
        upto = np.concatenate([[0], np.cumsum(each)])
        take = np.repeat(start[seq] - upto[:-1], each) + np.arange(upto[-1])
        offsets = upto[np.concatenate([[0], ends[a:b] - base])]
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[take], pa.int32()))
        parts.append(pa.table([docs.slice(a, b - a), ids], schema=schema))
        a = b
    release()
    return pa.concat_tables(parts)


def encode(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id and ``ids`` (array of int), as the public library encodes without special tokens; with
    ``decoded``, what ``decode`` makes of the ids as well, in the pass that puts them together.

    A null or empty text has no ids; repeated rows are answered one by one; other columns are ignored. The blocks' words
    are cut off in the shared folder, because blocks are named and made up as rows arrive. The number of buckets grows
    with the bytes of the texts, so that what a task remembers of distinct words does not.
    """
    path, pattern = vocabulary(path, pattern)
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType
    size = given.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    folder = new_folder(spark, "positions")
    words = cut(given.mapInArrow(partial(_split, pattern=pattern, n_buckets=n_buckets, folder=folder), PACKED))
    encoded = words.repartition(n_buckets, "bucket").mapInArrow(partial(_encode_buckets, path=path), PACKED)
    schema = StructType().add("doc_id", kind).add("ids", ArrayType(IntegerType()))
    id_type = to_arrow_type(kind)

    def assemble(rows: pa.Table) -> pa.Table:
        found = _assemble(rows, id_type, folder)
        return pa.Table.from_batches(_decode(iter(found.to_batches()), path), found.schema.append(pa.field("decoded", pa.binary()))) if decoded else found

    return encoded.groupBy("block").applyInArrow(lambda rows: assemble(rows), schema.add("decoded", BinaryType()) if decoded else schema)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, ids and decoded; ``decode(encode(docs))`` with one pass less."""
    return encode(docs, decoded=True, **options)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    raw, start, size = _token_bytes(path)
    for batch in batches:
        column = batch.column("ids")
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + TOKENS, side="right")) - 1)
            part = batch.slice(a, b - a)
            tokens = part.column("ids").flatten().to_numpy(zero_copy_only=False)
            each = size[tokens]
            if len(each) and each.min() < 0:
                raise ValueError("an id is not in the vocabulary")
            upto = np.concatenate([[0], np.cumsum(each)])
            data = raw[np.repeat(start[tokens] - upto[:-1], each) + np.arange(upto[-1])]
            offsets = upto[ends[a : b + 1] - ends[a]].astype(np.int32)
            valid = part.column("ids").is_valid()
            out = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*part.columns, pc.if_else(valid, out, None)], names=[*part.schema.names, "decoded"])
            a = b
    release()


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """The rows with ``decoded`` (binary): the bytes of the tokens in ``ids``. Null ids give null, no ids give no bytes."""
    schema = StructType([*encoded.schema.fields]).add("decoded", BinaryType())
    return encoded.mapInArrow(partial(_decode, path=vocabulary(path)[0]), schema)


def digest(decoded: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256, and the ids if asked for."""
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    columns = ["doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]
    return decoded.select(*columns, *(["ids"] if ids else []))
