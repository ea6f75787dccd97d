"""Scalar functions on reads as columns."""

from __future__ import annotations

import os
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsift.functions import memory

#: Letters a to z and the bases that stand for them in the test encoding of text.
TEXT_LETTERS, TEXT_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that is computed once a row, however often later expressions and filters mention it.

    A generator of one row stands between: the optimiser neither merges projections nor pushes filters through it, which
    would write the value anew for every mention. The outer form infers no filter on the value.
    """
    return df.select(*(df[c] for c in df.columns if c != name), F.explode_outer(F.array(value)).alias(name))


def split(s: Column, delimiter: str) -> Column:
    """Pieces between the delimiters, empty ones too."""
    return F.split(s, re.escape(delimiter), -1)


def starts_with(s: Column, prefix: str) -> Column:
    return s.startswith(prefix)


def ends_with(s: Column, suffix: str) -> Column:
    return s.endswith(suffix)


def absolute(path: str) -> str:
    """An absolute local path; what names a file system is left as it is."""
    return path if re.match(r"\w+:", path) else os.path.abspath(path)


def extension(path: Column) -> Column:
    """The extension, that before a trailing .gz where there is one."""
    return F.regexp_extract(path, r"(\.[^./]+)(?:\.gz)?$", 1)


def read_id(header: Column) -> Column:
    """A header up to its first space."""
    return F.substring_index(header, " ", 1)


def normalise(seq: Column) -> Column:
    """Upper case, U as T, anything but A, C, G, T as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def length(*seqs: Column) -> Column:
    """Bases of a read, or of both mates."""
    total = F.lit(0)
    for s in seqs:
        total = total + F.coalesce(F.length(s), F.lit(0))
    return total.cast("long")


def qualities(qual: Column, offset: int = 33) -> Column:
    """Phred values of a quality string."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def mean_quality(*quals: Column) -> Column:
    """Mean Phred value, pooled over the mates; 0 where there are no qualities."""
    pooled = F.concat(*(F.coalesce(qualities(q), F.array().cast("array<int>")) for q in quals))
    mean = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v) / F.size(x)).otherwise(F.lit(0.0))
    return let(pooled, mean)


def gzip_ratio(texts: pa.Array) -> pa.Array:
    """Size of the gzip stream over size of the text; null for null, 0 for an empty text. Smaller is more repetitive."""

    def ratio(s: str | None) -> float | None:
        if not s:
            return None if s is None else 0.0
        raw = s.encode()
        packer = zlib.compressobj(-1, zlib.DEFLATED, 31)
        return len(packer.compress(raw) + packer.flush()) / len(raw)

    found = pa.array([ratio(s.as_py()) for s in texts], pa.float64())  # one text at a time
    memory.release()
    return found


def compression_ratio(seq: Column) -> Column:
    """gzip size over raw size. SQL has no such function; batches pass through Arrow."""
    return F.arrow_udf(gzip_ratio, "double")(seq)


def text_as_bases(text: Column) -> Column:
    """The test encoding of text as DNA: letters a to z only, each as one of four bases.

    Batches pass through Arrow: SQL's translate makes a string of every character, which took most of the time of all
    queries on text. The planner takes it for nondeterministic, so that filters on it don't compute it again.
    """
    return F.arrow_udf(_as_bases, "string").asNondeterministic()(F.lower(text))


def _as_bases(texts: pa.Array) -> pa.Array:
    table = bytes.maketrans(TEXT_LETTERS.encode(), TEXT_BASES.encode())
    others = bytes(set(range(256)) - set(TEXT_LETTERS.encode()))
    valid = texts.is_valid()
    parts = []
    for a, raws in memory.runs(texts, 1 << 20):
        parts.append(pa.array([r.translate(table, others).decode() if ok else None for r, ok in zip(raws, valid.slice(a, len(raws)).to_pylist())], pa.string()))
    out = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    del parts
    memory.release()
    return out


def category_index(categories: list[str], name: Column) -> Column:
    """Position of a category, null where it is none."""
    at = F.array_position(F.array(*map(F.lit, categories)), name) - 1
    return F.when(at >= 0, at).cast("int")


def category_name(categories: list[str], index: Column) -> Column:
    """Name of a category by position, empty where there is none."""
    return F.coalesce(F.get(F.array(*map(F.lit, categories)), index), F.lit(""))
