"""Language identification with string kernels.

A text is the set of its hashed n-grams of lengths 1 to N (a blended spectrum, by presence); the kernel of two texts is
the size of the intersection over the root of the product of the sizes. A bounded, hash-chosen sample of labelled rows
gives the landmarks of a Nystrom map and the rows of a one-versus-rest kernel ridge regression. Scoring a batch is the
product of its presence matrix with one matrix that folds landmarks, map and regression together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readsift.llm.common import fresh, slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    #: n-gram lengths 1..longest, hashed into 2**bits places.
    longest: int = 4
    bits: int = 16
    #: Labelled rows per language that are fitted, and those of them that serve as landmarks. These bound the sample.
    per_language: int = 400
    landmarks: int = 64
    ridge: float = 1e-2
    #: ``accepted`` rejects a text whose best output leads the next by less than this. With 2, 4 and 24 languages, 99 of 100
    #: random or invented texts stay below 0.27, the median below 0.1, and whole clean ones reach 0.2. A single
    #: language has no next; there the output itself must reach ``least_output``.
    least_margin: float = 0.18
    least_output: float = 0.36


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # places x languages, float32
    settings: Settings


_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)


def presence(text: str, s: Settings) -> np.ndarray:
    """Places of the n-grams of a text: a boolean array. Case is folded; runs of other than letters count as one space."""
    seen = np.zeros(1 << s.bits, bool)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = _is_letter(codes)
    if not letters.any():
        return seen
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    codes = np.where(letters, codes, 32)[keep]
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(codes), np.uint32)
        for n in range(1, min(s.longest, len(codes)) + 1):
            rolled = (rolled[: len(codes) - n + 1] if n > 1 else rolled) * np.uint32(0x01000193)
            rolled = rolled + codes[n - 1 :] * np.uint32(0x9E3779B1)
            mixed = (rolled ^ (rolled >> np.uint32(15))) * _MULTIPLIERS[n % len(_MULTIPLIERS)]
            seen[mixed >> np.uint32(32 - s.bits)] = True
    return seen


_LETTERS = np.zeros(0, bool)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS[codes]


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a @ b.T) / sizes


def sample(docs: DataFrame, s: Settings, *, text="text", lang="lang", doc_id="doc_id", held_out: int | None = 2) -> DataFrame:
    """At most ``per_language`` labelled rows per language, the first by a hash of id and text, as (lang, seen).

    ``seen`` is the packed presence array, so that what reaches the driver is bounded whatever the texts' lengths.
    Rows with crc32(doc_id) mod 4 equal to ``held_out`` take no part. A first pass counts the rows per language; a
    second keeps those whose hash falls below a bound that leaves about twice as many as needed, and ranks these.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    if held_out is not None:
        rows = rows.where(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 4 != held_out)
    rank = F.xxhash64("id", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # as many rows as the model has outputs
    most = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, (2.0 * s.per_language + 50) / n))) if counts else F.create_map().cast("map<string,double>")
    share = (F.xxhash64(rank, F.lit(1)).bitwiseAND((1 << 30) - 1) / float(1 << 30)).alias("share")
    near = rows.withColumn("share", share).where(F.col("share") <= most[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("share", "id", "text")
    few = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= s.per_language).select("lang", "n", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen = [np.packbits(presence(t, s)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(seen, pa.binary())], names=["lang", "n", "seen"])

    return few.mapInArrow(packed, "lang string, n int, seen binary")


def fit(docs: DataFrame, settings: Settings = Settings(), **columns) -> Model | None:
    """The model of the labelled rows, or None where no labelled row has a letter."""
    rows = sorted(sample(docs, settings, **columns).collect(), key=lambda r: (r["lang"], r["n"]))
    rows = [r for r in rows if any(r["seen"])]
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    place = {}
    marks = []
    for i, r in enumerate(rows):
        place[r["lang"]] = place.get(r["lang"], 0) + 1
        if place[r["lang"]] <= settings.landmarks:
            marks.append(i)
    unpacked = lambda some: np.array([np.unpackbits(np.frombuffer(r["seen"], np.uint8)) for r in some], np.float32)
    landmarks = unpacked([rows[i] for i in marks])
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    kernels = [_kernel(unpacked(rows[a : a + 128]), landmarks) for a in range(0, len(rows), 128)]
    z = np.concatenate(kernels).astype(np.float64) @ root
    y = np.array([[1.0 if r["lang"] == name else -1.0 for name in languages] for r in rows])
    size = np.array([place[r["lang"]] for r in rows], np.float64)[:, None]
    w = (z / size).T @ z  # each language weighs the same
    beta = np.linalg.solve(w + settings.ridge * np.eye(w.shape[0]) * np.trace(w) / w.shape[0], (z / size).T @ y)
    per_landmark = (root @ beta) / np.sqrt(landmarks.sum(1))[:, None]
    return Model(languages, landmarks.T @ per_landmark.astype(np.float32), settings)


def outputs(texts: list[str | None], model: Model | None, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts' spectra, and the regression outputs by language: one product for all texts."""
    seen = np.array([presence(t or "", settings if model is None else model.settings) for t in texts])
    sizes = np.count_nonzero(seen, axis=1)
    if model is None:
        return sizes, np.zeros((len(texts), 0), np.float32)
    return sizes, (seen.astype(np.float32) @ model.weights) / np.sqrt(np.maximum(sizes, 1))[:, None]


#: Texts that are scored by one product.
ROWS = 256


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    return (b.slice(a, ROWS) for b in slices(batches, text) for a in range(0, b.num_rows, ROWS))


def predict(docs: DataFrame, model: Model | None, *, text="text", doc_id="doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score in [0, 1]; ``und`` with score 0 where there is no letter or no model.

    Whole texts are scored. The score is the softmax share of the best language over the regression outputs; of languages
    with equal outputs the first by name is taken.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType().add("doc_id", given.schema["doc_id"].dataType).add("lang_pred", StringType()).add("score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _parts(batches, "text"):
            names: list[str] = [UNKNOWN] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            if model is not None:
                sizes, f = outputs(batch.column("text").to_pylist(), model, model.settings)
                e = np.exp(4.0 * (f - f.max(1, keepdims=True)))
                share = (e / e.sum(1, keepdims=True)).astype(np.float64)
                best = f.argmax(1)
                for i in np.flatnonzero(sizes):
                    names[i], scores[i] = model.languages[best[i]], round(min(1.0, share[i, best[i]]), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return given.mapInArrow(scored, schema)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def accepted(docs: DataFrame, model: Model | None, *, text="text", doc_id="doc_id", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose text has a language that leads by ``least_margin`` or more, with all their columns.

    Rows travel with their prediction, so repeated ids and rows keep their own verdict.
    """
    from pyspark.sql.types import BooleanType, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = fresh(docs, "accepted")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _parts(batches, text):
            sizes, f = outputs(batch.column(text).to_pylist(), model, settings)
            keep = sizes > 0
            if model is not None:
                f = np.sort(f, axis=1)
                keep &= f[:, -1] - f[:, -2] >= settings.least_margin if f.shape[1] > 1 else f[:, -1] >= settings.least_output
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keep)], names=[*batch.schema.names, mark])

    schema = StructType([*docs.schema.fields]).add(mark, BooleanType())
    return docs.mapInArrow(judged, schema).where(mark).drop(mark)
