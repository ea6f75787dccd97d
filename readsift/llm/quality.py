"""Quality rules by tokeniser fertility, beside base rules on words, lines and symbols.

A public vocabulary with byte fallback encodes each distinct word; a document's characters per token, its share of
byte-fallback tokens and the entropy of its tokens must lie in the band of its script. All statistics cover the whole
text. Words are encoded one by one, as the vocabulary's pieces never cross white space, and remembered by the worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsift.llm.common import WORD, slices

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
#: Bands by script: least and most characters per token, most byte-fallback tokens per token, least entropy in bits.
BANDS = {
    "latin": (1.3, 9.0, 0.25, 3.0),
    "greek_cyrillic": (0.9, 9.0, 0.6, 3.0),
    "semitic": (0.5, 8.0, 1.0, 3.0),
    "indic": (0.25, 6.0, 1.0, 3.0),
    "cjk": (0.3, 4.0, 0.5, 3.0),
    "other": (0.2, 9.0, 1.0, 2.5),
}
#: Clean text of languages that the vocabulary lacks falls back to bytes as a whole (samples of Odia 0.95, Syriac 0.89,
#: Amharic 0.82), so a limit of their scripts cannot bite. This one holds in every script where more than ODD of the
#: characters beyond ASCII are unassigned, private-use or symbols: 0 in samples of clean text in 30 languages, 0.07 in random
#: code points of the Semitic blocks, 0.25 of the Indic ones, 1 in private-use characters and emoji.
ODD, ODD_BYTES = 0.05, 0.25
#: Code points at which letters of these scripts begin; what is in no range is "other".
RANGES = [(0x41, 0x250, "latin"), (0x370, 0x530, "greek_cyrillic"), (0x590, 0x780, "semitic"), (0x900, 0xE00, "indic"), (0x3040, 0xA000, "cjk"), (0xAC00, 0xD7B0, "cjk"), (0x1E00, 0x1F00, "latin")]
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 1 << 20


def vocabulary(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


class _Words(dict):
    """Numbers of words (as UTF-8), with the tokens of each: ``start``, ``count`` and ``of_bytes`` by number, ``flat``."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.fresh: list[bytes] = []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh.clear()
        self.start = self.count = self.of_bytes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def encode(self) -> None:
        """Encode the words that came up since the last call."""
        if not self.fresh:
            return
        ids = self.model.encode([w.decode() for w in self.fresh], num_threads=1)
        count = np.array([len(i) for i in ids], np.int64)
        flat = np.array([t for i in ids for t in i], np.int32)
        upto = np.concatenate([[0], np.cumsum(count)])
        bytes_ = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        self.start = np.concatenate([self.start, len(self.flat) + upto[:-1]])
        self.count = np.concatenate([self.count, count])
        self.of_bytes = np.concatenate([self.of_bytes, np.diff(bytes_[upto])])
        self.flat = np.concatenate([self.flat, flat])
        self.fresh.clear()


_known: dict[str, _Words] = {}


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    code = numbers[:n].copy()
    for i in range(1, window):  # exact: pairs are numbered anew before the next word joins
        code = np.unique(code * (1 << 31) + numbers[i : i + n], return_inverse=True)[1].reshape(-1).astype(np.int64)
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(len(numbers), bool)
    for i in range(window):
        covered[i : i + n] |= twice
    return int(covered.sum())


def script(text: str) -> str:
    """The script of most letters; "other" where there are none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = codes[_letters()[codes]]
    votes: dict[str, int] = {}
    edges = np.array(sorted({e for a, b, _ in RANGES for e in (a, b)}))
    bins = np.bincount(np.searchsorted(edges, codes, side="right"), minlength=len(edges) + 1)
    names = {int(np.searchsorted(edges, a, side="right")): name for a, _, name in RANGES}
    for place, n in enumerate(bins.tolist()):
        votes[names.get(place, "other")] = votes.get(names.get(place, "other"), 0) + n
    best = max(votes, key=lambda k: (votes[k], k))
    return best if votes[best] else "other"


_ODD = np.zeros(0, bool)
_LETTERS = np.zeros(0, bool)


def _letters() -> np.ndarray:
    """Which code points are letters or marks that belong to them."""
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.array([category(chr(i))[0] in "LM" for i in range(0x110000)])
    return _LETTERS


def odd_share(text: str) -> float:
    """The share of unassigned code points, private-use ones and symbols among the characters beyond ASCII."""
    global _ODD
    if not len(_ODD):
        _ODD = np.array([(c := category(chr(i)))[0] == "S" or c in ("Cn", "Co", "Cs") for i in range(0x110000)])
    if text.isascii():
        return 0.0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return float(_ODD[codes[codes > 127]].mean())


_has_word = re.compile(WORD).search

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "byte_share", "entropy", "script", "odd_share"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, byte_share double, entropy double, script string, odd_share double"


def _measure(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _known:
        _known[path] = _Words(path)
    known = _known[path]
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        if len(known) > REMEMBERED:
            known.forget()
        numbers = []
        for text in texts:
            words = (text or "").encode().split()
            numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        known.encode()
        rows = []
        for text, seq in zip(texts, numbers):
            text = text or ""
            lines = [x for x in text.split("\n") if _has_word(x)]
            count = known.count[seq]
            total = int(count.sum())
            entropy = share = 0.0
            if total:
                upto = np.cumsum(count) - count
                tokens = known.flat[np.repeat(known.start[seq] - upto, count) + np.arange(total)]
                p = np.unique(tokens, return_counts=True)[1] / total
                entropy, share = float(-(p * np.log2(p)).sum()), float(known.of_bytes[seq].sum() / total)
            chars = len(text) - sum(map(text.count, WHITE))
            rows.append((len(seq), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(seq), total, share, entropy, script(text), odd_share(text)))
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 6 + [pa.float64()] * 2 + [pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns) if n != "text"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[n for n in batch.schema.names if n != "text"] + NAMES)


def measure(docs: DataFrame, *, text="text", doc_id="doc_id", path: str | None = None, bands=BANDS) -> DataFrame:
    """Per row of ``docs``: doc_id, counts, tokeniser figures, base_failed, in_band and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. in_band: characters
    per token, byte share and entropy lie in the band of the script, and the byte share in the limit of texts of odd
    characters where it is one. A null text counts as empty and fails; repeated
    rows are answered one by one; other columns are ignored.
    """
    from pyspark.sql.types import StructType

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType().add("doc_id", given.schema["doc_id"].dataType)
    schema = StructType([*schema.fields, *StructType.fromDDL(SCHEMA).fields])
    found = given.mapInArrow(partial(_measure, path=vocabulary(path)), schema)
    ratio = F.when(F.col("n_tokens") > 0, F.col("word_chars") / F.col("n_tokens")).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    inside = F.lit(False)
    for name, (low, high, most_bytes, least_entropy) in bands.items():
        inside = inside | ((F.col("script") == name) & ratio.between(low, high) & (F.col("byte_share") <= most_bytes) & (F.col("entropy") >= least_entropy))
    inside = inside & ((F.col("odd_share") <= ODD) | (F.col("byte_share") <= ODD_BYTES))
    found = found.withColumn("chars_per_token", ratio).withColumn("base_failed", failed).withColumn("in_band", inside)
    return found.withColumn("kept", ~F.col("base_failed") & F.col("in_band")).drop("odd_share")
