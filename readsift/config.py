"""Settings of the three commands, checked when they are made."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

#: Bits of a bin at most, as a filter addresses them with 32 bits and keeps two values back.
MOST_BITS = 2**32 - 1 - 2
MOST_BINS = 255
MOST_READS_TO_FIT = 65_535


class _Settings:
    def __str__(self) -> str:
        return "\n".join([type(self).__name__ + ":", *(f"  {k}: {v}" for k, v in asdict(self).items())])


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class IndexSettings(_Settings):
    kmer_size: int = 19
    window_size: int = 41
    num_hash: int = 3
    max_fpr: float = 0.01
    bits: int = MOST_BITS
    optimize: bool = False

    def __post_init__(self):
        _need(0 < self.kmer_size <= 27, "kmer_size must be 1 to 27")
        _need(self.kmer_size <= self.window_size <= 255, "window_size must be at least kmer_size and at most 255")
        _need(self.num_hash > 0 and 0 < self.max_fpr < 1 and self.bits > 0, "num_hash, max_fpr and bits must be positive, max_fpr below 1")


@dataclass(frozen=True)
class _Calling(_Settings):
    dists = ("gamma", "beta")

    def __post_init__(self):
        _need(self.dist in self.dists, f"dist must be one of {', '.join(self.dists)}")
        _need(0 < self.num_reads_to_fit <= MOST_READS_TO_FIT, f"num_reads_to_fit must be 1 to {MOST_READS_TO_FIT}")
        _need(0 <= self.confidence <= 255, "confidence must be 0 to 255")
        _need(self.training_window is None or self.training_window > 0, "training_window must be positive")
        _need(self.training in ("none", "first_n"), "training must be none or first_n")
        _need(self.emission in ("exact", "distinct"), "emission must be exact or distinct")
        _need(self.probe in ("join", "local", "bloom"), "probe must be join, local or bloom")


@dataclass(frozen=True)
class ClassifySettings(_Calling):
    dist: str = "beta"
    lo_hi_threshold: float = 0.15
    num_reads_to_fit: int = 5000
    min_quality: float = 10
    min_length: int | None = None  # 140, and 80 for pairs
    min_compression: float = 0.15
    confidence: int = 2
    min_proportion_diff: float = 0.0
    min_hits: int = 0
    training: str = "none"
    #: Reads that models may be fitted to: those with a read_ord below this; None for all.
    training_window: int | None = None
    #: File with the samples of prior kernel densities; None for quantiles of stated moments.
    kde_prior: str | None = None
    emission: str = "exact"
    probe: str = "join"
    rule: str = field(default="category", init=False)


@dataclass(frozen=True)
class DehostSettings(_Calling):
    dists = ("gamma", "beta", "kde")
    dist: str = "kde"
    lo_hi_threshold: float = 0.15
    num_reads_to_fit: int = 5000
    min_quality: float = 15
    min_length: int | None = None
    min_compression: float = 0.0
    confidence: int = 7
    min_proportion_diff: float = 0.04
    host_unique_prop_lo_threshold: float = 0.05
    min_probability_diff: float = 0.0
    conf_prob_threshold: float = 0.0
    min_hits: int = 0
    training: str = "none"
    training_window: int | None = None
    kde_prior: str | None = None
    emission: str = "exact"
    probe: str = "join"
    #: Rule for pairs; the binary rule is the intent, "category" the N-way one.
    paired_rule: str = "host"
    rule: str = field(default="host", init=False)
