"""Calls on a stream of reads: a stateless plan, so batch and stream give the same rows.

The index is broadcast (size-checked) and models are priors or were fitted before; nothing waits for a watermark.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from readsift.operators import calling, counts, models, probe
from readsift.operators.index import IndexModel
from readsift.plans import pipeline


def call_stream(reads: DataFrame, index: IndexModel, settings, fitted: list[models.Model] | None = None) -> DataFrame:
    """The streaming rows of ``reads`` (read_ord, id, seq, qual) with scores and calls, for ``writeStream``."""
    settings = replace(settings, probe="local", training="none")
    categories = index.categories()
    hit = probe.by_broadcast(pipeline.features(reads, index, settings.emission), index)
    scored = counts.category_scores(hit, index.category_bins())
    likely = models.probabilities(scored, fitted or [models.prior(settings.dist, settings.kde_prior) for _ in categories])
    least = settings.min_length if settings.min_length is not None else pipeline.MIN_LENGTH
    if settings.rule == "host":
        return calling.call_host(likely, categories, index.host_index(), settings, least)
    return calling.call_category(likely, categories, settings, least)
