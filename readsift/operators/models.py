"""Distributions of unique proportions per category: priors, fits from samples, and the probability of a call."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsift.functions import stats
from readsift.functions.columns import once

#: Prior parameters. Gamma: shape, loc, scale; beta: alpha, beta; KDE: mean, sd and size of the sample
#: that stands in for a fitted one, and the bandwidth.
GAMMA = {"pos": (25.0, 0.0, 0.02), "neg": (10.0, 0.0, 0.005)}
BETA = {"pos": (6.0, 4.0), "neg": (6.0, 40.0)}
KDE = {"pos": (0.4891, 0.1548, 500, 0.1), "neg": (0.02963, 0.01496, 500, 0.001)}


@dataclass
class Side:
    """One distribution: its parameters, or its sample and bandwidth."""

    dist: str
    params: tuple[float, ...] = ()
    sample: list[float] = field(default_factory=list)
    h: float = 0.0

    def density(self, x: Column) -> Column:
        if self.dist == "gamma":
            return stats.gamma_density(x, *self.params)
        if self.dist == "beta":
            return stats.beta_density(x, *self.params)
        sample, h = np.array(self.sample, np.float64), self.h
        at = F.arrow_udf(lambda v: pa.array(stats.kde_density(v.to_numpy(zero_copy_only=False), sample, h), pa.float64()), "double")
        return at.asNondeterministic()(x)  # keeps the planner from moving it into expressions that can't hold it


Model = dict[str, Side]


def prior(dist: str, kde: str | None = None) -> Model:
    """The model before any sample; ``kde`` is a file with samples for kernel densities (see ``read_prior``)."""
    if dist == "gamma":
        return {s: Side(dist, GAMMA[s]) for s in ("pos", "neg")}
    if dist == "beta":
        return {s: Side(dist, BETA[s]) for s in ("pos", "neg")}
    held = read_prior(kde) if kde else {s: stats.beta_quantiles(*KDE[s][:3]) for s in ("pos", "neg")}
    return {s: Side(dist, (), held[s], KDE[s][3]) for s in ("pos", "neg")}


#: Values of a prior sample at most.
MOST_PRIOR = 100_000


def read_prior(path: str) -> dict[str, list[float]]:
    """The samples of a prior kernel density from a text file: lines of pos or neg and a value, separated by white space."""
    held: dict[str, list[float]] = {"pos": [], "neg": []}
    with open(path) as lines:
        for line in lines:
            if fields := line.split():
                if len(fields) != 2 or fields[0] not in held:
                    raise ValueError(f"not a side and a value: {line.strip()}")
                held[fields[0]].append(float(fields[1]))
                if len(held[fields[0]]) > MOST_PRIOR:
                    raise ValueError(f"a prior sample has at most {MOST_PRIOR} values")
    if not all(held.values()):
        raise ValueError("a prior needs values of both sides")
    return held


def moments(sample: DataFrame, *more: Column) -> DataFrame:
    """n, mean and variance of each category and side, and the mean and mean logarithm of the values above 0; ``more`` of them."""
    above = F.when(F.col("value") > 0, F.col("value"))
    return sample.groupBy("category_idx", "side").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(above).alias("mean_above"), F.avg(F.ln(above)).alias("mean_log"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"), *more
    )


def sample_density(at: DataFrame, sample: DataFrame, h: float) -> DataFrame:
    """Rows (key, x) with the kernel density of the values of their key in ``sample`` (key, value): an equi-join on the key
    and partial sums, so the sample may be of any size; null values do not count."""
    near = at.join(sample.where("value is not null"), "key")
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("value")) / h, F.lit(2.0))) / (h * math.sqrt(2 * math.pi))
    return near.groupBy("key", "x").agg(F.avg(kernel).alias("density"))


def fit(sample: DataFrame, categories: int, dist: str, n: int, kde: str | None = None) -> list[Model]:
    """A model per category. A side with n samples is fitted, else its prior stays; the negative gamma side then takes
    its loc from what samples there are. What comes to the driver is one row per side, and for kernel densities n values."""
    models = [prior(dist, kde) for _ in range(categories)]
    shape, scale = stats.gamma_fit(F.col("mean_above"), F.col("mean_log"))
    alpha, beta = stats.beta_fit(F.col("mean"), F.col("variance"))
    more = [F.array_sort(F.collect_list("value")).alias("values")] if dist == "kde" else []  # the sample is computed once
    rows = {(r["category_idx"], r["side"]): r for r in moments(sample, *more).select("*", shape.alias("shape"), scale.alias("scale"), alpha.alias("alpha"), beta.alias("beta")).collect()}
    for i, model in enumerate(models):
        for side in ("pos", "neg"):
            row = rows.get((i, side))
            full = row is not None and row["n"] >= n
            if dist == "kde" and full:
                model[side] = Side(dist, (), row["values"], KDE[side][3])
            elif dist == "beta" and full and row["alpha"] is not None:
                model[side] = Side(dist, (row["alpha"], row["beta"]))
            elif dist == "gamma" and full and row["scale"]:
                model[side] = Side(dist, (row["shape"], 0.0, row["scale"]))
            elif dist == "gamma" and side == "neg" and not full:
                shape_, _, scale_ = model[side].params
                model[side] = Side(dist, (shape_, (row["mean"] if row else 0.0) - shape_ * scale_, scale_))
    return models


def probabilities(scored: DataFrame, models: list[Model]) -> DataFrame:
    """The rows with probabilities by category: the share of the positive density in the sum of error, positive and
    negative densities, where the positive one is 1 at a proportion of 1. 0 for reads without hashes."""
    each = range(len(models))
    x, pos, neg = ([F.col(f"__{name}{i}") for i in each] for name in ("x", "pos", "neg"))
    out = scored.withColumns({f"__x{i}": F.when(F.col("num_hashes") > 0, F.col("unique_props")[i]).otherwise(0.0) for i in each})
    # all densities stand in one projection, so that those in Python are one pass of one worker
    positive = {f"__pos{i}": F.when(x[i] == 1, 1.0).otherwise(models[i]["pos"].density(x[i])) for i in each}
    out = out.withColumns(positive | {f"__neg{i}": models[i]["neg"].density(x[i]) for i in each})
    share = lambda i: F.when(F.col("num_hashes") > 0, pos[i] / (stats.error_density(x[i]) + pos[i] + neg[i])).otherwise(0.0)
    return once(out.withColumns({f"__p{i}": share(i) for i in each}), "probabilities", F.array(*(f"__p{i}" for i in each))).drop(*(f"__{name}{i}" for name in ("x", "pos", "neg", "p") for i in each))


def parameters(models: list[Model]) -> list[tuple]:
    """Rows (category_idx, side, dist, p1, p2, loc, h, sample) of the models."""
    out = []
    for i, model in enumerate(models):
        for side, s in model.items():
            p = {"gamma": lambda p: (p[0], p[2], p[1]), "beta": lambda p: (p[0], p[1], None), "kde": lambda p: (None, None, None)}[s.dist](s.params)
            out.append((i, side, s.dist, *p, s.h or None, s.sample))
    return out


MODEL_ROWS = "category_idx int, side string, dist string, p1 double, p2 double, loc double, h double, sample array<double>"
