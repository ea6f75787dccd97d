"""Moments, densities and filter sizes, as columns and, for parameters on the driver, as numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(x: Column) -> Column:
    """Mean of an array column; 0 where it is empty."""
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)).otherwise(0.0)


def variance(x: Column, mean_: Column) -> Column:
    """Sample variance of an array column; 0 for fewer than two values."""
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean_) * (v - mean_))
    return F.when(F.size(x) > 1, squares / (F.size(x) - 1)).otherwise(0.0)


def bits_of(n: Column, fpr: float, num_hash: int, most: int) -> Column:
    """Bits that a filter needs for ``n`` values, capped."""
    return F.least(F.ceil(-(n * num_hash) / math.log(1 - math.exp(math.log(fpr) / num_hash))), F.lit(most).cast("long"))


def capacity(bits: int, fpr: float, num_hash: int) -> int:
    """Values that a filter of ``bits`` holds at the false-positive rate."""
    return math.floor(-(bits // num_hash) * math.log(1 - math.exp(math.log(fpr) / num_hash)))


def gamma_fit(mean_: Column, mean_log: Column) -> tuple[Column, Column]:
    """Shape and scale of a gamma distribution, by the closed approximation from the mean and the mean logarithm; null
    where all values are equal."""
    s = F.ln(mean_) - mean_log
    shape = F.when(s > 0, F.try_divide(3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s), 12 * s))
    return shape, F.try_divide(mean_, shape)


def beta_fit(mean_: Column, variance_: Column) -> tuple[Column, Column]:
    """Alpha and beta by moments; null where the variance is too large or zero."""
    c = F.when((variance_ > 0) & (variance_ < mean_ * (1 - mean_)), mean_ * (1 - mean_) / variance_ - 1)
    return mean_ * c, (1 - mean_) * c


def beta_loc(mean_: Column, alpha: Column, beta: Column) -> Column:
    """How far the mean of a sample lies from that of a beta distribution."""
    return mean_ - alpha / (alpha + beta)


def bandwidth(x: Column) -> Column:
    """Silverman's rule over rows: 0.9 * min(IQR / 1.34, sd) * n ** -0.2."""
    spread = (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))) / 1.34
    return 0.9 * F.least(spread, F.stddev_samp(x)) * F.pow(F.count(x), F.lit(-0.2))


def error_density(x: Column) -> Column:
    return 300.0 * F.exp(-300.0 * x)


def gamma_density(x: Column, shape: float, loc: float, scale: float) -> Column:
    y = x - loc
    constant = math.lgamma(shape) + shape * math.log(scale)
    return F.when(y > 0, F.exp((shape - 1) * F.ln(y) - y / scale - constant)).otherwise(1 / scale if shape == 1 else 0.0)


def beta_density(x: Column, alpha: float, beta: float) -> Column:
    constant = math.lgamma(alpha + beta) - math.lgamma(alpha) - math.lgamma(beta)
    inside = F.exp(constant + (alpha - 1) * F.ln(x) + (beta - 1) * F.ln(1 - x))
    return F.when((x > 0) & (x < 1), inside).otherwise(F.when(((x == 0) & F.lit(alpha == 1)) | ((x == 1) & F.lit(beta == 1)), math.exp(constant)).otherwise(0.0))


def kde_density(x: np.ndarray, sample: np.ndarray, h: float) -> np.ndarray:
    """Gaussian kernel density at ``x``, in blocks of bounded size."""
    out = np.zeros(len(x))
    if not len(sample):
        return out
    step = max(1, (1 << 20) // len(sample))
    for a in range(0, len(x), step):
        u = (x[a : a + step, None] - sample[None, :]) / h
        out[a : a + step] = np.exp(-0.5 * u * u).sum(1) / (math.sqrt(2 * math.pi) * h * len(sample))
    return out


def beta_quantiles(mean_: float, sd: float, n: int) -> list[float]:
    """n values spread like the Beta distribution of these moments: its quantiles at (i + 1/2) / n."""
    c = mean_ * (1 - mean_) / sd**2 - 1
    a, b = mean_ * c, (1 - mean_) * c
    x = np.linspace(0, 1, 200_001)[1:-1]
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    cdf = np.cumsum(np.exp(log - log.max()))
    return np.interp((np.arange(n) + 0.5) / n, cdf / cdf[-1], x).tolist()


def _integral(density, at: np.ndarray, low: float, high: float, steps: int = 200_000) -> np.ndarray:
    """Integral of a density from ``low`` to each place, in steps, as a share of that to ``high``."""
    grid = np.linspace(low, high, steps + 1)
    height = density(grid)
    area = np.concatenate([[0.0], np.cumsum((height[1:] + height[:-1]) / 2)])
    return np.interp(at, grid, area / area[-1])


def gamma_cdf(x: np.ndarray, shape: float, loc: float, scale: float) -> np.ndarray:
    """Cumulative gamma distribution; the variable is raised to the shape where the density has a pole at 0."""
    y, most = np.maximum((np.asarray(x, np.float64) - loc) / scale, 0.0), shape + 20 * math.sqrt(shape) + 40
    y = np.minimum(y, most)
    if shape >= 1:
        return _integral(lambda t: np.exp((shape - 1) * np.log(np.maximum(t, 1e-300)) - t - math.lgamma(shape)) if shape > 1 else np.exp(-t), y, 0.0, most)
    return _integral(lambda u: np.exp(-(u ** (1 / shape))), y**shape, 0.0, most**shape)


def beta_cdf(x: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """Cumulative beta distribution, over the angle whose sine squared is x, so that no pole is left for parameters of a half
    and more."""
    angle = np.arcsin(np.sqrt(np.clip(np.asarray(x, np.float64), 0.0, 1.0)))
    power = lambda v, p: np.where(v > 0, np.maximum(v, 1e-300) ** p, 1.0 if p == 0 else 0.0)
    return _integral(lambda t: power(np.sin(t), 2 * alpha - 1) * power(np.cos(t), 2 * beta - 1), angle, 0.0, math.pi / 2)


def anderson_darling(sample: np.ndarray, cdf) -> float:
    """The statistic of a sample against a cumulative distribution."""
    x = np.clip(cdf(np.sort(sample)), 1e-12, 1 - 1e-12)
    n = len(x)
    i = np.arange(1, n + 1)
    return float(-n - np.mean((2 * i - 1) * (np.log(x) + np.log1p(-x[::-1]))))
