"""Estimates from an ordered series: autocorrelation, blocking, bootstrap, exact count intervals, diffusion.

Plain numpy functions of one series, and :func:`by_series`, which runs one of them on every series of a table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

# ------------------------------------------------------------ distributions


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def _quantile(cdf, p: float, low: float, high: float) -> float:
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):  # no number lies between
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def chi2_quantile(p: float, k: float) -> float:
    return _quantile(lambda x: _gamma_p(k / 2, x / 2), p, 0.0, max(1.0, 2 * k))


@lru_cache(4096)
def t_quantile(p: float, k: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, k)
    return _quantile(lambda t: 1 - _beta_i(k / 2, 0.5, k / (k + t * t)) / 2, p, 0.0, 10.0)


def normal_quantile(p: float) -> float:
    if p < 0.5:
        return -normal_quantile(1 - p)
    return _quantile(lambda x: 1 - math.erfc(x / math.sqrt(2)) / 2, p, 0.0, 10.0)


# ---------------------------------------------------------------- estimators

#: The seeds that reproduce published intervals, and the draws made at once.
SERIES_SEED, BANDS_SEED, SERIES_DRAWS, BANDS_DRAWS = 20261020, 20260911, 512, 16
#: Where a spread counts as none: this, relative to one or the mean.
TINY = float(np.finfo(float).eps)



def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Biased autocorrelation at lags 0, 1, ...; a constant series has 1 at lag 0 and 0 beyond."""
    d = np.asarray(x, float) - np.mean(x)
    n = len(d)
    f = np.fft.rfft(d, 2 * n)
    acf = np.fft.irfft(f * np.conj(f))[:n] / n
    if acf[0] <= 1e-300 or np.ptp(x) == 0:
        return np.eye(1, n)[0]
    return acf / acf[0]


def statistical_inefficiency(x: np.ndarray) -> float:
    """1 + 2 sum of autocorrelations in pairs, until a pair is not positive; between 1 and n."""
    n = len(x)
    if n < 2 or np.ptp(x) == 0:
        return 1.0
    rho, total = autocorrelation(x), 0.0
    for k in range(1, n // 2, 2):
        pair = rho[k] + (rho[k + 1] if k + 1 < n else 0.0)
        if pair <= 0:
            break
        total += pair
    return float(min(max(1 + 2 * total, 1.0), n))


def autocorrelation_time(x: np.ndarray) -> float:
    """2 sum of autocorrelations less 1, up to the first lag of five times it; between 1 and n."""
    n = len(x)
    if n < 2 or np.ptp(x) == 0:
        return 1.0
    tau = 2 * np.cumsum(autocorrelation(x)) - 1
    past = np.flatnonzero(np.arange(n) >= 5 * tau)
    return float(min(max(tau[past[0]] if len(past) else tau[-1], 1.0), n))


def blocking_levels(x: np.ndarray) -> list[tuple[int, float, float]]:
    """Blocks, population variance and lag-one autocovariance (about the level's own mean) of each level of pairing."""
    x, out = np.asarray(x, float), []
    while len(x) >= 2:
        d = x - x.mean()
        out.append((len(x), float(x.var()), float(d[1:] @ d[:-1]) / len(x)))
        even = len(x) // 2 * 2
        x = (x[:even:2] + x[1:even:2]) / 2
    return out


def blocking_error(x: np.ndarray) -> tuple[float, int]:
    """Standard error of the mean by pairing, at the first level whose statistic is under the 99 % point; and the level.

    The statistic of level k is the sum over it and all higher ones of n (covariance / variance)^2, against k + 1 degrees of
    freedom. Where no level is accepted the last one stands.
    """
    levels = blocking_levels(x)
    if not levels or levels[0][1] <= TINY * max(1.0, abs(float(np.mean(x)))):
        return 0.0, 0
    each = [n * (gamma / var) ** 2 if var > 0 else 0.0 for n, var, gamma in levels]
    tail = np.cumsum(each[::-1])[::-1]
    at = next((k for k in range(len(levels)) if tail[k] < chi2_quantile(0.99, k + 1)), len(levels) - 1)
    return math.sqrt(levels[at][1] / levels[at][0]), at


def moving_block_bootstrap(x: np.ndarray, length: int, repeats: int = 2000, seed: int = SERIES_SEED, level: float = 0.95) -> tuple[float, float, float]:
    """Percentile interval of the mean from overlapping blocks, and the standard deviation of the replicates."""
    x = np.asarray(x, float)
    if not 1 <= length <= len(x):
        raise ValueError("a block has from one to all frames")
    sums = np.concatenate([[0], np.cumsum(x)])
    means = (sums[length:] - sums[:-length]) / length
    rng, blocks = np.random.default_rng(seed), -(-len(x) // length)
    draws = np.concatenate([means[rng.integers(0, len(means), (min(SERIES_DRAWS, repeats - a), blocks))].mean(1) for a in range(0, repeats, SERIES_DRAWS)])
    low, high = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high), float(draws.std(ddof=1))


def sampling_uncertainty(x: np.ndarray, regular: bool = True, least_frames: int = 20, least_blocks: int = 8) -> dict:
    """Status, mean, correlation time, effective frames, blocking error and bootstrap interval of a series.

    A missing frame, uneven times, too few frames and a constant series leave out all estimates but the mean; fewer than
    ``least_blocks`` blocks of five correlation times leave out the interval.
    """
    x = np.asarray(x, float)
    out = dict.fromkeys(("status", "mean", "tau", "effective", "blocking_error", "blocking_level", "interval_status", "low", "high", "error", "block"))
    out |= {"mean": float(np.nanmean(x)) if np.isfinite(x).any() else None}
    reasons = [("unavailable_missing_frames", not np.isfinite(x).all()), ("unavailable_irregular_timestamps", not regular), ("unavailable_too_few_frames", len(x) < least_frames), ("unavailable_observed_constant", bool(len(x)) and float(np.ptp(x)) == 0)]
    for reason, holds in reasons:
        if holds:
            return out | {"status": reason, "interval_status": reason}
    tau = autocorrelation_time(x)
    error, at = blocking_error(x)
    block = max(1, math.ceil(5 * tau))
    out |= {"status": "estimated", "tau": tau, "effective": len(x) / tau, "blocking_error": error, "blocking_level": at, "block": block}
    if block > len(x) or len(x) / block < least_blocks:
        return out | {"interval_status": "insufficient_blocks"}
    low, high, spread = moving_block_bootstrap(x, block)
    return out | {"interval_status": "estimated", "low": low, "high": high, "error": spread}


def poisson_interval(count: float, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a Poisson mean."""
    a = (1 - level) / 2
    return (0.0 if count == 0 else chi2_quantile(a, 2 * count) / 2), chi2_quantile(1 - a, 2 * count + 2) / 2


def dispersion_interval(events: np.ndarray, blocks: int = 10, level: float = 0.95) -> tuple[float, float, float]:
    """Poisson interval widened by the dispersion of block counts; surplus frames are dropped, blocks of one frame tell nothing."""
    x = np.asarray(events, float)
    size, phi = len(x) // blocks, 1.0
    if size >= 2 and x.sum() > 0:
        counts = x[: size * blocks].reshape(blocks, size).sum(1)
        phi = max(1.0, float(counts.var(ddof=1) / counts.mean())) if counts.mean() > 0 else 1.0
    low, high = poisson_interval(float(x.sum()) / phi, level)
    return phi, low * phi, high * phi


def collective_diffusion(n: np.ndarray, dt: float, segments: int = 5) -> dict:
    """Half the slope of the mean squared change over lags, and a Student interval around it from segments (low end at least 0).

    Lags run from one to a tenth of a segment (two at least), in the whole series as in segments. Series too short for twice the
    longest lag have no estimate, segments too short no interval.
    """
    n = np.asarray(n, float)
    size = len(n) // segments
    most = max(2, size // 10)
    if len(n) < 2 * most + 2:
        return {"status": "insufficient_frames", "d": None, "low": None, "high": None}
    lags = np.arange(1, most + 1)
    slope = lambda x: float(np.polyfit(lags * dt, [np.mean((x[k:] - x[:-k]) ** 2) for k in lags], 1)[0] / 2)
    d = slope(n)
    if segments < 2 or size < 2 * most + 2:
        return {"status": "estimated", "d": d, "low": None, "high": None}
    half = t_quantile(0.975, segments - 1) * np.std([slope(n[k * size : (k + 1) * size]) for k in range(segments)], ddof=1) / math.sqrt(segments)
    return {"status": "estimated", "d": d, "low": max(0.0, d - half), "high": d + half}


def block_mean_interval(x: np.ndarray, blocks: int = 8, level: float = 0.95) -> tuple[float, float]:
    """Student interval of the mean from contiguous blocks."""
    means = [p.mean() for p in np.array_split(np.asarray(x, float), blocks)]
    half = t_quantile((1 + level) / 2, blocks - 1) * np.std(means, ddof=1) / math.sqrt(blocks)
    return float(np.mean(means) - half), float(np.mean(means) + half)


def kmeans(rows: np.ndarray, k: int, most: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres on z-scores (population deviation); the first k rows are the first centres, ties go to the first."""
    z = (rows - rows.mean(0)) / np.where(rows.std(0) == 0, 1, rows.std(0))
    k = min(k, len(z))
    centres, labels = z[:k].copy(), np.zeros(len(z), int)
    for _ in range(most):
        new = np.argmin(((z[:, None, :] - centres) ** 2).sum(2), axis=1)
        if (new == labels).all():
            break
        labels = new
        for c in range(k):
            if (labels == c).any():
                centres[c] = z[labels == c].mean(0)
    return labels, centres


def by_series(rows: DataFrame, keys: list[str], order: str, value: str, schema: str, function) -> DataFrame:
    """``function`` of each series' values in order (null is NaN): a dict or tuple for the columns of ``schema``."""
    import pandas as pd

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, pdf):
        got = function(pdf.sort_values(order)[value].to_numpy(float))
        got = tuple(got[n] for n in names) if isinstance(got, dict) else got if isinstance(got, tuple) else (got,)
        return pd.DataFrame([(*key, *got)], columns=[*keys, *names])

    # dealt by number: by their bytes, many series would be put into one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, order, value).repartition(parts, *keys).groupBy(*keys).applyInPandas(run, f"{types}, {schema}")


def lag_correlation(rows: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """Biased autocorrelation at the first lags as SQL: a window for each lag, no series in one place."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(*keys)
    d = rows.withColumn("_d", F.col(value) - F.avg(value).over(w))
    ahead = [F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"c{k}") for k in range(1, lags + 1)]
    d = d.withColumns({f"_l{k}": F.lead("_d", k).over(w.orderBy(order)) for k in range(1, lags + 1)})
    out = d.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("c0"), *ahead)
    return out.select(*keys, *[(F.coalesce(F.col(f"c{k}"), F.lit(0.0)) / F.col("c0")).alias(f"rho{k}") for k in range(1, lags + 1)])


def _draws(seed: int, repeats: int, count: int) -> np.ndarray:
    """The places that are drawn of ``count``: the same for all series of as many batches."""
    if repeats * count > 1 << 20:
        return _drawn(seed, repeats, count)
    return _kept_draws(seed, repeats, count)


def _drawn(seed: int, repeats: int, count: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.integers(0, count, (min(BANDS_DRAWS, repeats - a), count)) for a in range(0, repeats, BANDS_DRAWS)])


_kept_draws = lru_cache(16)(_drawn)


def block_mean_bands(columns: np.ndarray, repeats: int = 2000, seed: int = BANDS_SEED, level: float = 0.95, length: int | None = None, least: int = 8, simultaneous: bool = True) -> dict:
    """Pointwise and simultaneous intervals of column means from batch means of a frames-by-columns matrix.

    The batch length covers five times the largest inefficiency; the intervals are studentised bootstrap ones, never narrower
    than Student's, simultaneous ones than Bonferroni's. Each column's standard error is widened by the inefficiency of its own
    batch means; a column with a missing frame, or with fewer than ``least`` effective batches, has no interval. Simultaneous
    intervals are left out on demand.
    """
    x = np.asarray(columns, float)
    n, width = x.shape
    none = np.full(width, np.nan)
    out = {"batches": 0, "mean": np.array([c[np.isfinite(c)].mean() if np.isfinite(c).any() else np.nan for c in x.T]), "low": none, "high": none, "wide_low": none, "wide_high": none}
    fine = np.isfinite(x).all(0)
    if length is None:
        length = max([math.ceil(n ** (1 / 3)), *[math.ceil(5 * statistical_inefficiency(x[:, c])) for c in np.flatnonzero(fine)]])
    out["batches"] = count = n // max(1, length)
    if n < 20 or count < least:
        return out | {"status": "insufficient_independent_blocks"}
    if not fine.any():
        return out | {"status": "no_complete_coverage"}
    y = x[:, fine]
    mean, means = y.mean(0), np.stack([p.mean(0) for p in np.array_split(y, count)])
    g = np.array([statistical_inefficiency(c) for c in means.T])
    free, enough = count / g, count / g >= least
    if not enough.any():
        return out | {"status": "insufficient_effective_batches"}
    tiny = TINY * np.maximum(1, np.abs(mean))
    se = means.std(0, ddof=1) / math.sqrt(count)
    moves = se > tiny
    t, flat = [], np.zeros(len(mean), int)
    draws = _draws(seed, repeats, count)
    step = max(1, (1 << 20) // (count * len(mean)))
    for a in range(0, repeats, step):
        draw = means[draws[a : a + step]]
        spread = draw.std(1, ddof=1) / math.sqrt(count)
        some = (spread > tiny) & moves
        flat += ((spread <= tiny) & moves).sum(0)
        t.append(np.where(some, (draw.mean(1) - means.mean(0)) / np.where(some, spread, 1), 0.0))
    t, tail = np.concatenate(t), (1 - level) / 2
    if (flat > tail * repeats).any():
        return out | {"status": "insufficient_batch_variation"}
    degrees = np.maximum(free - 1, 1)
    student = np.array([t_quantile(1 - tail, k) for k in degrees])
    lows, highs = np.quantile(t, [tail, 1 - tail], axis=0)
    se = se * np.sqrt(g)
    full = lambda v: _spread(fine, np.where(enough, v, np.nan))
    out |= {"status": "estimated", "low": full(mean - np.maximum(highs, student) * se), "high": full(mean - np.minimum(lows, -student) * se)}
    if not simultaneous:
        return out
    both = float(np.quantile(np.abs(t[:, moves]).max(1), level)) if moves.any() else 0.0
    family = max(1, int((moves & enough).sum()))
    both = max(both, *[t_quantile(1 - tail / family, k) for k in degrees[enough]])
    return out | {"wide_low": full(mean - both * se), "wide_high": full(mean + both * se)}


def series_interval(x: np.ndarray, regular: bool = True) -> dict:
    """Status and interval of a series' mean from batch means; none without values, for a constant one, with missing frames or uneven times."""
    x = np.asarray(x, float)
    seen = x[np.isfinite(x)]
    reasons = [("no_observations", not len(seen)), ("unavailable_observed_constant", len(seen) == len(x) and float(np.ptp(seen) if len(seen) else 0) == 0), ("unavailable_missing_frames", len(seen) < len(x)), ("unavailable_irregular_timestamps", not regular)]
    out = {"mean": float(seen.mean()) if len(seen) else None, "batches": None, "low": None, "high": None}
    for reason, holds in reasons:
        if holds:
            return out | {"status": reason}
    got = block_mean_bands(x[:, None], simultaneous=False)
    number = lambda v: float(v) if np.isfinite(v) else None
    return out | {"status": got["status"], "batches": int(got["batches"]), "low": number(got["low"][0]), "high": number(got["high"][0])}


def _spread(fine: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(len(fine), np.nan)
    out[fine] = values
    return out


def disjoint_block_bootstrap(x: np.ndarray, length: int, repeats: int = 2000, seed: int = SERIES_SEED, level: float = 0.95) -> dict:
    """Percentile interval of the mean from whole blocks that don't overlap."""
    x = np.asarray(x, float)
    count = len(x) // length
    if count < 2:
        return {"status": "insufficient_blocks", "low": None, "high": None}
    means = x[: count * length].reshape(count, length).mean(1)
    if np.ptp(means) == 0:
        return {"status": "no_variation_between_blocks", "low": None, "high": None}
    draws = means[np.random.default_rng(seed).integers(0, count, (repeats, count))].mean(1)
    low, high = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2])
    return {"status": "estimated", "low": float(low), "high": float(high)}


def net_current(up: np.ndarray, down: np.ndarray, charge: np.ndarray, duration: float, blocks: int = 10, level: float = 0.95) -> dict:
    """Current of counted events (frames by species), and its interval.

    The interval is normal with the variance of Poisson counts, or Student's with the variance of the blocks' net charge
    where that is larger and blocks have two frames at least. Without events it is the exact bound on their number times the
    largest charge.
    """
    up, down, charge = np.asarray(up, float), np.asarray(down, float), np.asarray(charge, float)
    series, events = ((up - down) * charge).sum(1), float((up + down).sum())
    total, variance = float(series.sum()), float(((up + down) * charge**2).sum())
    size = len(series) // blocks
    if not events:
        half, method = poisson_interval(0, level)[1] * float(np.abs(charge).max()), "bound"
    else:
        half, method = normal_quantile((1 + level) / 2) * math.sqrt(variance), "poisson"
        spread = blocks * float(series[: size * blocks].reshape(blocks, size).sum(1).var(ddof=1)) if size >= 2 else 0.0
        if variance > 0 and spread > variance * (1 + 1e-12):  # equal ones are not told apart by rounding
            half, method = t_quantile((1 + level) / 2, blocks - 1) * math.sqrt(spread), "blocks"
    return {"current": total / duration, "low": (total - half) / duration, "high": (total + half) / duration, "method": method}
