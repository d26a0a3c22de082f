"""Numerics of single series that relational operators can't express: spectra, correlations, alignments, segments.

A key's series (a clip of some hundred samples, which the length of a clip bounds) is gathered as arrays by an aggregate,
and Arrow batches of many keys go through one function. Alignments need no series: their moments are sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_HZ = 0.3
#: Peaks of an autocorrelation below this don't count.
MIN_CORR = 0.3
#: Samples up to which the distances of all pairs are held at once.
PAIRS_AT_ONCE = 2000
#: Cells of a kernel (ends by samples) that are made at once.
KERNEL_CELLS = 1 << 17


def dominant_period(signal: np.ndarray, fps: float) -> float:
    """Seconds of the strongest oscillation above MIN_HZ; 0 for fewer than six samples or a flat signal.

    Missing samples keep their place, at the mean of the others.
    """
    x = np.asarray(signal, dtype=float)
    seen = np.isfinite(x)
    if len(x) < 6 or not seen.any():
        return 0.0
    x = np.where(seen, x - x[seen].mean(), 0.0)
    power = np.abs(np.fft.rfft(x))
    hz = np.fft.rfftfreq(len(x), 1 / fps)
    power[hz <= MIN_HZ] = 0.0
    best = int(power.argmax())
    return float(1 / hz[best]) if power[best] > 1e-12 else 0.0


def autocorrelation_period(signal: np.ndarray, dt: float, least: float = MIN_CORR) -> float | None:
    """Seconds of the first peak of the autocorrelation at a lag of two or more; None if there is none."""
    x = np.asarray(signal, dtype=float)
    x = x - x.mean()
    power = float(x @ x)
    if len(x) < 6 or power < 1e-12:
        return None
    c = np.correlate(x, x, "full")[len(x) - 1 :] / power
    inner = np.flatnonzero((c[1:-1] > least) & (c[1:-1] >= c[:-2]) & (c[1:-1] >= c[2:])) + 1
    inner = inner[inner >= 2]
    return float(inner[0] * dt) if len(inner) else None


def phase_lag(reference: np.ndarray, signal: np.ndarray) -> float:
    """Circular shift, as a share of the length, at which the signal fits the reference best."""
    a, b = (np.asarray(v, dtype=float) - np.mean(v) for v in (reference, signal))
    corr = np.fft.irfft(np.fft.rfft(b) * np.conj(np.fft.rfft(a)), n=len(a))
    return float(corr.argmax() / len(a))


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of one series to all of another, added up channel by channel."""
    total = np.zeros((len(a), len(b)))
    for p, q in zip(a.T, b.T, strict=True):
        total += (q[None, :] - p[:, None]) ** 2
    return total


def median_distance(x: np.ndarray) -> float:
    """Median of the squared distances of all pairs of different rows; of long series found by ever finer counts."""
    n = len(x)
    if n <= PAIRS_AT_ONCE:
        return float(np.median(square_distances(x, x)[~np.tri(n, dtype=bool)]))

    def rows() -> Iterator[np.ndarray]:
        for i in range(n - 1):
            yield ((x[i + 1 :] - x[i]) ** 2).sum(axis=1)

    total = n * (n - 1) // 2
    low, high, below = 0.0, float(4 * ((x - x.mean(axis=0)) ** 2).sum(axis=1).max()) + 1e-12, 0
    for _ in range(6):
        counts = np.zeros(4096, dtype=np.int64)
        for d in rows():
            counts += np.histogram(d, 4096, (low, high))[0]
        place = int(np.searchsorted(below + np.cumsum(counts), (total + 1) // 2))
        below += int(counts[:place].sum())
        low, high = low + (high - low) * place / 4096, low + (high - low) * (place + 1) / 4096
        if high - low <= 1e-9 * high:
            break
    return (low + high) / 2


def kernel_changepoints(x: np.ndarray, min_size: int, penalty: float) -> list[int]:
    """Ends of the segments that minimise the within-segment spread in a Gaussian kernel's space plus the penalty of each cut.

    The kernel's sums over all segments that end at a sample follow from those that end at the one before; they are made for
    as many ends at once as KERNEL_CELLS allow, so memory grows with the samples, not with their square.
    """
    n = len(x)
    if n < 2 * min_size:
        return [n]
    width = max(median_distance(x), 1e-12)
    inside = np.zeros(n)  # of the segment from each start to the sample last seen
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    each = max(1, KERNEL_CELLS // n)
    for first in range(0, n, each):
        rows = np.arange(first, min(first + each, n))
        near = np.exp(-square_distances(x[rows], x[: rows[-1] + 1]) / width)
        seen = np.arange(rows[-1] + 1) <= rows[:, None]
        gain = np.where(seen, 2 * (near * seen)[:, ::-1].cumsum(axis=1)[:, ::-1] - 1.0, 0.0)  # the sample itself counts once
        gain[0] += inside[: rows[-1] + 1]
        sums = gain.cumsum(axis=0)
        inside[: rows[-1] + 1] = sums[-1]
        for row, end in zip(sums, rows + 1, strict=True):
            if end >= min_size:
                most = end - min_size + 1
                length = np.arange(end, min_size - 1, -1)
                total = best[:most] + length - row[:most] / length + penalty
                k = int(total.argmin())
                best[end], last[end] = total[k], k
    cuts, at = [], n
    while at > 0:
        cuts.append(at)
        at = int(last[at])
    return cuts[::-1]


def per_key(rows: DataFrame, key: str, kind: str, order: str, columns: list[str], work: Callable[..., dict], schema: str) -> DataFrame:
    """work(an array for each column, in order) -> dict of new columns, for each key."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [work(*[np.asarray(v, dtype=float) for v in row]) for row in zip(*(part[c] for c in columns), strict=True)]
            yield pd.DataFrame([{key: k, **f} for k, f in zip(part[key], found, strict=True)]) if found else pd.DataFrame()

    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[F.col(c).cast("double").alias(c) for c in columns]))).alias("s"))
    return one.select(key, *[F.col(f"s.{c}").alias(c) for c in columns]).mapInPandas(run, f"{key} {kind}, {schema}")


def periods(rows: DataFrame, key: str, kind: str, order: str, value: str, fps: float) -> DataFrame:
    work = lambda x: {"period": dominant_period(x, fps), "autocorr_period": autocorrelation_period(x, 1 / fps)}
    return per_key(rows, key, kind, order, [value], work, "period double, autocorr_period double")


def phase_lags(rows: DataFrame, key: str, kind: str, order: str, reference: str, value: str) -> DataFrame:
    return per_key(rows, key, kind, order, [reference, value], lambda a, b: {"lag": phase_lag(a, b)}, "lag double")


def segments(rows: DataFrame, key: str, kind: str, order: str, channels: list[str], min_size: int = 5) -> DataFrame:
    """Boundaries of segments of the channels (each as z-scores), with the penalty of sqrt(channels) ln(samples)."""

    def work(*series: np.ndarray) -> dict:
        x = np.column_stack(series)
        z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-12)
        return {"ends": kernel_changepoints(z, min_size, float(np.sqrt(len(channels)) * np.log(max(2, len(x)))))}

    return per_key(rows, key, kind, order, channels, work, "ends array<int>")


SOURCE, TARGET = ["x", "y", "z"], ["u", "v", "w"]


def best_rotation(products: np.ndarray) -> np.ndarray:
    """Rotations (n x 3 x 3) that maximise the sums of target . R source, from the sums of target_i source_j.

    The unit quaternion of each is the eigenvector of the largest eigenvalue of a symmetric matrix of those sums, so a
    mirror image never comes out.
    """
    h = np.swapaxes(products, 1, 2)  # source_i target_j
    trace = np.trace(h, axis1=1, axis2=2)
    form = np.empty((len(h), 4, 4))
    form[:, 0, 0] = trace
    turn = np.stack([h[:, 1, 2] - h[:, 2, 1], h[:, 2, 0] - h[:, 0, 2], h[:, 0, 1] - h[:, 1, 0]], axis=1)
    form[:, 0, 1:], form[:, 1:, 0] = turn, turn
    form[:, 1:, 1:] = h + np.swapaxes(h, 1, 2) - trace[:, None, None] * np.eye(3)
    w, x, y, z = np.linalg.eigh(form)[1][:, :, -1].T
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return np.moveaxis(np.array(rows), 2, 0)


def similarities(rows: DataFrame, key: str) -> DataFrame:
    """key, n, scale, r (nine elements, row by row), t (three) and rms of the similarity that takes (x, y, z) to
    (u, v, w) with the least squares. Null for fewer than three rows or if all sources are one point.

    Rows only meet as centred moments, with map-side combine: nothing of a key is gathered, and coordinates far from the origin
    lose no digits.
    """
    names = [*SOURCE, *TARGET]
    sums = [F.avg(c).alias(c) for c in names] + [F.covar_pop(a, b).alias(f"{a}{b}") for a in TARGET for b in SOURCE]
    sums += [sum((F.var_pop(c) for c in side[1:]), F.var_pop(side[0])).alias(name) for side, name in ((SOURCE, "vs"), (TARGET, "vd"))]
    given = rows.where(F.array_size(F.array_compact(F.array(*names))) == len(names))
    one = given.groupBy(key).agg(F.count("*").alias("n"), *sums)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = part["n"].to_numpy(dtype=float)
            ms, md = (part[side].to_numpy() for side in (SOURCE, TARGET))
            cov = part[[f"{a}{b}" for a in TARGET for b in SOURCE]].to_numpy().reshape(-1, 3, 3)
            vs, vd = part["vs"].to_numpy(), part["vd"].to_numpy()
            fit = (n >= 3) & (vs >= 1e-12)
            r = best_rotation(cov)
            shared = (r * cov).sum(axis=(1, 2))
            scale = np.where(fit, shared / np.where(fit, vs, 1.0), np.nan)
            t = md - scale[:, None] * (r @ ms[:, :, None])[:, :, 0]
            rms = np.sqrt(np.maximum(vd - scale * shared, 0.0))
            told = lambda a, ok: a.tolist() if ok else None
            yield pd.DataFrame({key: part[key], "n": part["n"], "scale": [told(s, ok) for s, ok in zip(scale, fit, strict=True)], "r": [told(m.reshape(-1), ok) for m, ok in zip(r, fit, strict=True)], "t": [told(v, ok) for v, ok in zip(t, fit, strict=True)], "rms": [told(e, ok) for e, ok in zip(rms, fit, strict=True)]})

    kind = rows.schema[key].dataType.simpleString()
    return one.mapInPandas(run, f"{key} {kind}, n long, scale double, r array<double>, t array<double>, rms double")


def alignments(rows: DataFrame, key: str) -> DataFrame:
    """Scale and residuals of the best similarity from (x, y, z) to (u, v, w); the percentile takes a second pass."""
    fits = similarities(rows, key)
    p = [F.col(c) for c in SOURCE]
    moved = [F.col("scale") * sum((F.col("r")[3 * i + j] * p[j] for j in (1, 2)), F.col("r")[3 * i] * p[0]) + F.col("t")[i] for i in range(3)]
    error = F.sqrt(sum(((m - F.col(c)) * (m - F.col(c)) for m, c in zip(moved[1:], TARGET[1:], strict=True)), (moved[0] - F.col("u")) * (moved[0] - F.col("u"))))
    p95 = rows.join(fits.where("scale IS NOT NULL").select(key, "scale", "r", "t"), key).groupBy(key).agg(F.percentile(error, F.lit(0.95)).alias("p95"))
    return fits.select(key, "scale", "rms").join(p95, key, "left")


# What tells the gaits apart, in seconds and body lengths a second.
STAND_SPEED, WALK_PERIOD, WALK_SPEED, GALLOP_SPEED = 0.05, 0.7, 0.9, 2.2


def gait_class(period: str, speed: str, has_paws: Column | None = None) -> Column:
    """stand, walk, trot or gallop, from the stride's period, the speed in body lengths a second, and whether paws are seen."""
    p, v = F.col(period), F.col(speed)
    stands = v < STAND_SPEED
    strides = F.coalesce((F.lit(True) if has_paws is None else has_paws) & (p > 0), F.lit(False))
    return F.when(stands, "stand").when(~strides | ((p > WALK_PERIOD) & (v < WALK_SPEED)), "walk").when(v > GALLOP_SPEED, "gallop").otherwise("trot")
