"""Sessions of several cameras: offsets of their sound by cross-correlation, one clock from all offsets, cameras from priors.

A signal is long rows (keys, name, i, v) and may be of any length. It is cut into blocks of BLOCK samples, which are set against
the other signal's blocks within the lags that are asked for; a pair of blocks gives the linear correlation at its 2 * BLOCK - 1
lags by their spectra, and sums by lag make the whole. So no task holds a signal, and work grows with the signal's length times the
lags. Samples that are missing or null count as 0; of repeated ones the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

BLOCK = 1024
#: Samples of blocks that a task makes dense at once.
DENSE = 1 << 20
#: Samples up to which a reference tells nothing, and the confidence then.
FEW, UNSURE = 10, 0.5
#: Lags whose correlation is this near to the best, as a share of the signals' norms, are equal; the smallest counts.
SAME = 1e-9
#: Seconds by which offsets may disagree with the session's clock.
TOLERANCE_S = 0.05


def blocks(signals: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """keys, name, p (the block's number), __k and __v: its samples' places in the block and values."""
    p = F.floor(F.col("i") / size)
    rows = signals.where("i >= 0 AND v IS NOT NULL").select(*keys, "name", p.alias("p"), (F.col("i") - p * size).cast("int").alias("k"), F.col("v").cast("double").alias("v"))
    samples = rows.groupBy(*keys, "name", "p").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("__s"))
    return samples.select(*keys, "name", "p", F.col("__s.k").alias("__k"), F.col("__s.v").alias("__v"))


def sizes(signals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, n (samples) and power (the sum of their squares)."""
    one = signals.where("i >= 0").groupBy(*keys, "name", "i").agg(F.max("v").alias("v"))
    return one.groupBy(*keys, "name").agg((F.max("i") + 1).alias("n"), F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("power"))


def block_correlations(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """sum a[n + lag] b[n] of two blocks (rows) for lags from 1 - size to size - 1, added up over the rows from each start to the next."""
    size = a.shape[1]
    c = np.fft.irfft(np.add.reduceat(np.fft.rfft(a, 2 * size) * np.conj(np.fft.rfft(b, 2 * size)), starts, axis=0), 2 * size, axis=1)
    return np.concatenate([c[:, size + 1 :], c[:, :size]], axis=1)


def correlations(signals: DataFrame, pairs: DataFrame, keys: list[str], most: int | None = None, size: int = BLOCK) -> DataFrame:
    """keys, a, b, lag and value, the sum of a[n + lag] b[n], for pairs (keys, a, b) of signals and lags up to ``most`` (None: all)."""
    cut = blocks(signals, keys, size)
    known = sizes(signals, keys)
    named = lambda df, c: df.withColumnRenamed("name", c)
    both = pairs.select(*keys, "a", "b").join(named(known, "a").select(*keys, "a", F.col("n").alias("na")), [*keys, "a"]).join(named(known, "b").select(*keys, "b", F.col("n").alias("nb")), [*keys, "b"])
    left = both.select(*keys, "a", "b").join(named(cut, "a"), [*keys, "a"]).select(*keys, "a", "b", "p", F.col("__k").alias("ka"), F.col("__v").alias("va"))
    reach = None if most is None else -(-most // size) + 1
    last = F.floor((F.col("na") - 1) / size)
    low = F.lit(0).cast("long") if reach is None else F.greatest(F.col("q") - reach, F.lit(0))
    high = last if reach is None else F.least(F.col("q") + reach, last)
    right = both.join(named(cut, "b"), [*keys, "b"]).select(*keys, "a", "b", F.col("p").alias("q"), F.col("__k").alias("kb"), F.col("__v").alias("vb"), "na")
    right = right.withColumn("p", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    met = left.join(right, [*keys, "a", "b", "p"]).select(*keys, "a", "b", (F.col("p") - F.col("q")).alias("d"), "ka", "va", "kb", "vb")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "a", "b", "d"]
        for part in parts:
            group = part.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            for k in range(0, len(order), max(1, DENSE // size)):
                rows = order[k : k + max(1, DENSE // size)]
                starts = np.flatnonzero(np.diff(group[rows], prepend=-1))
                cut = part.iloc[rows]
                value = block_correlations(dense(cut["ka"], cut["va"], size), dense(cut["kb"], cut["vb"], size), starts)
                yield cut[names].iloc[starts].assign(c=list(value))

    kinds = ", ".join(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in (*keys, "a", "b", "d"))
    sums = met.mapInPandas(run, f"{kinds}, c array<double>").select(*keys, "a", "b", "d", F.posexplode("c").alias("l", "c"))
    lag = F.col("d") * size + F.col("l") - (size - 1)
    found = sums.groupBy(*keys, "a", "b", lag.alias("lag")).agg(F.sum("c").alias("value")).join(both, [*keys, "a", "b"])
    inside = (F.col("lag") > -F.col("nb")) & (F.col("lag") < F.col("na"))
    return found.where(inside if most is None else inside & (F.abs("lag") <= most)).select(*keys, "a", "b", "lag", "value")


def dense(places: pd.Series, values: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(places), size))
    for row, k, v in zip(out, places, values, strict=True):
        row[k] = v
    return out


def offsets(signals: DataFrame, pairs: DataFrame, keys: list[str], rate: float, most: int | None = None, size: int = BLOCK) -> DataFrame:
    """keys, a, b, offset_s (what b's times need to be a's) and confidence: the correlation at its best lag over both norms.

    A reference of FEW samples or a signal that isn't there tells nothing: an offset of 0 with a confidence of UNSURE.
    """
    known = sizes(signals, keys)
    side = lambda c: known.select(*keys, F.col("name").alias(c), F.col("n").alias(f"n{c}"), F.col("power").alias(f"power{c}"))
    all_pairs = pairs.select(*keys, "a", "b").join(side("a"), [*keys, "a"], "left").join(side("b"), [*keys, "b"], "left")
    norm = F.sqrt("powera") * F.sqrt("powerb")
    found = correlations(signals, pairs, keys, most, size).join(all_pairs.select(*keys, "a", "b", norm.alias("norm")), [*keys, "a", "b"])
    peak = found.groupBy(*keys, "a", "b").agg(F.max("value").alias("peak"))
    best = found.join(peak, [*keys, "a", "b"]).where(F.col("value") >= F.col("peak") - SAME * F.col("norm")).groupBy(*keys, "a", "b").agg(F.min("lag").alias("lag"), F.max("peak").alias("peak"))
    told = F.coalesce((F.col("na") > FEW) & F.col("lag").isNotNull(), F.lit(False))
    share = F.least(F.greatest(F.col("peak") / (norm + 1e-6), F.lit(0.0)), F.lit(1.0))
    return all_pairs.join(best, [*keys, "a", "b"], "left").select(
        *keys, "a", "b", F.when(told, F.col("lag") / F.lit(float(rate))).otherwise(0.0).alias("offset_s"), F.when(told, share).otherwise(UNSURE).alias("confidence")
    )


def settle(a: list, b: list, offset: np.ndarray, weight: np.ndarray, tolerance: float) -> tuple[list[tuple], list[tuple]]:
    """Cameras (name, reference, offset) and links (a, b, offset, residual, broken) of a session's graph of offsets.

    Offsets are fitted by weighted least squares in each connected part, its first camera being at 0. While the worst link
    disagrees by more than the tolerance and its part holds together without it, it is taken out as broken.
    """
    names = sorted({*a, *b})
    at = {n: k for k, n in enumerate(names)}
    i, j = np.array([at[x] for x in a]), np.array([at[x] for x in b])
    sound = np.ones(len(a), dtype=bool)

    def parts() -> np.ndarray:
        label = np.arange(len(names))
        for _ in names:
            for x, y in zip(i[sound], j[sound], strict=True):
                label[[x, y]] = min(label[x], label[y])
        return label

    label = parts()
    while True:
        rows = np.zeros((int(sound.sum()) + len(names), len(names)))
        root = np.sqrt(weight[sound])
        k = np.arange(int(sound.sum()))
        rows[k, j[sound]] += root
        rows[k, i[sound]] -= root
        heads = label == np.arange(len(names))
        rows[len(k) + np.flatnonzero(heads), np.flatnonzero(heads)] = 1e6  # each part's first camera stays at 0
        x = np.linalg.lstsq(rows, np.concatenate([root * offset[sound], np.zeros(len(names))]), rcond=None)[0]
        residual = offset - (x[j] - x[i])
        out = False
        for worst in sorted(np.flatnonzero(sound & (np.abs(residual) > tolerance)), key=lambda e: (-abs(residual[e]), e)):
            sound[worst] = False
            if (parts() == label).all():
                out = True
                break
            sound[worst] = True
        if not out:
            cameras = [(n, names[label[k]], float(x[k] - x[label[k]])) for k, n in enumerate(names)]
            return cameras, [(p, q, float(o), float(r), bool(not s)) for p, q, o, r, s in zip(a, b, offset, residual, sound, strict=True)]


def clocks(links: DataFrame, keys: list[str], tolerance: float = TOLERANCE_S) -> tuple[DataFrame, DataFrame]:
    """Cameras (keys, camera, reference, offset_s) and links (keys, a, b, offset_s, residual_s, broken) of sessions whose links
    (keys, a, b, offset_s, weight) tell the offset of b to a. A session's links, a pair of cameras each, are one group; links
    without an offset or a weight above 0 are left out."""
    given = links.where("offset_s IS NOT NULL AND weight > 0 AND a != b")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["a", "b", "offset_s"])
        cameras, found = settle(group["a"].tolist(), group["b"].tolist(), group["offset_s"].to_numpy(), group["weight"].to_numpy(), tolerance)
        told = lambda rows, names: [dict(zip(names, r, strict=True)) for r in rows]
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), "cameras": told(cameras, ["camera", "reference", "offset_s"]), "links": told(found, ["a", "b", "offset_s", "residual_s", "broken"])}])

    kinds = ", ".join(f"`{k}` {links.schema[k].dataType.simpleString()}" for k in keys)
    name = links.schema["a"].dataType.simpleString()
    shape = f"cameras array<struct<camera:{name},reference:{name},offset_s:double>>, links array<struct<a:{name},b:{name},offset_s:double,residual_s:double,broken:boolean>>"
    settled = given.select(*keys, "a", "b", F.col("offset_s").cast("double").alias("offset_s"), F.col("weight").cast("double").alias("weight")).groupBy(*keys).applyInPandas(run, f"{kinds}, {shape}")
    return settled.select(*keys, F.inline("cameras")), settled.select(*keys, F.inline("links"))


# A camera that nothing is known of, and the point that cameras look at.
DEFAULT_PROBE = {"width": 1280, "height": 720}
DEFAULT_PRIOR = {"azimuth_deg": 0.0, "height_m": 1.5, "distance_m": 3.0, "fov_deg": 60.0}
TARGET = (0.0, 0.0, 0.9)


def camera_priors(cameras: DataFrame, priors: DataFrame, variants: DataFrame, keys: list[str], ties: list[str] | None = None) -> DataFrame:
    """Intrinsics and pose of each camera (keys, camera) from its prior (keys, camera and the names of DEFAULT_PRIOR), with the size
    of its first variant (keys, camera, place, width, height) that could be probed; both have defaults. Of several variants of one
    place the largest by the columns ``ties`` counts."""
    first = F.when(F.col("place").isNotNull(), F.struct((-F.col("place")).alias("place"), *(ties or [])))
    probed = variants.where("width > 0 AND height > 0").groupBy(*keys, "camera").agg(F.max_by(F.struct("width", "height"), first).alias("probe"))
    rows = cameras.select(*keys, "camera").join(priors.select(*keys, "camera", *DEFAULT_PRIOR), [*keys, "camera"], "left").join(probed, [*keys, "camera"], "left")
    rows = rows.select(*keys, "camera", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in DEFAULT_PRIOR.items()], *[F.coalesce(F.col(f"probe.{c}").cast("int"), F.lit(v)).alias(c) for c, v in DEFAULT_PROBE.items()])
    az = F.radians("azimuth_deg")
    eye = [F.col("distance_m") * F.sin(az), F.col("distance_m") * F.cos(az), F.col("height_m")]
    turned = G.look_at(eye, [F.lit(c) for c in TARGET])
    return rows.select(*keys, "camera", "width", "height", G.focal_length(F.col("fov_deg"), F.col("width")).alias("fx"), F.array(*turned).alias("r"), F.array(*eye).alias("t"))
