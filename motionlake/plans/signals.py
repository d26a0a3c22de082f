"""Queries of spectra, lags, segments and alignments; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import kinematics as K
from ..operators import signals as S


def dominant_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.periods(K.centers(adapters.tracks(spark, sf_dir)), "track_id", "long", "frame", "cx", adapters.FPS).select("track_id", F.round("period", 6).alias("period"), F.round("autocorr_period", 6).alias("autocorr_period"))


def phase_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.phase_lags(K.centers(adapters.tracks(spark, sf_dir)), "track_id", "long", "frame", "cx", "cy").withColumn("lag", F.round("lag", 6))


def motion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.segments(K.centers(adapters.tracks(spark, sf_dir)), "track_id", "long", "frame", ["cx", "cy"])
    return found.select("track_id", F.array_join(F.transform("ends", lambda e: e.cast("string")), ",").alias("ends"))


#: Where the fitted points lie, far from the origin.
FAR = 1e6


def umeyama_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    own = lambda i: e[i].cast("double")
    rows = adapters.table(spark, sf_dir, "embeddings").select("label", *[(own(i) + FAR).alias(c) for i, c in enumerate("xyz")], *[(2 * own((i + 1) % 3) + own(i + 6) / 10).alias(c) for i, c in enumerate("uvw")])
    return S.similarities(rows, "label").select("label", "n", F.round("scale", 5).alias("scale"), F.round("rms", 5).alias("rms"))


def umeyama_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    rows = adapters.table(spark, sf_dir, "embeddings").select("label", "vec_id", *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], *[(2 * e[i] + e[i + 6] / 10).cast("double").alias(c) for i, c in enumerate("uvw")])
    found = S.alignments(rows, "label")
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("scale", "rms", "p95")])


def gait_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(F.abs("q.w") * 5)
    rows = adapters.quaternions(spark, sf_dir).select("vec_id", period.alias("period"), (F.abs("q.x") * 15).alias("speed"))
    return rows.select("vec_id", S.gait_class("period", "speed", F.col("vec_id") % 7 != 0).alias("gait"))


NAMES = [dominant_periods, phase_lags, motion_segments, umeyama_fit, umeyama_align, gait_classes]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def _fit_sql() -> str:
    """Scale and residual by the largest root of the quartic whose coefficients the covariances' squares, minors and determinant
    give, found from above by Newton's steps; the rotation isn't needed for either."""
    s = [[f"covar_pop({t}, {a})" for a in "xyz"] for t in "uvw"]
    cells = ", ".join(f"{c} AS s{i}{j}" for i, row in enumerate(s) for j, c in enumerate(row))
    m = lambda i, j: f"s{i % 3}{j % 3}"
    minor = lambda i, j: f"({m(i + 1, j + 1)} * {m(i + 2, j + 2)} - {m(i + 1, j + 2)} * {m(i + 2, j + 1)})"
    pairs = [(i, j) for i in range(3) for j in range(3)]
    squares, minors = " + ".join(f"pow({m(i, j)}, 2)" for i, j in pairs), " + ".join(f"pow({minor(i, j)}, 2)" for i, j in pairs)
    det = " + ".join(f"{m(0, j)} * {minor(0, j)}" for j in range(3))
    return f"""WITH r AS (SELECT label, e[1] + {FAR} AS x, e[2] + {FAR} AS y, e[3] + {FAR} AS z, 2 * e[2] + e[7] / 10 AS u, 2 * e[3] + e[8] / 10 AS v, 2 * e[1] + e[9] / 10 AS w FROM (SELECT label, [CAST(q AS DOUBLE) FOR q IN embedding] AS e FROM embeddings)),
        c AS (SELECT label, count(*) AS n, {cells}, var_pop(x) + var_pop(y) + var_pop(z) AS vs, var_pop(u) + var_pop(v) + var_pop(w) AS vd FROM r GROUP BY label),
        k AS (SELECT *, {squares} AS p, {minors} AS q, {det} AS d FROM c),
        l AS (SELECT *, list_reduce([sqrt(3 * p)] || [CAST(i AS DOUBLE) FOR i IN range(80)], lambda t, i: t - (pow(t, 4) - 2 * p * t * t - 8 * d * t + p * p - 4 * q) / greatest(4 * pow(t, 3) - 4 * p * t - 8 * d, 1e-30)) AS shared FROM k)
        SELECT label, n, round(shared / vs, 5) AS scale, round(sqrt(greatest(vd - shared * shared / vs, 0)), 5) AS rms FROM l"""


def oracle_sql() -> dict[str, str]:
    return {
        "umeyama_fit": _fit_sql(),
        "gait_classes": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE abs(CAST(embedding[1] AS DOUBLE)) * 5 END AS p, abs(CAST(embedding[2] AS DOUBLE)) * 15 AS v FROM embeddings)
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR p <= 0 THEN CASE WHEN v < 0.05 THEN 'stand' ELSE 'walk' END WHEN v < 0.05 THEN 'stand' WHEN p > 0.7 AND v < 0.9 THEN 'walk' WHEN v > 2.2 THEN 'gallop' ELSE 'trot' END AS gait FROM e"""
    }
