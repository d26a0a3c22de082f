"""Numerics against known signals and brute force."""

import itertools

import numpy as np
import pytest

from motionlake.operators import signals as S


def test_periods():
    t = np.arange(120) / 20
    assert S.dominant_period(np.sin(2 * np.pi * t / 0.5), 20) == pytest.approx(0.5, abs=0.02)
    assert S.autocorrelation_period(np.sin(2 * np.pi * t / 0.5), 0.05) == pytest.approx(0.5, abs=0.06)
    assert S.dominant_period(np.ones(50), 20) == 0 and S.dominant_period(np.arange(3), 20) == 0
    assert S.autocorrelation_period(np.ones(50), 0.05) is None


def test_phase_lag():
    x = np.sin(np.arange(40) / 40 * 2 * np.pi) + 0.1 * np.cos(np.arange(40))
    for k in (0, 7, 25):
        assert S.phase_lag(x, np.roll(x, k)) == pytest.approx(k / 40)


def test_similarities(spark):
    rng = np.random.default_rng(1)
    src = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    r = q * np.sign(np.linalg.det(q))
    exact, mirrored, noise = 1.7 * src @ r.T + [1, 2, 3], src * [1, 1, -1], rng.normal(size=(20, 3))
    rows = [(k, *map(float, a), *map(float, b)) for k, dst in enumerate([exact, src, mirrored, exact + noise]) for a, b in zip(src, dst, strict=True)]
    rows += [(4, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)] * 5 + [(5, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "k long, x double, y double, z double, u double, v double, w double")
    found = {f.k: f for f in S.similarities(frame, "k").collect()}
    assert found[0].scale == pytest.approx(1.7) and np.allclose(np.reshape(found[0].r, (3, 3)), r) and np.allclose(found[0].t, [1, 2, 3]) and found[0].rms == pytest.approx(0, abs=1e-6)
    assert found[1].scale == pytest.approx(1) and np.allclose(np.reshape(found[1].r, (3, 3)), np.eye(3))
    assert np.linalg.det(np.reshape(found[2].r, (3, 3))) == pytest.approx(1)
    assert found[4].scale is None and found[5].scale is None
    # No similarity nearby is better.
    rot, s, t = np.reshape(found[3].r, (3, 3)), found[3].scale, np.array(found[3].t)
    spread = lambda s, rot, t: np.sqrt(((s * src @ rot.T + t - exact - noise) ** 2).sum(axis=1).mean())
    assert spread(s, rot, t) == pytest.approx(found[3].rms)
    for _ in range(200):
        w = rng.normal(size=3) * 0.05
        turn = np.eye(3) + np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
        u, _, v = np.linalg.svd(turn @ rot)
        assert spread(s + rng.normal() * 0.05, u @ v, t + rng.normal(size=3) * 0.05) >= found[3].rms - 1e-9
    last = {f.k: f for f in S.alignments(frame, "k").collect()}
    error = np.linalg.norm(s * src @ rot.T + t - exact - noise, axis=1)
    assert last[3].p95 == pytest.approx(np.percentile(error, 95)) and last[4].p95 is None


@pytest.mark.parametrize("far", [0.0, 1e6, 1e7])
def test_similarities_far_from_the_origin(spark, far):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(200, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    noise = 0.01 * rng.normal(size=p.shape)
    q = 2.0 * p @ turn.T + noise
    rows = [(1, *map(float, a + far), *map(float, b - 3 * far)) for a, b in zip(p, q, strict=True)]
    got = S.similarities(spark.createDataFrame(rows, "k long, x double, y double, z double, u double, v double, w double"), "k").collect()[0]
    assert got.scale == pytest.approx(2.0, abs=2e-3) and got.rms == pytest.approx(np.sqrt((noise**2).sum(axis=1).mean()), rel=0.03)
    assert np.allclose(np.array(got.r).reshape(3, 3), turn, atol=2e-3)


def test_the_median_of_long_series(monkeypatch):
    x = np.random.default_rng(2).normal(size=(120, 2))
    whole = S.median_distance(x)
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 10)
    assert S.median_distance(x) == pytest.approx(whole, rel=1e-3)


def test_missing_samples_keep_their_place():
    t = np.arange(120) / 20
    x = np.sin(2 * np.pi * t / 0.5)
    x[30:60] = np.nan
    assert S.dominant_period(x, 20) == pytest.approx(0.5, abs=0.02)


def cost(x, cuts, penalty):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    g = np.exp(-d / np.median(d[~np.eye(len(x), dtype=bool)]))
    total, at = -penalty, 0
    for c in cuts:
        total += np.trace(g[at:c, at:c]) - g[at:c, at:c].sum() / (c - at) + penalty
        at = c
    return total


@pytest.mark.parametrize("seed", range(3))
def test_changepoints_are_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(5, 2)), 3 + rng.normal(size=(4, 2)), rng.normal(size=(4, 2))])
    found = S.kernel_changepoints(x, 2, 0.8)
    every = [[*c, 13] for k in range(5) for c in itertools.combinations(range(2, 12), k) if all(b - a >= 2 for a, b in itertools.pairwise([0, *c, 13]))]
    assert cost(x, found, 0.8) == pytest.approx(min(cost(x, c, 0.8) for c in every))


def test_steps_are_segments():
    speed = np.concatenate([np.full(40, 0.1), np.full(30, 5.0), np.full(30, 0.1)])[:, None]
    z = (speed - speed.mean()) / speed.std()
    assert S.kernel_changepoints(z, 5, float(np.log(100))) == [40, 70, 100]
    assert S.kernel_changepoints(np.zeros((50, 1)), 5, 1.0) == [50]


def test_kernels_are_made_for_many_ends_at_once(monkeypatch):
    """Few calls for all ends, and the same cuts from blocks of any size."""
    x = np.repeat(np.random.default_rng(3).normal(size=(12, 3)), 25, axis=0) + np.random.default_rng(4).normal(scale=0.1, size=(300, 3))
    calls, plain = [], np.exp
    monkeypatch.setattr(np, "exp", lambda v: calls.append(1) or plain(v))
    found = S.kernel_changepoints(x, 5, 8.0)
    assert found[-1] == 300 and len(calls) <= 3
    monkeypatch.setattr(S, "KERNEL_CELLS", 1000, raising=False)
    assert S.kernel_changepoints(x, 5, 8.0) == found
