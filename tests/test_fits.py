import math

import numpy as np
import pytest

from tessera.operators import curves, fits


def hill(t, b, a, m, n):
    return b + (a - b) / (1 + (m / t) ** n)


def test_known_curves_are_recovered():
    rng = np.random.default_rng(4)
    t = np.arange(10.0, 81.0, 2.0)
    truth = np.stack([rng.uniform(0, 0.3, 300), rng.uniform(0.5, 1, 300), rng.uniform(20, 70, 300), rng.uniform(1.5, 15, 300)], axis=1)
    y = np.stack([hill(t, *p) for p in truth])
    theta, error, ok = fits.fitted(np.broadcast_to(t, y.shape).copy(), y, np.ones_like(y))
    assert ok.all() and error.max() < 1e-12
    near = np.abs(theta - truth).max(1) < 1e-3
    assert near.mean() > 0.99  # the ends of curves that hardly begin or end on the grid are loose


def test_noisy_curves_end_in_the_box_and_beat_a_fine_grid():
    rng = np.random.default_rng(5)
    t = np.arange(10.0, 81.0, 2.0)
    y = np.stack([hill(t, 0.1, 0.8, m, n) + rng.normal(0, 0.05, len(t)) for m in (12, 40, 78) for n in (0.5, 4, 19)] + [rng.uniform(0, 1, len(t)) for _ in range(6)])
    theta, error, ok = fits.fitted(np.broadcast_to(t, y.shape).copy(), y, np.ones_like(y))
    assert ok.all() and (theta[:, 2] >= 5).all() and (theta[:, 2] <= 95).all() and (theta[:, 3] >= 0.1).all() and (theta[:, 3] <= 20).all()
    assert (theta[:, 0] >= y.min(1) - 0.5 - 1e-12).all() and (theta[:, 1] >= y.min(1) - 1e-12).all() and (theta[:, :2].max(1) <= y.max(1) + 0.5 + 1e-12).all()
    for i in range(len(y)):
        best = np.inf
        for m in np.linspace(5, 95, 61):
            for n in np.geomspace(0.1, 20, 25):
                s = hill(t, 0, 1, m, n)
                x = np.stack([1 - s, s], axis=1)
                ends = np.linalg.lstsq(x, y[i], rcond=None)[0].clip([y[i].min() - 0.5, y[i].min()], y[i].max() + 0.5)
                best = min(best, ((x @ ends - y[i]) ** 2).sum())
        assert error[i] <= best * 1.02 + 1e-9, i


def test_statuses_repeats_and_ragged_curves(spark):
    t = [float(x) for x in range(10, 81, 2)]
    rows = [("a", x, hill(x, 0.1, 0.9, 43.5, 12.0)) for x in t]
    rows += [("b", x, y) for x in t[:20] for y in (hill(x, 0.2, 0.7, 30.0, 5.0) - 0.01, hill(x, 0.2, 0.7, 30.0, 5.0) + 0.01)]
    rows += [("flat", x, 0.25) for x in t] + [("nan", x, math.nan if x == 20 else 0.1 * x) for x in t] + [("null", x, None) for x in t[:3]] + [("two", 10.0, 0.1), ("two", 20.0, 0.4)]
    got = {r.id: r for r in fits.refined(spark.createDataFrame(rows, "id string, temp double, p double"), "id", "temp", "p").collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "ok", "flat": "flat", "nan": "non_finite", "null": "non_finite", "two": "ok"}
    a, b = got["a"], got["b"]
    assert abs(a.tm - 43.5) < 1e-3 and abs(a.n - 12) < 1e-3 and a.r2 > 1 - 1e-9 and a.converged and abs(a.amplitude - 0.8) < 1e-3
    assert abs(b.tm - 30) < 1e-3 and b.rmse == pytest.approx(0.01, abs=1e-4) and b.points == 40
    assert (got["flat"].bottom, got["flat"].rmse, got["flat"].tm) == (0.25, 0.0, None) and not got["flat"].converged and got["nan"].rmse is None
    assert fits.refined(spark.createDataFrame([], "id string, temp double, p double"), "id", "temp", "p").count() == 0


def test_width_walks_to_half_or_to_the_end(spark):
    def walk(temps, y):
        peak = max(range(len(y)), key=lambda i: (y[i], -i))
        left = right = peak
        while left > 0 and y[left] >= y[peak] / 2:
            left -= 1
        while right < len(y) - 1 and y[right] >= y[peak] / 2:
            right += 1
        return temps[right] - temps[left] or None

    rng = np.random.default_rng(1)
    t = [float(x) for x in range(20)]
    ys = {i: rng.uniform(0.2, 1, 20).tolist() for i in range(30)} | {100: [1.0] * 20, 101: list(range(20)), 102: [5.0, 1.0]}
    rows = [(i, x, float(v)) for i, y in ys.items() for x, v in zip(t, y, strict=False)]
    got = {r.id: r.width for r in fits.full_width(spark.createDataFrame(rows, "id long, t double, v double"), ["id"], "t", "v").collect()}
    assert got == {i: walk(t, [float(v) for v in y]) if len(y) > 2 else None for i, y in ys.items()}


def test_fit_of_a_grid_is_no_better(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(hill(x, 0.1, 0.7, 25 + i, 4) + rng.normal(0, 0.02))) for i in range(8) for x in range(10, 81, 5)]
    df = spark.createDataFrame(rows, "id long, t double, p double")
    grid = {r.id: r.sse for r in curves.hill_fit(df, "id", "t", "p", [20.0, 30.0, 40.0], [1.0, 4.0]).collect()}
    assert all(r.rmse**2 * r.points <= grid[r.id] + 1e-9 for r in fits.refined(df, "id", "t", "p").collect())
