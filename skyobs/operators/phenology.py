"""Phenological dates from greenness series, and how cloud degrades them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyobs.functions import special
from skyobs.operators.statistics import stats

# Bounds of base, amplitude, start, end, rise and fall in the fit, and the default curve.
LOWER = np.array([-1, 1e-3, 1, 1, 1e-3, 1e-3])
UPPER = np.array([2, 3, 365, 400, 2, 2])
CURVE = (0.15, 0.6, 120.0, 280.0, 0.12, 0.10)
GRID = np.arange(1, 366, dtype=float)


def curve(doy: np.ndarray, p=CURVE) -> np.ndarray:
    base, amp, sos, eos, up, down = p
    s = lambda z: 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return base + amp * (s(up * (doy - sos)) - s(down * (doy - eos)))


def _jacobian(doy: np.ndarray, p: np.ndarray) -> np.ndarray:
    base, amp, sos, eos, up, down = p
    a, b = (1 / (1 + np.exp(-np.clip(z, -700, 700))) for z in (up * (doy - sos), down * (doy - eos)))
    da, db = a * (1 - a), b * (1 - b)
    return np.column_stack([np.ones_like(doy), a - b, -amp * up * da, amp * down * db, amp * (doy - sos) * da, -amp * (doy - eos) * db])


@dataclass(frozen=True)
class Fit:
    sos: float | None = None
    eos: float | None = None
    peak_doy: int | None = None
    peak_value: float | None = None
    converged: bool = False

    @property
    def los(self) -> float | None:
        return None if self.sos is None or self.eos is None else self.eos - self.sos


def least_squares(doy: np.ndarray, value: np.ndarray, start: np.ndarray, steps: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, bool]:
    """Levenberg-Marquardt within the bounds: parameters on a bound that the gradient pushes out are held."""
    p = np.clip(start, LOWER, UPPER)
    r = value - curve(doy, p)
    cost, damp = float(r @ r), 1e-3
    for _ in range(steps):
        j = _jacobian(doy, p)
        g = j.T @ r
        free = ~(((p <= LOWER) & (g < 0)) | ((p >= UPPER) & (g > 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-12:
            return p, True
        h = j[:, free].T @ j[:, free]
        moved = False
        while damp < 1e12:
            step = np.zeros(6)
            step[free] = np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), g[free])
            q = np.clip(p + step, LOWER, UPPER)
            rq = value - curve(doy, q)
            new = float(rq @ rq)
            if new < cost:
                small = cost - new <= tol * (cost + 1e-300) or np.all(np.abs(q - p) <= tol * (np.abs(p) + tol))
                p, r, cost, damp, moved = q, rq, new, max(damp / 5, 1e-12), True
                if small:
                    return p, True
                break
            damp *= 4
        if not moved:
            return p, True  # no step lowers the cost any more
    return p, False


def smoothing_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, df: float) -> np.ndarray:
    """Natural cubic smoothing spline with an effective number of parameters, found by bisection on the penalty."""
    knots, back = np.unique(x, return_inverse=True)
    w = np.bincount(back).astype(float)
    mean = np.bincount(back, y) / w
    n, h = len(knots), np.diff(knots)
    q = np.zeros((n, n - 2))
    r = np.zeros((n - 2, n - 2))
    for k in range(n - 2):
        q[k : k + 3, k] = 1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]
        r[k, k] = (h[k] + h[k + 1]) / 3
        if k:
            r[k, k - 1] = r[k - 1, k] = h[k] / 6
    penalty = q @ np.linalg.solve(r, q.T)
    s = 1 / np.sqrt(w)
    values, vectors = np.linalg.eigh(s[:, None] * penalty * s)
    low, high = -20.0, 40.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(mid) * np.maximum(values, 0))).sum() > df else (low, mid)
    shrink = 1 / (1 + np.exp(low) * np.maximum(values, 0))
    g = s * (vectors @ (shrink * (vectors.T @ (mean / s))))
    gamma = np.concatenate(([0], np.linalg.solve(r, q.T @ g), [0]))
    i = np.clip(np.searchsorted(knots, at) - 1, 0, n - 2)
    a, b = at - knots[i], knots[i + 1] - at
    inner = (a * g[i + 1] + b * g[i]) / h[i] - a * b / 6 * ((1 + a / h[i]) * gamma[i + 1] + (1 + b / h[i]) * gamma[i])
    left = g[0] + (at - knots[0]) * ((g[1] - g[0]) / h[0] - h[0] / 6 * gamma[1])
    right = g[-1] + (at - knots[-1]) * ((g[-1] - g[-2]) / h[-1] + h[-1] / 6 * gamma[-2])
    return np.where(at < knots[0], left, np.where(at > knots[-1], right, inner))


def fit(doy: np.ndarray, value: np.ndarray, model: str = "dbl_logistic", threshold: float = 0.5, start: np.ndarray | None = None) -> Fit:
    """Start and end of season where the fitted curve crosses a share of its range around the peak."""
    ok = np.isfinite(doy) & np.isfinite(value)
    doy, value = np.asarray(doy, float)[ok], np.asarray(value, float)[ok]
    if len(doy) < 6:
        return Fit()
    if model == "spline":
        n = len(np.unique(doy))
        if n < 5:
            return Fit()
        pred = smoothing_spline(doy, value, GRID, min(8, n - 1))
    elif model == "dbl_logistic":
        low, high = np.quantile(value, [0.1, 0.9])
        p, done = least_squares(doy, value, np.array([low, high - low, 110, 290, 0.1, 0.1]) if start is None else start)
        if not done:
            return Fit()
        pred = curve(GRID, p)
    else:
        raise ValueError("model is dbl_logistic or spline")
    return _season(pred, threshold)


def _season(pred: np.ndarray, threshold: float) -> Fit:
    """Crossings of a fitted curve over GRID."""
    low, high = pred.min(), pred.max()
    if not np.isfinite(high - low) or high - low < 1e-6:
        return Fit()
    level, peak = low + threshold * (high - low), int(pred.argmax())
    before, after = np.flatnonzero(pred[: peak + 1] <= level), np.flatnonzero(pred[peak:] <= level)
    return Fit(float(before[-1] + 2) if len(before) else None, float(peak + 1 + after[0]) if len(after) else None, peak + 1, float(high), True)


def least_squares_many(doy: np.ndarray, value: np.ndarray, seen: np.ndarray, start: np.ndarray, steps: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """least_squares of many series at once: rows of doy and value, where seen; starts are rows, too. Returns parameters and which converged.

    Each series has its own damping and stops by itself; those that are done leave the arrays.
    """
    p, done = np.clip(start, LOWER, UPPER), np.zeros(len(start), bool)
    live = np.arange(len(start))

    def residual(q: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(seen[of], value[of] - _curves(doy[of], q), 0.0)

    r = residual(p, live)
    cost, damp, moves = np.einsum("it,it->i", r, r), np.full(len(start), 1e-3), np.zeros(len(start), int)
    h, g = np.zeros((len(start), 6, 6)), np.zeros((len(start), 6))
    stale = live
    while len(live):
        if len(stale):
            j = np.where(seen[stale][:, :, None], _jacobians(doy[stale], p[stale]), 0.0)
            g[stale], h[stale] = np.einsum("itk,it->ik", j, r[stale]), np.einsum("itk,itl->ikl", j, j)
            held = ((p[stale] <= LOWER) & (g[stale] < 0)) | ((p[stale] >= UPPER) & (g[stale] > 0))
            g[stale] = np.where(held, 0.0, g[stale])
            h[stale] = np.where(held[:, :, None] | held[:, None, :], 0.0, h[stale])
            done[stale[np.abs(g[stale]).max(axis=1) < 1e-12]] = True
            live = live[~done[live]]
        diagonal = np.einsum("ikk->ik", h[live])
        ridge = np.where(diagonal > 0, damp[live][:, None] * np.maximum(diagonal, 1e-12), 1.0)
        step = np.linalg.solve(h[live] + ridge[:, :, None] * np.eye(6), g[live][:, :, None])[:, :, 0]
        q = np.clip(p[live] + step, LOWER, UPPER)
        rq = residual(q, live)
        new = np.einsum("it,it->i", rq, rq)
        better = new < cost[live]
        small = better & ((cost[live] - new <= tol * (cost[live] + 1e-300)) | (np.abs(q - p[live]) <= tol * (np.abs(p[live]) + tol)).all(axis=1))
        moved, stuck = live[better], live[~better]
        p[moved], r[moved], cost[moved] = q[better], rq[better], new[better]
        damp[moved] = np.maximum(damp[moved] / 5, 1e-12)
        moves[moved] += 1
        damp[stuck] *= 4
        done[live[small]] = done[stuck[damp[stuck] >= 1e12]] = True  # the latter: no step lowers the cost any more
        live = live[~done[live] & (moves[live] < steps)]
        stale = moved[np.isin(moved, live)]
    return p, done


def _curves(doy: np.ndarray, p: np.ndarray) -> np.ndarray:
    return curve(doy, p.T[:, :, None])


def _jacobians(doy: np.ndarray, p: np.ndarray) -> np.ndarray:
    base, amp, sos, eos, up, down = p.T[:, :, None]
    a, b = (1 / (1 + np.exp(-np.clip(z, -700, 700))) for z in (up * (doy - sos), down * (doy - eos)))
    da, db = a * (1 - a), b * (1 - b)
    return np.stack([np.ones_like(doy), a - b, -amp * up * da, amp * down * db, amp * (doy - sos) * da, -amp * (doy - eos) * db], axis=2)


def fit_many(doy: np.ndarray, value: np.ndarray, seen: np.ndarray, model: str = "dbl_logistic", threshold: float = 0.5) -> list[Fit]:
    """fit of each row of doy and value, where seen; curves are fitted together, splines one by one."""
    if model != "dbl_logistic":
        return [fit(d[k], v[k], model, threshold) for d, v, k in zip(doy, value, seen, strict=True)]
    out = [Fit()] * len(doy)
    seen = seen & np.isfinite(doy) & np.isfinite(value)
    able = np.flatnonzero(seen.sum(axis=1) >= 6)
    if not len(able):
        return out
    low, high = np.array([np.quantile(value[i][seen[i]], [0.1, 0.9]) for i in able]).T
    start = np.column_stack([low, high - low, *(np.full(len(able), x) for x in (110.0, 290.0, 0.1, 0.1))])
    p, done = least_squares_many(np.where(seen, doy, 0.0)[able], np.where(seen, value, 0.0)[able], seen[able], start)
    for i, q, ok in zip(able, p, done, strict=True):
        if ok:
            out[i] = _season(curve(GRID, q), threshold)
    return out


def usable(rng: np.random.Generator, cf: np.ndarray, threshold: float, rho: float) -> np.ndarray:
    """Which dates can be used: clear ones always; cloudy ones as a persistent chain leaves gaps."""
    return usable_many([rng], cf, threshold, rho)[0]


def usable_many(rngs: list[np.random.Generator], cf: np.ndarray, threshold: float, rho: float) -> np.ndarray:
    """usable for each of several generators: a row each; the chains go through the dates side by side."""
    u = np.array([g.random(len(cf) + 1) for g in rngs])
    cloudy, out = u[:, -1] < cf.mean() if len(cf) else np.zeros(len(rngs), bool), np.zeros((len(rngs), len(cf)), bool)
    stay, turn = cf + (1 - cf) * rho, cf * (1 - rho)
    for i in range(len(cf)):
        cloudy = u[:, i] < np.where(cloudy, stay[i], turn[i]) if cf[i] > threshold else np.zeros(len(rngs), bool)
        out[:, i] = ~cloudy
    return out


REPLICATES = "cell long, rep int, n_acquisitions int, n_usable int, reference_sos double, reference_eos double, sos double, eos double, los double, ok boolean"


def replicates(
    obs: DataFrame, n_sim: int = 100, threshold: float = 0.2, noise: float = 0.03, model: str = "dbl_logistic", rho: float = 0.35, curve_params=CURVE, seed: int = 1, block: int = 25,
    true_curve: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Retrievals of obs(cell, date, cloud_fraction) under simulated loss and noise.

    The truth is true_curve(day of year) or, without it, the default form with curve_params. A cell's dates are
    gathered to one row; its replicates are dealt in blocks, so a cell with many of them keeps several tasks
    busy, and a block's curves are fitted together. Each replicate draws from the seed, its cell and its number.
    """
    truth = true_curve or functools.partial(curve, p=curve_params)
    reference = fit(GRID, truth(GRID), model)
    if not reference.converged:
        raise ValueError("the reference curve can't be fitted")
    rows = obs.select(F.col("cell").cast("long").alias("cell"), F.struct("date", F.dayofyear("date").cast("double").alias("doy"), F.col("cloud_fraction").cast("double").alias("cf")).alias("seen"))
    cells = rows.groupBy("cell").agg(F.sort_array(F.collect_list("seen")).alias("seen")).select("cell", F.col("seen.doy").alias("doy"), F.col("seen.cf").alias("cf"))
    blocks = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_sim - 1) // block))))
    dealt = blocks.repartition(blocks.sparkSession.sparkContext.defaultParallelism * 4, "cell", "block")

    def one(cell: int, doy: np.ndarray, cf: np.ndarray, reps: range) -> list[tuple]:
        rngs = [special.rng(seed, cell, rep) for rep in reps]
        seen, exact = usable_many(rngs, cf, threshold, rho), truth(doy)
        value = np.zeros(seen.shape)
        for k, g in enumerate(rngs):
            value[k, seen[k]] = exact[seen[k]] + g.normal(0, noise, int(seen[k].sum()))
        fits = fit_many(np.broadcast_to(doy, seen.shape), value, seen, model)
        return [(cell, rep, len(doy), int(n), reference.sos, reference.eos, f.sos, f.eos, f.los, f.converged and f.sos is not None) for rep, n, f in zip(reps, seen.sum(axis=1), fits, strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                made = one(int(r.cell), np.asarray(r.doy, float), np.asarray(r.cf, float), range(r.block * block, min(n_sim, (r.block + 1) * block)))
                yield pd.DataFrame(made, columns=[c.split()[0] for c in REPLICATES.split(", ")])

    return dealt.mapInPandas(run, REPLICATES)


def fit_series(series: DataFrame, keys: list[str], doy: str = "doy", value: str = "value", model: str = "dbl_logistic", threshold: float = 0.5) -> DataFrame:
    """keys, sos, eos, los, peak_doy, peak_value and converged: the fit of each observed series of day of year and value.

    A group's rows are gathered to one row of two arrays, sorted by day; series of one batch are fitted together.
    Nulls are left out. A series with under six values isn't fitted.
    """
    at = F.struct(F.col(doy).cast("double").alias("d"), F.col(value).cast("double").alias("v"))
    rows = series.filter(F.col(doy).isNotNull() & F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias("_s"))
    slim = rows.select(*keys, F.col("_s.d").alias("_d"), F.col("_s.v").alias("_v"))
    names = ["sos", "eos", "los", "peak_doy", "peak_value", "converged"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keys)]) + ", sos double, eos double, los double, peak_doy int, peak_value double, converged boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                days, values = (batch.column(len(keys) + k).to_pylist() for k in (0, 1))
                width = max(map(len, days))
                padded = [np.array([x + [0.0] * (width - len(x)) for x in part]) for part in (days, values)]
                seen = np.arange(width) < np.array([len(x) for x in days])[:, None]
                found = [(f.sos, f.eos, f.los, f.peak_doy, f.peak_value, f.converged) for f in fit_many(*padded, seen, model, threshold)]
                types = [pa.float64()] * 3 + [pa.int32(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], names=[*keys, *names])

    return slim.mapInArrow(run, schema)


def power(reps: DataFrame) -> DataFrame:
    """Median absolute errors, spread, bias and failure rate by cell of replicates."""
    ok = F.col("ok")
    err = lambda c: F.median(F.when(ok, F.abs(F.col(c) - F.col(f"reference_{c}"))))
    q = lambda p: F.percentile(F.when(ok, F.col("sos")), p)
    return reps.groupBy("cell").agg(
        F.first("n_acquisitions").alias("n_acquisitions"), F.median("n_usable").alias("n_usable_median"), F.first("reference_sos").alias("reference_sos"), F.first("reference_eos").alias("reference_eos"),
        err("sos").alias("sos_mae"), (q(0.75) - q(0.25)).alias("sos_iqr"), err("eos").alias("eos_mae"),
        F.median(F.when(ok, F.abs(F.col("los") - F.col("reference_eos") + F.col("reference_sos")))).alias("los_mae"),
        F.median(F.when(ok, F.col("sos") - F.col("reference_sos"))).alias("sos_bias"), F.avg((~ok).cast("double")).alias("failure_rate"), F.count(F.lit(1)).alias("n_sim"),
    )


def power_map(obs: DataFrame, year: int | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """sos_error_days statistics of each cell in the year (the one with most rows unless given), and the details."""
    if year is None:
        year = obs.groupBy(F.year("date").alias("y")).count().orderBy(F.desc("count"), "y").first()["y"]
    details = power(replicates(obs.filter(F.year("date") == year), **settings))
    rows = details.select("cell", F.lit(str(year)).alias("period"), F.lit(None).cast("string").alias("sensor"), F.lit("sos_error_days").alias("metric"), F.col("sos_mae").alias("value"), F.col("n_acquisitions").alias("n"))
    return stats(rows, "cell-year"), details
