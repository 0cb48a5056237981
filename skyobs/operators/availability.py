"""Observation tables and what they say about availability."""

from __future__ import annotations

import math
from datetime import date as Date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyobs import sensors as drivers
from skyobs.config import choice, fraction, number, warn
from skyobs.functions import special
from skyobs.functions.exprs import clamp, period, period_bounds
from skyobs.operators.statistics import OF_PERIOD, stats

TIERS = ("metadata", "qa", "mask")
MODELS = ("independent", "empirical", "clustered")


def observations(rows: DataFrame, tier: str = "metadata", units: str = "auto") -> DataFrame:
    """rows as an observation table: cell, date, sensor, platform, cloud, shadow and snow fractions, tier.

    units: 'fraction', 'percent', or 'auto', which takes all values as percent if any is above 1 (one
    scan). Fractions outside [0, 1] after that raise when they are read.
    """
    choice(tier, "tier", TIERS)
    choice(units, "units", ("auto", "fraction", "percent"))
    if units == "auto":
        top = rows.agg(F.max("cloud_fraction")).first()[0]
        units = "percent" if top is not None and top > 1 else "fraction"
        if units == "percent":
            warn("cloud_fraction looks like percent and was divided by 100")
    cf = F.col("cloud_fraction").cast("double") / (100 if units == "percent" else 1)
    checked = F.when(cf.isNull() | cf.between(0, 1), cf).otherwise(F.raise_error(F.lit("cloud_fraction is outside [0, 1]")).cast("double"))
    extra = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (("platform", "string"), ("shadow_fraction", "double"), ("snow_fraction", "double"))]
    return rows.select("cell", F.col("date").cast("date").alias("date"), F.col("sensor").cast("string").alias("sensor"), extra[0], checked.alias("cloud_fraction"), extra[1], extra[2], F.lit(tier).alias("tier"))


def clear_probability(f: Column, model: str = "independent", kappa: float = 0.5, tier: str = "qa") -> Column:
    """Chance that a point is clear in a scene of cloud fraction f.

    independent and empirical: 1 - f, but empirical needs evidence above metadata. clustered: the upper
    tail of a beta distribution, by an Arrow UDF on batches.
    """
    choice(model, "model", MODELS)
    if model == "empirical" and tier == "metadata":
        raise ValueError("the empirical model needs qa or mask evidence")
    if model != "clustered":
        return F.lit(1.0) - f

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map({v: float(special.beta_tail(np.array([v]), kappa)[0]) for v in values.dropna().unique()})

    return tail(f)


def clear_obs(obs: DataFrame, by: str = "year", threshold: float = 0.2, model: str = "independent", tier: str = "qa") -> DataFrame:
    """n_scenes, n_clear_obs, mean cloud_fraction with its standard error, and p_clear by cell, period and sensor.

    A null cloud fraction counts as a scene, not as a clear one. One aggregation, unfolded into long rows.
    """
    fraction(threshold, "threshold")
    p = clear_probability(F.col("cloud_fraction"), model, tier=tier)
    wide = (
        obs.withColumn("_p", p)
        .groupBy("cell", period(F.col("date"), by).alias("period"), "sensor")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("cloud_fraction") <= threshold).alias("clear"), F.avg("cloud_fraction").alias("cf"),
            (F.stddev_samp("cloud_fraction") / F.sqrt(F.count(F.lit(1)))).alias("cf_se"), F.avg("_p").alias("p"),
        )
    )
    none = F.lit(None).cast("double")
    parts = [("n_scenes", F.col("n").cast("double"), none), ("n_clear_obs", F.col("clear").cast("double"), none), ("cloud_fraction", F.col("cf"), F.col("cf_se")), ("p_clear", F.col("p"), none)]
    long = wide.select("cell", "period", "sensor", "n", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value"), s.alias("se")) for m, v, s in parts])))
    return stats(long, OF_PERIOD[by])


def gap_table(obs: DataFrame, by: str = "year", threshold: float = 0.2, include_edges: bool = True) -> DataFrame:
    """cell, period, sensor, max_gap_days, mean_gap_days, n_clear_obs, n (acquisitions), one row a cell and period.

    Gaps lie between distinct clear dates and, with edges, between them and the period's bounds. A period
    without a clear date is one gap of all its days; one with a single clear date is, without edges, one
    of the whole span. The bounds of 'all' are those of the whole table. Several sensors are 'MULTI'.
    The rows are dealt once, by cell and period; dates, lags and gaps follow in the same task.
    """
    fraction(threshold, "threshold")
    rows = obs.select("cell", "date", "sensor", period(F.col("date"), by).alias("period"), F.coalesce(F.col("cloud_fraction") <= threshold, F.lit(False)).alias("clear"))
    if by == "all":
        rows = rows.crossJoin(F.broadcast(obs.agg(F.min("date").alias("p0"), F.max("date").alias("p1"))))  # one row
    days = (
        rows.repartition("cell", "period").groupBy("cell", "period", "date", *(["p0", "p1"] if by == "all" else []))
        .agg(F.max("clear").alias("clear"), F.count(F.lit(1)).alias("n"), F.min("sensor").alias("s0"), F.max("sensor").alias("s1"))
    )
    if by != "all":
        p0, p1 = period_bounds(F.col("date"), by)
        days = days.withColumn("p0", p0).withColumn("p1", p1)
    before = F.max(F.when(F.col("clear"), F.col("date"))).over(Window.partitionBy("cell", "period").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col("clear"), F.datediff("date", before))
    lagged = days.withColumn("gap", gap)
    groups = lagged.groupBy("cell", "period").agg(
        F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.sum("n").alias("n"), F.count_if("clear").alias("k"), F.min("s0").alias("s0"), F.max("s1").alias("s1"),
        F.min(F.when(F.col("clear"), F.col("date"))).alias("first"), F.max(F.when(F.col("clear"), F.col("date"))).alias("last"), F.max("gap").alias("inner"),
    )
    span, whole = F.datediff("p1", "p0"), (F.datediff("p1", "p0") + 1)
    if include_edges:
        longest = F.greatest(F.coalesce(F.col("inner"), F.lit(0)), F.datediff("first", "p0"), F.datediff("p1", "last"))
        mean = span.cast("double") / (F.col("k") + 1)
    else:
        longest = F.when(F.col("k") == 1, whole).otherwise(F.col("inner"))
        mean = F.when(F.col("k") == 1, whole.cast("double")).otherwise(F.try_divide(F.datediff("last", "first").cast("double"), F.col("k") - 1))
    empty = F.col("k") == 0
    return groups.select(
        "cell", "period", F.when(F.col("s0") == F.col("s1"), F.col("s0")).when(F.col("s0").isNotNull(), F.lit("MULTI")).alias("sensor"),
        F.when(empty, whole).otherwise(longest).cast("long").alias("max_gap_days"), F.when(empty, whole.cast("double")).otherwise(mean).alias("mean_gap_days"), F.col("k").alias("n_clear_obs"), "n",
    )


def gaps(obs: DataFrame, by: str = "year", threshold: float = 0.2, include_edges: bool = True) -> DataFrame:
    """gap_table as statistics."""
    wide = gap_table(obs, by, threshold, include_edges)
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("max_gap_days", "mean_gap_days", "n_clear_obs")]
    return stats(wide.select("cell", "period", "sensor", "n", F.inline(F.array(*parts))), OF_PERIOD[by])


def gap_exceedance(obs: DataFrame, by: str = "year", threshold: float = 0.2, critical: float = 30, include_edges: bool = True) -> DataFrame:
    """Share of a cell's periods whose longest gap is above critical."""
    number(critical, "critical", lower=0)
    return gap_table(obs, by, threshold, include_edges).groupBy("cell").agg(F.avg((F.col("max_gap_days") > critical).cast("double")).alias("exceedance"), F.count(F.lit(1)).alias("n_periods"))


def persistence(obs: DataFrame, by: str = "all", threshold: float = 0.2, max_interval: float = 20, min_pairs: int = 10) -> DataFrame:
    """First-order persistence of cloud by cell, sensor and period.

    Rows of a date are one state, cloudy if most are (a tie is clear). Pairs of neighbouring dates up to
    max_interval days apart give p11 and p01; groups need 3 dates, min_pairs pairs and 3 from each state.
    Cloudy runs span all dates, whatever lies between. Null fractions are left out.
    """
    state = obs.filter(F.col("cloud_fraction").isNotNull()).select("cell", "sensor", period(F.col("date"), by).alias("period"), "date", (F.col("cloud_fraction") > threshold).alias("c"))
    keys = ["cell", "sensor", "period"]
    days = state.repartition(*keys).groupBy(*keys, "date").agg((F.count_if("c") * 2 > F.count(F.lit(1))).alias("c"))
    w = Window.partitionBy(*keys).orderBy("date")
    lagged = days.withColumn("pc", F.lag("c").over(w)).withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    starts = F.col("c") & (F.col("pc").isNull() | ~F.col("pc"))  # of cloudy runs
    near = F.col("gap") <= max_interval
    found = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_acq"), F.count_if("c").alias("nc"), F.count_if(near).alias("n_pairs"), F.count_if(near & F.col("pc")).alias("n1"), F.count_if(near & ~F.col("pc")).alias("n0"),
        F.count_if(near & F.col("pc") & F.col("c")).alias("n11"), F.count_if(near & ~F.col("pc") & F.col("c")).alias("n01"), F.median(F.when(near, F.col("gap"))).alias("mi"), F.count_if(starts).alias("runs"),
    ).filter(f"n_acq >= 3 and n_pairs >= {int(min_pairs)} and n1 >= 3 and n0 >= 3")
    d = lambda a, b: F.col(a).cast("double") / F.col(b)
    return found.select(
        *keys, d("nc", "n_acq").alias("p_cloud"), d("n11", "n1").alias("p11"), d("n01", "n0").alias("p01"), (d("n11", "n1") - d("n01", "n0")).alias("rho"), F.col("mi").cast("double").alias("median_interval_days"),
        "n_pairs", "n_acq", F.coalesce(F.try_divide(F.col("nc").cast("double"), F.col("runs")), F.lit(0.0)).alias("mean_cloudy_run"),
    )


SEASON_SCHEMA = "cell long, n int, converged boolean, amplitude double, peak_doy int, window_start int, window_end int, window_p double"


def seasonality(obs: DataFrame, threshold: float = 0.2, harmonics: int = 1, window_days: int = 60, min_obs: int = 12) -> DataFrame:
    """Seasonal cycle of the chance of a clear observation, by a logistic fit on harmonics of the day of the year.

    For each cell: half the range of the fitted chance, its first peak, and the best circular window of
    window_days. A fit that doesn't converge, or reaches chances of 0 or 1, has converged false and no values.
    The observations of a cell, reduced to counts by day of the year, are all that its task holds.
    """
    if harmonics not in (1, 2):
        raise ValueError("harmonics is 1 or 2")
    days = obs.filter(F.col("cloud_fraction").isNotNull()).groupBy(F.col("cell").cast("long").alias("cell"), F.dayofyear("date").alias("doy")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cloud_fraction") <= threshold).alias("k"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doy")
        n, k = pdf["n"].to_numpy(float), pdf["k"].to_numpy(float)
        row: list = [key[0], int(n.sum()), False, None, None, None, None, None]
        if n.sum() >= min_obs and 0 < k.sum() < n.sum():
            beta, ok = logistic_fit(_harmonics(pdf["doy"].to_numpy(float), harmonics), n, k)
            if ok:
                p = 1 / (1 + np.exp(-_harmonics(np.arange(1, 366, dtype=float), harmonics) @ beta))
                means = np.convolve(np.concatenate((p, p[: window_days - 1])), np.full(window_days, 1 / window_days), "valid")
                at = int(means.argmax()) + 1
                row[2:] = [True, float((p.max() - p.min()) / 2), int(p.argmax()) + 1, at, (at + window_days - 2) % 365 + 1, float(means.max())]
        return pd.DataFrame([row], columns=["cell", "n", "converged", "amplitude", "peak_doy", "window_start", "window_end", "window_p"])

    return days.groupBy("cell").applyInPandas(fit, SEASON_SCHEMA)


def _harmonics(doy: np.ndarray, harmonics: int) -> np.ndarray:
    angle = 2 * math.pi * doy / 365.25
    return np.column_stack([np.ones(len(doy)), *(f(h * angle) for h in range(1, harmonics + 1) for f in (np.cos, np.sin))])


def logistic_fit(x: np.ndarray, n: np.ndarray, k: np.ndarray, steps: int = 25, eps: float = 1e-8) -> tuple[np.ndarray, bool]:
    """Binomial regression by iterated weighted least squares; false if it doesn't settle or chances reach 0 or 1."""
    mu = (k + 0.5) / (n + 1)
    eta, before, beta = np.log(mu / (1 - mu)), np.inf, np.zeros(x.shape[1])
    for _ in range(steps):
        w = n * mu * (1 - mu)
        if np.any(w <= 0) or not np.all(np.isfinite(w)):
            return beta, False
        z = eta + (k / n - mu) / (mu * (1 - mu))
        beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)[0]
        eta = x @ beta
        mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        with np.errstate(divide="ignore", invalid="ignore"):
            dev = 2 * np.nansum(np.where(k > 0, k * np.log(k / (n * mu)), 0) + np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - mu))), 0))
        if abs(dev - before) / (abs(dev) + 0.1) < eps:
            return beta, bool(np.all((mu > 10 * np.finfo(float).eps) & (mu < 1 - 10 * np.finfo(float).eps)))
        before = dev
    return beta, False


def synergy(spark: SparkSession, names: list[str], start: Date, end: Date, by: str = "year", latitude: float = 0) -> DataFrame:
    """Nominal and effective revisit of a constellation by period from start, with a COMBINED row each.

    Periods begin at anniversaries of start. Each sensor has as many active platforms as the share of the
    period's days that each flies; observations grow towards the poles as tracks converge.
    """
    choice(by, "by", ("year", "month"))
    step, days = ("12 months", 365.25) if by == "year" else ("1 month", 30.44)
    gain = 1 / max(0.15, math.cos(math.radians(min(abs(latitude), 81))))
    first = spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', interval {step})")).alias("p0"))
    periods = first.select("p0", F.least(F.date_sub(F.expr(f"p0 + interval {step}").cast("date"), 1), F.lit(end)).alias("p1"), F.date_format("p0", "yyyy" if by == "year" else "yyyy-MM").alias("period")).withColumn("days", F.datediff("p1", "p0") + 1)
    flying = drivers.platforms(spark, names)
    last = F.coalesce(F.col("end"), F.to_date(F.lit("2999-12-31")))
    active = F.greatest(F.lit(0), F.datediff(F.least("p1", last), F.greatest("p0", "start")) + 1) / F.col("days")
    # both sides are a handful of rows, bounded by the registry and by the two dates
    pairs = periods.join(F.broadcast(flying), F.lit(True)).select("period", "days", "sensor", "revisit", active.alias("active"))
    each = pairs.groupBy("period", "days", "sensor", "revisit").agg(F.sum("active").alias("n_platforms")).withColumn("nominal_obs", F.col("days") / F.col("revisit"))
    each = each.withColumn("combined_obs", F.col("nominal_obs") * F.col("n_platforms") * F.lit(gain))
    both = each.rollup("period", "sensor").agg(*[F.sum(c).alias(c) for c in ("n_platforms", "nominal_obs", "combined_obs")]).filter("period is not null")
    return both.select("period", F.coalesce("sensor", F.lit("COMBINED")).alias("sensor"), "n_platforms", "nominal_obs", "combined_obs", F.when(F.col("combined_obs") > 0, F.lit(days) / F.col("combined_obs")).alias("effective_revisit_days"))


def binomial_tail(p: Column, n: Column, k: Column) -> Column:
    """P(Bin(n, p) >= k), by a recurrence over the terms in log space."""
    q = clamp(p, 1e-12, 1 - 1e-12)
    term = lambda i: F.exp(_lchoose(n, i) + i * F.ln(q) + (n - i) * F.ln(F.lit(1.0) - q))
    total = F.aggregate(F.sequence(F.greatest(k, F.lit(0)), n), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(k > n, F.lit(0.0)).when(k <= 0, F.lit(1.0)).when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def _lchoose(n: Column, k: Column) -> Column:
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.ln((n - k + i).cast("double") / i))


def feasibility(table: DataFrame, max_gap: int, window_days: int, n_sim: int = 2000, seed: int = 1) -> DataFrame:
    """table(id, p_clear, n_acquisitions, n_required) with expected clear scenes, the chance of enough, and of no long gap.

    The last is simulated: acquisitions end equal steps of the window, each clear with its chance; gaps to the
    window's edges count. The draws of a row depend on the seed and its id alone.
    """
    p = F.col("p_clear").cast("double")
    n = F.rint("n_acquisitions").cast("int")
    base = table.withColumn("expected", F.col("n_acquisitions") * p).withColumn("p_enough", binomial_tail(p, n, F.col("n_required").cast("int")))

    @F.pandas_udf("double")
    def no_gap(ids: pd.Series, ps: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([gap_chance(float(a), int(b), max_gap, window_days, n_sim, seed, i) for i, a, b in zip(ids, ps, ns, strict=True)])

    return base.withColumn("p_gap_ok", no_gap("id", p, n))


def gap_chance(p: float, n: int, max_gap: float, window: float, n_sim: int, seed: int, key) -> float:
    """Share of simulations with a clear day and no gap, edges included, above max_gap days."""
    clear = special.rng(seed, key).random((n_sim, n)) < p
    days = np.arange(1, n + 1) * (window / n)
    last = np.maximum.accumulate(np.where(clear, days, 0.0), axis=1)
    before = np.concatenate((np.zeros((n_sim, 1)), last[:, :-1]), axis=1)
    longest = np.maximum(np.where(clear, days - before, 0.0).max(axis=1), window - last[:, -1])
    return float((clear.any(axis=1) & (longest <= max_gap)).mean())
