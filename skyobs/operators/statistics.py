"""The long statistics table: vocabulary, validation, merging, pivoting, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Metric, unit, lower bound, upper bound (None: none), how two values combine.
METRICS = [
    ("n_scenes", "count", 0.0, None, "sum"),
    ("n_clear_obs", "count", 0.0, None, "sum"),
    ("cloud_fraction", "fraction", 0.0, 1.0, "wmean"),
    ("clear_fraction", "fraction", 0.0, 1.0, "wmean"),
    ("shadow_fraction", "fraction", 0.0, 1.0, "wmean"),
    ("snow_fraction", "fraction", 0.0, 1.0, "wmean"),
    ("max_gap_days", "days", 0.0, None, "max"),
    ("mean_gap_days", "days", 0.0, None, "wmean"),
    ("p_clear", "probability", 0.0, 1.0, "wmean"),
    ("revisit_days", "days", 0.0, None, "wmean"),
    ("sos_error_days", "days", 0.0, None, "wmean"),
    ("disagreement", "fraction", 0.0, 1.0, "wmean"),
]
DENOMINATORS = ("cell", "cell-year", "cell-month", "cell-season", "scene", "pixel")
#: Denominator of a statistic by the granularity of its period.
OF_PERIOD = {"year": "cell-year", "month": "cell-month", "season": "cell-season", "all": "cell"}
COLUMNS = ["cell", "period", "sensor", "metric", "value", "n", "se", "denominator", "unit"]


class StatisticsError(ValueError):
    """A statistics table breaks its contract."""


def vocabulary(spark: SparkSession) -> DataFrame:
    """The metrics: a table of a dozen rows."""
    return spark.createDataFrame(METRICS, "metric string, unit string, lower double, upper double, combine string")


def stats(rows: DataFrame, denominator: str | None = None) -> DataFrame:
    """rows of cell, period, sensor, metric, value, n (and se, denominator) as a statistics table with units."""
    if denominator is not None:
        rows = rows.withColumn("denominator", F.lit(denominator))
    if "se" not in rows.columns:
        rows = rows.withColumn("se", F.lit(None).cast("double"))
    units = F.create_map(*[F.lit(x) for m in METRICS for x in (m[0], m[1])])
    return rows.select("cell", F.col("period").cast("string").alias("period"), F.col("sensor").cast("string").alias("sensor"), "metric", F.col("value").cast("double").alias("value"), F.col("n").cast("long").alias("n"), F.col("se").cast("double").alias("se"), "denominator", F.try_element_at(units, F.col("metric")).alias("unit"))


def violations(table: DataFrame) -> DataFrame:
    """The rows that break the contract, with the reason: one projection and filter, no shuffle."""
    known = F.create_map(*[F.lit(x) for m in METRICS for x in (m[0], m[2])])
    upper = F.create_map(*[x for m in METRICS if m[3] is not None for x in (F.lit(m[0]), F.lit(m[3]))])
    units = F.create_map(*[F.lit(x) for m in METRICS for x in (m[0], m[1])])
    low, high = F.try_element_at(known, F.col("metric")), F.try_element_at(upper, F.col("metric"))
    reason = (
        F.when(F.col("metric").isNull() | low.isNull(), "unknown metric")
        .when(F.col("denominator").isNull() | ~F.col("denominator").isin(*DENOMINATORS), "unknown denominator")
        .when(F.col("unit").isNull() | (F.col("unit") != F.try_element_at(units, F.col("metric"))), "wrong unit")
        .when(F.col("value") < low, "below the permitted range")
        .when(F.col("value") > high, "above the permitted range")
        .when(F.col("n") < 0, "negative n")
    )
    return table.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def validate(table: DataFrame) -> DataFrame:
    """table, if it keeps the contract; else StatisticsError with the first reason. Runs a scan."""
    if missing := [c for c in COLUMNS if c not in table.columns]:
        raise StatisticsError(f"columns are missing: {', '.join(missing)}")
    if bad := violations(table).select("metric", "value", "denominator", "reason").limit(1).collect():
        b = bad[0]
        raise StatisticsError(f"{b['reason']}: metric {b['metric']}, value {b['value']}, denominator {b['denominator']}")
    return table


def merge(*tables: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of equal (cell, period, sensor, metric) made one: summed, maximised or averaged by n, as the metric says.

    n adds up. A weighted mean without any n is a plain one. se survives only where one row had it alone.
    The denominator isn't part of the key unless strict; else the least name of the merged ones stays.
    One shuffle of partial aggregates.
    """
    keys = ["cell", "period", "sensor", "metric"] + (["denominator"] if strict else [])
    rule = F.create_map(*[F.lit(x) for m in METRICS for x in (m[0], m[4])])
    weight = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    every = reduce(DataFrame.unionByName, tables)
    merged = every.groupBy(*keys).agg(
        F.sum("value").alias("s"), F.max("value").alias("m"), F.avg("value").alias("a"), F.sum(F.col("value") * weight).alias("vw"), F.sum(F.when(F.col("value").isNotNull(), weight)).alias("w"),
        F.sum(F.coalesce(F.col("n"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("rows"), F.min("se").alias("one_se"), *([] if strict else [F.min("denominator").alias("denominator")]),
    )
    how = F.try_element_at(rule, F.col("metric"))
    value = F.when(how == "sum", F.col("s")).when(how == "max", F.col("m")).when(F.col("w") > 0, F.try_divide("vw", "w")).otherwise(F.col("a"))
    return stats(merged.withColumn("value", value).withColumn("se", F.when(F.col("rows") == 1, F.col("one_se"))))


def wide(table: DataFrame, metrics: list[str]) -> DataFrame:
    """A column for each metric: conditional aggregates, so metrics needn't be looked up first."""
    return table.filter(F.col("metric").isin(metrics)).groupBy("cell", "period", "sensor").agg(*[F.first(F.when(F.col("metric") == m, F.col("value")), ignorenulls=True).alias(m) for m in metrics])


def summary(table: DataFrame) -> DataFrame:
    """Rows, minimum, median, mean and maximum by metric."""
    return table.groupBy("metric", "unit").agg(F.count(F.lit(1)).alias("n_rows"), F.min("value").alias("min"), F.median("value").alias("median"), F.avg("value").alias("mean"), F.max("value").alias("max"))
