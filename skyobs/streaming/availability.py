"""Availability statistics over streams of observations: an extension of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyobs.functions.exprs import period
from skyobs.operators.statistics import OF_PERIOD, stats


def clear_obs_stream(obs: DataFrame, time: str = "time", window: str = "30 days", delay: str = "10 days", threshold: float = 0.2) -> DataFrame:
    """Scenes, clear ones and mean cloud by window, cell and sensor, with a watermark; in append mode, rows of closed windows."""
    return (
        obs.withWatermark(time, delay).groupBy(F.window(time, window), "cell", "sensor")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cloud_fraction") <= threshold).alias("n_clear_obs"), F.avg("cloud_fraction").alias("cloud_fraction"))
        .select(F.col("window.start").alias("start"), "cell", "sensor", "n", "n_clear_obs", "cloud_fraction")
    )


def merge_batches(folder: str, by: str = "month", threshold: float = 0.2):
    """A foreachBatch function: each micro-batch's mergeable counts become a part that batch code merges; a batch that runs again replaces its part."""

    def write(batch: DataFrame, number: int) -> None:
        wide = batch.groupBy("cell", period(F.col("date"), by).alias("period"), "sensor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cloud_fraction") <= threshold).alias("k"))
        parts = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in (("n_scenes", "n"), ("n_clear_obs", "k"))]
        stats(wide.select("cell", "period", "sensor", "n", F.inline(F.array(*parts))), OF_PERIOD[by]).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


GAP_OUT, GAP_STATE = "cell long, date date, gap_days int", "last date"


def gap_stream(obs: DataFrame, threshold: float = 0.2) -> DataFrame:
    """cell, date, gap_days: days since the last clear date before, as clear dates of a stream arrive in order; late ones are skipped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        days = sorted({d for pdf in batches for d in pdf["date"]})
        rows = []
        for d in days:
            if last is None or d > last:
                if last is not None:
                    rows.append((key[0], d, (d - last).days))
                last = d
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["cell", "date", "gap_days"])

    clear = obs.filter(F.col("cloud_fraction") <= threshold).select(F.col("cell").cast("long").alias("cell"), "date")
    return clear.groupBy("cell").applyInPandasWithState(step, GAP_OUT, GAP_STATE, "append", "NoTimeout")
