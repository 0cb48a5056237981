"""Chunked application of functions to rasters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs.config import options


def chunks(spark: SparkSession, rows: int, cols: int, layers: int = 1, budget: float | None = None) -> DataFrame:
    """block, row_start, n_rows: runs of whole rows that fit a budget of pixels."""
    per = max(1, int((budget or options().chunk_pixels) // (cols * max(1, layers))))
    start = F.col("id")
    return spark.range(1, rows + 1, per).select((F.floor((start - 1) / per) + 1).cast("int").alias("block"), start.cast("int").alias("row_start"), F.least(F.lit(per), F.lit(rows + 1) - start).cast("int").alias("n_rows"))


def apply_chunks(pixels: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn on Arrow batches of pixels, in parallel; batches, not scenes, bound the memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return pixels.mapInPandas(run, schema)
