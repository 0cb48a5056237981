"""Accuracy, calibration and comparison of predictions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyobs.functions import special
from skyobs.functions.exprs import binary_entropy


def confusion(df: DataFrame, pred: str = "pred", truth: str = "truth", levels: list | None = None) -> DataFrame:
    """pred, truth, n for every pair of levels, pairs that don't occur included; rows with a null don't count."""
    counts = df.filter(F.col(pred).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(pred).alias("pred"), F.col(truth).alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    if levels is None:
        lv = counts.select(F.explode(F.array("pred", "truth")).alias("level")).distinct()
    else:
        lv = df.sparkSession.createDataFrame([(v,) for v in levels], "level " + df.schema[pred].dataType.simpleString())
    pairs = lv.select(F.col("level").alias("pred")).crossJoin(F.broadcast(lv.select(F.col("level").alias("truth"))))  # levels squared
    return pairs.join(counts, ["pred", "truth"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(table: DataFrame) -> DataFrame:
    """class, n_truth, n_pred, precision, recall, specificity, f1, iou of a confusion table; null where a denominator is 0."""
    n = F.col("n").cast("double")
    sides = table.select(F.inline(F.array(
        F.struct(F.col("pred").alias("class"), n.alias("p"), F.lit(0.0).alias("t"), F.when(F.col("pred") == F.col("truth"), n).otherwise(0.0).alias("tp")),
        F.struct(F.col("truth").alias("class"), F.lit(0.0).alias("p"), n.alias("t"), F.lit(0.0).alias("tp")),
    )))
    sums = sides.groupBy("class").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.sum("tp").alias("tp")).withColumn("all", F.sum("p").over(Window.partitionBy(F.lit(1))))  # a row a class
    tp, p, t, every = (F.col(c) for c in ("tp", "p", "t", "all"))
    precision, recall, tn = F.try_divide(tp, p), F.try_divide(tp, t), every - p - t + tp
    return sums.select(
        "class", t.cast("long").alias("n_truth"), p.cast("long").alias("n_pred"), precision.alias("precision"), recall.alias("recall"), F.try_divide(tn, every - t).alias("specificity"),
        F.try_divide(precision * recall * 2, precision + recall).alias("f1"), F.try_divide(tp, p + t - tp).alias("iou"),
    )


def overall(table: DataFrame, positive=1) -> DataFrame:
    """n, overall_accuracy, balanced_accuracy and, with two classes, mcc of a confusion table."""
    sums = table.agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("pred") == F.col("truth"), F.col("n"))).cast("double").alias("hit"), F.count_distinct("pred").alias("k"),
        *[F.sum(F.when(((F.col("pred") == positive) == p) & ((F.col("truth") == positive) == t), F.col("n")).otherwise(0)).cast("double").alias(a) for a, p, t in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))],
    )
    balanced = per_class(table).agg(F.avg("recall").alias("balanced_accuracy"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    mcc = F.when(F.col("k") == 2, F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))
    return sums.crossJoin(balanced).select(F.col("n").cast("long").alias("n"), F.try_divide("hit", "n").alias("overall_accuracy"), "balanced_accuracy", mcc.alias("mcc"))


def roc(df: DataFrame, prob: str = "prob", truth: str = "truth", n_thresh: int = 101) -> DataFrame:
    """threshold, fpr, tpr, precision at i * step; a probability at the threshold is a hit.

    Each row falls in the bucket of the highest threshold that it reaches: one aggregation to n_thresh
    buckets, then sums from above. Edges are products i * step, as a sequence by step gives.
    """
    step = 1 / (n_thresh - 1)
    edges = [i * step for i in range(n_thresh)]
    p = F.col(prob)
    guess = F.least(F.lit(n_thresh - 1), F.greatest(F.lit(0), F.floor(p / step).cast("int")))
    at = F.array(*[F.lit(e) for e in edges])
    edge = lambda k: F.get(at, k)
    bucket = F.when(p < 0, -1).when(edge(guess) > p, guess - 1).when(F.coalesce(edge(guess + 1) <= p, F.lit(False)), guess + 1).otherwise(guess)
    y = (F.col(truth) > 0).cast("long")
    counts = df.filter(p.isNotNull() & F.col(truth).isNotNull()).groupBy(bucket.alias("k")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    grid = df.sparkSession.createDataFrame(list(enumerate(edges)), "k int, threshold double")
    full = counts.join(grid, "k", "full").select("k", "threshold", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("k"))  # n_thresh rows
    whole = Window.partitionBy(F.lit(1))
    d = lambda c: c.cast("double")
    summed = full.select("threshold", d(F.sum("pos").over(above)).alias("tp"), d(F.sum("neg").over(above)).alias("fp"), d(F.sum("pos").over(whole)).alias("p"), d(F.sum("neg").over(whole)).alias("n"))
    return summed.filter("threshold is not null").select("threshold", F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def auc(curve: DataFrame) -> DataFrame:
    """Trapezoids over the sampled points of a roc table, in the order of (fpr, tpr); no points are added."""
    w = Window.partitionBy(F.lit(1)).orderBy("fpr", "tpr")
    pts = curve.filter("fpr is not null and tpr is not null").select("fpr", "tpr", F.lag("fpr").over(w).alias("x0"), F.lag("tpr").over(w).alias("y0"))
    return pts.agg(F.sum((F.col("fpr") - F.col("x0")) * (F.col("tpr") + F.col("y0")) / 2).alias("auc"))


def calibration(df: DataFrame, prob: str = "prob", truth: str = "truth", bins: int = 10) -> DataFrame:
    """bin, lower, upper, n, mean_pred, observed. Bins are closed below, the last above too; empty ones stay."""
    step = 1 / bins
    edges = [i * step for i in range(bins)] + [1.0]
    p = F.col(prob)
    found = F.least(F.lit(bins), F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(e) for e in edges[:-1]]), lambda e: e <= p))))
    sums = df.filter(p.isNotNull() & F.col(truth).isNotNull()).groupBy(found.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg((F.col(truth) > 0).cast("double")).alias("observed"))
    every = df.sparkSession.createDataFrame([(k + 1, edges[k], edges[k + 1]) for k in range(bins)], "bin int, lower double, upper double")
    return every.join(sums, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_summary(df: DataFrame, prob: str = "prob", truth: str = "truth", bins: int = 10) -> DataFrame:
    """brier and ece."""
    kept = df.filter(F.col(prob).isNotNull() & F.col(truth).isNotNull())
    brier = kept.agg(F.avg(F.pow(F.col(prob) - (F.col(truth) > 0).cast("double"), F.lit(2.0))).alias("brier"))
    table = calibration(df, prob, truth, bins)
    ece = table.agg((F.sum(F.col("n") * F.abs(F.col("mean_pred") - F.col("observed"))) / F.sum("n")).alias("ece"))
    return brier.crossJoin(ece)


def mcnemar(df: DataFrame, preds: list[str], truth: str = "truth") -> DataFrame:
    """Pairwise McNemar tests with continuity correction, from one aggregation over all pairs."""
    correct = {p: (F.col(p) == F.col(truth)) for p in preds}
    pairs = list(combinations(preds, 2))
    sums = df.agg(*[c for i, (a, b) in enumerate(pairs) for c in (F.count_if(correct[a] & ~correct[b]).alias(f"b{i}"), F.count_if(~correct[a] & correct[b]).alias(f"c{i}"))])
    rows = F.array(*[F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.col(f"b{i}").alias("a_only_correct"), F.col(f"c{i}").alias("b_only_correct")) for i, (a, b) in enumerate(pairs)])
    b, c = F.col("a_only_correct").cast("double"), F.col("b_only_correct").cast("double")
    return sums.select(F.inline(rows)).withColumn("mcnemar_chi2", F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2.0)), b + c))


RESAMPLES = ("distinct", "multinomial")


def bootstrap(df: DataFrame, preds: list[str], truth: str = "truth", block: str | None = None, n_boot: int = 500, conf: float = 0.95, seed: int = 1, resample: str = "distinct") -> DataFrame:
    """method, accuracy, lower and upper: accuracies with a bootstrap interval over blocks.

    Rows are summed by block, and blocks by draw, on the executors, so there may be any number of blocks. A
    draw counts each block as often as a Poisson variable of mean 1 says, which is what drawing as many blocks with
    replacement comes to ('multinomial'), or once if that is above 0 ('distinct', which gives narrower intervals).
    Without a block column, a hash deals rows to 1,000 blocks. Blocks draw from the seed and their own name.
    """
    if resample not in RESAMPLES:
        raise ValueError("resample is distinct or multinomial")
    key = F.xxhash64(F.col(block)) if block else F.pmod(F.xxhash64(*[F.col(c) for c in df.columns], F.monotonically_increasing_id()), F.lit(1000))
    right = [f"right_{i}" for i in range(len(preds))]
    sums = df.groupBy(key.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.count_if(F.col(p) == F.col(truth)).cast("double").alias(r) for p, r in zip(preds, right, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_boot + 1, len(preds) + 1))  # the last row: every block once
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                values = np.column_stack([c.to_numpy() for c in part.columns[1:]])
                weights = np.array([special.rng(seed, b).poisson(1, n_boot) for b in part.column(0).to_pylist()], float)
                weights = np.minimum(weights, 1) if resample == "distinct" else weights
                total += np.vstack([weights.T, np.ones((1, part.num_rows))]) @ values
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot + 1), pa.int32()), *(pa.array(c) for c in total.T)], names=["draw", "n", *right])

    drawn = sums.mapInArrow(run, "draw int, n double, " + ", ".join(f"{r} double" for r in right)).groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("n", *right)])
    shares = drawn.select("draw", F.inline(F.array(*[F.struct(F.lit(p).alias("method"), F.try_divide(F.col(r), F.col("n")).alias("share")) for p, r in zip(preds, right, strict=True)])))
    of_draws, tail = F.when(F.col("draw") < n_boot, F.col("share")), (1 - conf) / 2
    return shares.groupBy("method").agg(F.max(F.when(F.col("draw") == n_boot, F.col("share"))).alias("accuracy"), F.percentile(of_draws, tail).alias("lower"), F.percentile(of_draws, 1 - tail).alias("upper"))


def with_p_values(tests: DataFrame, chi2: str = "mcnemar_chi2") -> DataFrame:
    """tests with p_value, the chance of a chi-squared value (one degree of freedom) as large; null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [None if x is None else special.chi2_1_tail(x) for x in batch.column(batch.schema.get_field_index(chi2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p_value"])

    return tests.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.schema.fields) + ", p_value double")


def compared(df: DataFrame, preds: list[str], truth: str = "truth", **settings) -> DataFrame:
    """method, accuracy, lower, upper, best, and McNemar's chi-squared and p value against the most accurate method (null for itself)."""
    summary = bootstrap(df, preds, truth, **settings)
    if len(preds) < 2:
        return summary.withColumns({"best": F.col("method"), "mcnemar_chi2": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double")})
    best = summary.agg(F.max_by("method", F.struct("accuracy", "method")).alias("best"))
    tests = with_p_values(mcnemar(df, preds, truth)).select(F.col("method_a"), F.col("method_b"), "mcnemar_chi2", "p_value")
    both = tests.unionByName(tests.select(F.col("method_b").alias("method_a"), F.col("method_a").alias("method_b"), "mcnemar_chi2", "p_value"))
    marked = summary.crossJoin(F.broadcast(best))  # one row
    return marked.join(both, (F.col("best") == F.col("method_a")) & (F.col("method") == F.col("method_b")), "left").drop("method_a", "method_b")


@dataclass(frozen=True)
class Comparison:
    """A row a method, best first, and a row a pair of methods, as dicts."""

    summary: list[dict]
    pairwise: list[dict]


def compare(df: DataFrame, preds: list[str], truth: str = "truth", **settings) -> Comparison:
    """bootstrap's rows, best first, and McNemar tests with p values: as many rows as methods, and pairs of them, reach the driver."""
    found = [r.asDict() for r in bootstrap(df, preds, truth, **settings).collect()]
    pairs = [r.asDict() for r in with_p_values(mcnemar(df, preds, truth)).collect()] if len(preds) > 1 else []
    return Comparison(sorted(found, key=lambda r: -r["accuracy"]), pairs)


def agreement(df: DataFrame, masks: list[str]) -> DataFrame:
    """df with agreement (share of masks that vote cloud), consensus (over half), entropy in bits and unanimous."""
    if len(masks) < 2:
        raise ValueError("at least two masks are needed")
    votes: Column = sum(((F.col(m).cast("double") > 0).cast("double") for m in masks), F.lit(0.0))
    share = votes / len(masks)
    out = df.withColumn("agreement", share)
    a = F.col("agreement")
    return out.withColumn("consensus", (a > 0.5).cast("int")).withColumn("entropy", binary_entropy(a)).withColumn("unanimous", (a == 0) | (a == 1))


def disagreement(df: DataFrame, masks: list[str]) -> DataFrame:
    """Agreement, Jaccard and one-sided shares of all pairs of masks, from one aggregation."""
    m = {c: F.col(c).cast("double") > 0 for c in masks}
    pairs = list(combinations(masks, 2))
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), *[F.count_if(m[c]).cast("double").alias(f"t_{c}") for c in masks]]
    aggs += [F.count_if(m[a] & m[b]).cast("double").alias(f"i{k}") for k, (a, b) in enumerate(pairs)]
    sums = df.agg(*aggs)
    rows = []
    for k, (a, b) in enumerate(pairs):
        n, i, ta, tb = F.col("n"), F.col(f"i{k}"), F.col(f"t_{a}"), F.col(f"t_{b}")
        rows.append(F.struct(
            F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), ((n - ta - tb + i * 2) / n).alias("agreement"), F.try_divide(i, ta + tb - i).alias("jaccard"),
            ((ta - i) / n).alias("a_only"), ((tb - i) / n).alias("b_only"), (ta / n).alias("cloud_a"), (tb / n).alias("cloud_b"),
        ))
    return sums.select(F.inline(F.array(*rows)))


def disagreement_by(df: DataFrame, masks: list[str], stratum: str) -> DataFrame:
    """stratum, n, mean_agreement (unanimous), mean_entropy, mean_cloud."""
    return agreement(df, masks).groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("unanimous").cast("double")).alias("mean_agreement"), F.avg("entropy").alias("mean_entropy"), F.avg("agreement").alias("mean_cloud"))
