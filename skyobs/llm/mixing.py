"""Mixing sources to target weights by hash thresholds that nested histograms find."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyobs.llm.runtime import checkpointed, named, salted, spread_join
from skyobs.llm.sharding import in_ranges, with_prefix_sums

#: Words are runs of other characters than these: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and the most that a source can give of its own.
BUDGET, MOST = 1.5, 2.0
#: Each of LEVELS histograms splits a bucket by so many further bits of the 63-bit hash.
DIGIT_BITS, LEVELS = 12, 5


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Targets of (source, source_size) rows, one row a source: min(most * size, level * weight).

    The level spends `budget` of all words: sources are ranked by the level at which they reach their
    cap, and prefix sums tell how many are capped; the others share the rest by weight. That is where
    handing on the excess by weight ends. Sources rank by code point, null last.
    """
    named_ones = with_prefix_sums(in_ranges(checkpointed(sizes.withColumn("_none", F.col("source").isNull())), ["_none", "source"]), ["_none", "source"], [])
    weighed = named_ones.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("weight")).withColumnRenamed("rank", "by_name")
    summed = with_prefix_sums(in_ranges(capped.drop("bucket"), ["full_at", "by_name"]), ["full_at", "by_name"], ["cap", "weight"])
    whole = summed.agg((F.sum("source_size") * F.lit(min(budget, most))).alias("all_words"), F.sum("weight").alias("all_weight"))
    # the level if exactly the sources ahead are capped; the first that doesn't pass its source's own cap is right
    levelled = summed.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("all_words") - F.col("before_cap")) / (F.col("all_weight") - F.col("before_weight")))
    right = levelled.filter("level <= full_at").agg(F.min_by("level", F.struct("full_at", "by_name")).alias("right_level"))
    target = F.least(F.col("cap"), F.coalesce(F.col("right_level") * F.col("weight"), F.col("cap")))
    return levelled.crossJoin(F.broadcast(right)).select("source", "source_size", *[c for c in sizes.columns if c not in ("source", "source_size")], "weight", target.alias("target"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the exclusive hash bound under which its rows' sizes come next to its budget: key and bound.

    rows: key (of the source), size, h (63-bit, from 0); budgets: key, n (rows of it), rest (below the source's
    size). A histogram of sizes by source and leading digit finds the bucket where the running sum passes the
    budget; only that bucket's rows go into the next, finer histogram, and so on LEVELS times. No rows are
    sorted, only bucket totals, 2 ** DIGIT_BITS a source at most. The last bucket is taken if that comes nearer.
    A source without any words has no bound.
    """
    found = budgets.select("key", "n", F.col("rest").cast("double").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = 63 - DIGIT_BITS * (level + 1)
        inside = spread_join(rows, found, "key", "n", ["h"]).filter(F.shiftright("h", shift + DIGIT_BITS) == F.col("prefix"))
        totals = inside.groupBy("key", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").cast("double").alias("size"))
        summed = totals.withColumn("up_to", F.sum("size").over(Window.partitionBy("key").orderBy("bucket")))
        passed = F.col("up_to") > F.col("rest")
        step = summed.groupBy("key", "rest").agg(
            F.min(F.when(passed, F.col("bucket"))).alias("edge"),
            F.min(F.when(passed, F.col("up_to"))).alias("above"),
            F.coalesce(F.max(F.when(~passed, F.col("up_to"))), F.lit(0.0)).alias("below"),
        ).filter(F.col("edge").isNotNull())
        if level < LEVELS - 1:
            step = step.join(found.select(F.col("key").alias("_key"), "n"), F.col("key") == F.col("_key"))
            found = step.select("key", "n", (F.col("rest") - F.col("below")).alias("rest"), F.col("edge").alias("prefix"))
        else:
            nearer = F.when(F.col("above") - F.col("rest") < F.col("rest") - F.col("below"), 1).otherwise(0)
            found = step.select("key", F.shiftleft(F.col("edge") + nearer, shift).alias("bound"))
        found = checkpointed(found)
    return found


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes.

    Returns id_col, size (words of the text; 0 for null or empty), source, source_size, target (of its
    source), copies (times that the document is taken, 0 to 2) and taken (= copies * size). Each source
    is taken whole as often as its target holds it; the rest of the target falls to the documents whose
    hash is under the source's bound, so that the source's words differ from its target by half of one
    document at most. The hash is of id, text and source: reruns and other partitionings agree. Rows equal in
    those, null ids included, are told apart by their place in the input, which decides only which of them are
    taken. A null source is a source. An empty table gives an empty one. Columns of other names are ignored.
    """
    rows = _drawn(docs, seed, id_col, text_col, source_col)
    copies = (F.col("whole") + (F.col("h") < F.col("bound")).cast("int")).cast("int")
    return spread_join(rows, _plan(rows, weights, budget, most), "key", "n", ["h"]).select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _draw(seed: int, id_col: str, text_col: str, source_col: str):
    return salted(F.xxhash64(F.lit(seed), named(id_col), F.xxhash64(named(text_col)), named(source_col)))


def _key(source):
    """A source's name, never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _drawn(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = named(source_col)
    return checkpointed(docs.select(named(id_col).alias("id"), source.alias("source"), _key(source).alias("key"), word_count(named(text_col)).alias("size"), _draw(seed, id_col, text_col, source_col).alias("h")))


def _plan(rows: DataFrame, weights, budget: float, most: float) -> DataFrame:
    """key, n, source_size, target, whole and bound: a row for each source of rows(source, key, size, h)."""
    sizes = rows.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = checkpointed(
        source_targets(sizes, weights, budget, most)
        .withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")) + F.lit(1e-12)), F.lit(0)))
        .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    )
    bounds = hash_thresholds(rows.select("key", "size", "h"), targets.filter("rest > 0")).withColumnRenamed("key", "_key")
    return targets.join(bounds, F.col("key") == F.col("_key"), "left").select("key", "n", "source_size", "target", "whole", F.coalesce("bound", F.lit(0)).alias("bound"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, all their columns, whatever their names, each row as often as `mix` takes it.

    Texts don't move where the plan is small: it is broadcast up to a checked number of sources.
    """
    rows = _drawn(docs, seed, id_col, text_col, source_col)
    plan = checkpointed(_plan(rows, weights, budget, most).select("key", "n", "whole", "bound"))
    marked = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), _key(named(source_col)).alias("key"), _draw(seed, id_col, text_col, source_col).alias("h"))
    copies = (F.col("whole") + (F.col("h") < F.col("bound")).cast("int")).cast("int")
    taken = spread_join(marked, plan, "key", "n", ["h"]).filter(copies > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
