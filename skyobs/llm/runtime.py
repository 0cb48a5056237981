"""What the operators share: the checkpoint folder, bounded Arrow batches, dealing and column names."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes in an Arrow batch that goes to a Python worker; both bound the worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: A key with over one in so many of all rows is hot: there can't be more hot keys than this, so they are broadcast.
HOT_SHARE = 2_000
#: Rows of a compacted table that a partition holds.
ROWS_IN_PART = 100_000
#: Rows up to which a counted table of a row a key is broadcast whole.
SMALL = 10_000
#: Bits of the largest estimated size that a checkpointed table keeps: those of Spark's own for a table of unknown size.
ESTIMATE_BITS = 63


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage and kept in the folder that the cluster names in spark.checkpoint.dir.

    Partitions and the order of rows within them stay. See _checkpoint_dir for sessions without that setting.
    """
    _checkpoint_dir(df.sparkSession)
    return _estimated(df.checkpoint())


def _estimated(kept: DataFrame) -> DataFrame:
    """A checkpointed table whose estimated size is Spark's for an unknown one if it was larger; rows, partitions and order stay.

    A checkpoint takes over the estimate of the plan that made it, and a join's is mostly the product of its sides'. So
    in rounds that join a table with what was made of it, the estimate's digits multiply in each round: after a few,
    the numbers alone fill the driver's heap. Either size is far beyond any bound of the planner.
    """
    spark, plan = kept.sparkSession, kept._jdf.queryExecution().logical()
    try:
        if plan.stats().sizeInBytes().bit_length() <= ESTIMATE_BITS:
            return kept
    except ValueError:  # over 4,300 digits, which Python doesn't read
        pass
    jvm = spark._jvm
    unknown = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
        spark._jsparkSession, jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()),
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, unknown), spark)


def compacted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A checkpointed table in as many partitions as its rows need, ROWS_IN_PART each, and no more than it has: what reads it makes no files for empty ones."""
    count = df.count() if rows is None else rows
    return df.coalesce(max(1, -(-count // ROWS_IN_PART)))


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run), where run sees slices of at most BATCH_ROWS rows and about BATCH_BYTES bytes.

    The batches that cross to the worker keep the session's own bounds (64 MB by Spark's default); what run
    makes of a slice is what takes the memory.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
            for k in range(0, batch.num_rows, step):
                yield batch.slice(k, step)

    return df.mapInArrow(lambda batches: run(sliced(batches)), schema)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, salt: list[Column | str]) -> DataFrame:
    """rows, left-joined by `key` to keyed, which has one row a key: its number of rows, `count`, and other columns.

    Up to SMALL keys are broadcast. Of more, those with over one HOT_SHARE-th of all rows, HOT_SHARE at most, are
    broadcast, and their rows are dealt by a hash of salt, so no key's rows meet in one task. Null keys match
    nothing and are dealt alike. salt has to be the same whenever a row is made again.
    """
    others = [c for c in keyed.columns if c not in (key, count)]
    keys, total = keyed.agg(F.count(F.lit(1)), F.sum(count)).first()
    if keys <= SMALL:
        small = keyed.select(F.col(key).alias("_small_key"), *others)
        return rows.join(F.broadcast(small), F.col(key) == F.col("_small_key"), "left").select(*rows.columns, *others)
    is_hot = F.col(count) > max(1, total // HOT_SHARE)
    hot = keyed.filter(is_hot).select(F.col(key).alias("_hot_key"), F.struct(*others).alias("_hot"))
    cold = keyed.filter(~is_hot).select(F.col(key).alias("_cold_key"), F.xxhash64(key).alias("_at"), F.struct(*others).alias("_cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("_by", F.when(alone, F.xxhash64(*salt)).otherwise(F.xxhash64(key)))
    found = marked.join(cold, (F.col("_by") == F.col("_at")) & (F.col(key) == F.col("_cold_key")), "left")
    return found.select(*rows.columns, *[F.coalesce(F.col("_hot").getField(c), F.col("_cold").getField(c)).alias(c) for c in others])


def _below(bounds: list[int], value: Column, strict: bool) -> Column:
    """How many of the sorted bounds are below value (or up to it), asking about twice the root of their number."""
    step = max(1, math.isqrt(len(bounds)))
    pieces = [bounds[k : k + step] for k in range(0, len(bounds), step)] or [[]]
    passed = (lambda b: b < value) if strict else (lambda b: b <= value)
    whole = F.size(F.filter(F.array(*[F.lit(p[-1]) for p in pieces if p]).cast("array<bigint>"), passed))
    piece = F.coalesce(F.get(F.array(*[F.array(*[F.lit(b) for b in p]).cast("array<bigint>") for p in pieces]), whole), F.array().cast("array<bigint>"))
    return whole * step + F.size(F.filter(piece, passed))


def in_buckets(rows: DataFrame, key: str, tie: str, n: int) -> DataFrame:
    """rows with `bucket`, from 0 to n - 1: ascending in (key, tie), two bigint columns without nulls, and of about equal counts.

    Bounds are approximate quantiles of key. A key that holds several of them is split by quantiles of its ties,
    so it can hold any share of the rows. Deal the buckets with repartitionById, which gives each a task of its own.
    """
    bounds = sorted(rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or [])[: n - 1]
    bucket = _below(bounds, F.col(key), True)
    held = {b: c for b, c in Counter(bounds).items() if c > 1}
    if not held:
        return rows.withColumn("bucket", bucket)
    spark = rows.sparkSession
    hot = spark.createDataFrame(list(held.items()), "_hot_key long, _times int")  # fewer than n rows
    ties = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key")).groupBy("_hot_key", "_times").agg(F.percentile_approx(tie, [k / 256 for k in range(1, 256)], 10_000).alias("_at"))
    ties = ties.select("_hot_key", F.transform(F.sequence(F.lit(1), "_times"), lambda j: F.get("_at", F.greatest(F.lit(0), (j * 256 / (F.col("_times") + 1)).cast("int") - 1))).alias("_at"))
    passed = F.coalesce(F.size(F.filter("_at", lambda b: b <= F.col(tie))), F.lit(0))
    found = rows.join(F.broadcast(ties), F.col(key) == F.col("_hot_key"), "left")
    return found.select(*rows.columns, F.least(F.lit(n - 1), bucket + F.when(F.col("_hot_key").isNotNull(), passed).otherwise(0)).alias("bucket"))


def salted(hashed: Column, bits: int = 24) -> Column:
    """A hash, from 0, whose low-order bits tell equal rows apart by their place in the input."""
    low = (1 << bits) - 1
    place = F.xxhash64(F.lit(5), F.monotonically_increasing_id()).bitwiseAND(F.lit(low))
    return F.shiftrightunsigned(hashed, 1).bitwiseAND(F.lit(~low)).bitwiseOR(place)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle parallelism."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(prefix: str, columns: Iterable[str]) -> str:
    """A column name that begins with prefix and that none of columns has, in any case of letters."""
    taken, name = {c.lower() for c in columns}, prefix
    while name.lower() in taken:
        name += "_"
    return name


def named(column: str) -> Column:
    """The top-level column of exactly this name, dots and back ticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, for a table that an operator writes."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_folder named, in whichever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting, a session of one machine gets a temporary folder; any other raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named_one = context.getConf().get("spark.checkpoint.dir")
        master = context.master
        if named_one is None and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named_one or tempfile.mkdtemp(prefix="skyobs-checkpoint-"))
    return context.getCheckpointDir()
