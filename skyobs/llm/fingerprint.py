"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyobs.llm.runtime import in_buckets, partitions, salted

#: Words in a shingle, bins (a power of two), low-order bits kept of each bin's minimum.
SHINGLE, BIN_BITS, KEPT_BITS = 5, 7, 8
BINS = 1 << BIN_BITS
#: Words are runs of other characters than space and the ASCII controls 9 to 13.
GAP = "[\\x20\\x09-\\x0D]+"
#: Stands for a null id in the order of ids: nulls come first.
FIRST = -(1 << 63)


#: Bins that an empty bin asks one after the other; after that many empty ones, all bins are ranked.
PROBES = 48


def let(value: Column, body) -> Column:
    """body of value as a name for it: evaluated once, however the optimizer rearranges projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def shingle_hashes(word_hashes: Column, shingle: int = SHINGLE) -> Column:
    """Sorted 64-bit hashes of all shingles of an array of hashed words.

    Fewer words than a shingle has: the whole sequence is one; no words: the empty sequence is one.
    """
    w = word_hashes
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)])))


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def bin_minima(h: Column) -> Column:
    """The least hash of each bin that has one. A bin is the leading bits, so in sorted hashes each bin's first is its least."""
    return F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))


def densified(minima: Column, bins: Column) -> Column:
    """BINS signed bytes: the low-order bits of each bin's minimum.

    An empty bin asks other bins in an order of its own, by a universal hash of its number and the step,
    until one is full, and takes that one's value: the same order for every document. If PROBES bins are
    empty, the full bin that a hash of both numbers ranks first gives the value.
    """
    low = (1 << KEPT_BITS) - 1
    rank = lambda k: lambda x: F.xxhash64(k, bin_of(x)).bitwiseAND(F.lit(~low)).bitwiseOR(x.bitwiseAND(F.lit(low)))
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    at = F.transform(every, lambda k: F.get(minima, F.array_position(bins, k).cast("int") - 1))

    def fill(full: Column) -> Column:
        probe = lambda k, t: F.get(full, F.xxhash64(k, F.lit(t)).bitwiseAND(F.lit(BINS - 1)).cast("int"))
        value = lambda k: F.coalesce(F.get(full, k), *[probe(k, t) for t in range(PROBES)], F.array_min(F.transform(minima, rank(k))))
        return F.transform(every, lambda k: (value(k).bitwiseAND(F.lit(low)) - (low + 1) // 2).cast("tinyint"))

    return let(at, fill)


def packed(text: Column) -> Column:
    """The packed fingerprint of a text: BINS bytes."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return let(hashed, lambda w: let(shingle_hashes(w), lambda h: let(bin_minima(h), lambda m: let(F.transform(m, bin_of), lambda b: densified(m, b)))))


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the column `name`: the packed fingerprint of the text column."""
    return rows.withColumn(name, packed(F.col(text)))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1.

    Low-order bits of different minima agree by chance in one of 2**KEPT_BITS cases; the share of equal bins is corrected for that.
    """
    chance = 1.0 / (1 << KEPT_BITS)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def as_hex(name: str) -> Column:
    """Two lower-case hex digits a bin."""
    offset = 1 << KEPT_BITS - 1
    return F.lower(F.array_join(F.transform(F.col(name), lambda v: F.lpad(F.hex(v.cast("int") + offset), 2, "0")), ""))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, key, tie, bucket and last (whether the row only stands after its bucket's end).

    Buckets are ranges of (key, tie) of about equal counts, as many as shuffle partitions: key is the id, tie a hash of
    the text that also tells equal rows apart, so an id that many rows share takes several buckets. The first
    row of each bucket also goes to the bucket before, and the very first to the last one, so that a window
    within a bucket sees every document's follower.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("key"), salted(F.xxhash64(text)).alias("tie"))
    placed = in_buckets(slim, "key", "tie", partitions(spark))
    # a row for each bucket
    firsts = sorted((r["bucket"], *r["least"]) for r in placed.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("least")).collect())
    ahead = spark.createDataFrame([(k, t, firsts[i - 1][0]) for i, (_, k, t) in enumerate(firsts)], "_key long, _tie long, _before int")  # the first's is the last: firsts[-1]
    met = placed.join(F.broadcast(ahead), (F.col("key") == F.col("_key")) & (F.col("tie") == F.col("_tie")), "left")
    both = F.array(F.struct("bucket", F.lit(False).alias("last")), F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("last"))))
    return met.select("id", "text", "key", "tie", F.inline(F.array_compact(both)))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited forms, and their likeness.

    The edited text: the last quarter of the code points (rounded down) replaced by as many from the start
    of the next document by ascending id, or all it has; after the last comes the first. Returns id_col,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Ids are whole numbers.
    A null text counts as empty. Null ids come first; equal ids follow each other in the order of a hash of
    their texts, equal rows in any; all rows are kept. A single document is its own follower. Columns of other
    names are ignored; an empty table gives an empty one.
    Texts are shuffled once, a bucket to a task; everything after stays there.
    """
    n = partitions(docs.sparkSession)
    spec = Window.partitionBy("bucket").orderBy("last", "key", "tie")
    followed = in_order(docs, id_col, text_col).repartitionById(n, "bucket").withColumn("following", F.lead("text").over(spec))
    n_chars = F.length("text")
    quarter = F.floor(n_chars / 4).cast("int")
    edited = followed.withColumn("edited", F.concat(F.substring("text", F.lit(1), n_chars - quarter), F.substring(F.coalesce("following", F.lit("")), F.lit(1), quarter)))
    kept = edited.select("id", "key", "tie", "bucket", "last", "text", "edited", n_chars.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    marked = with_fingerprint(with_fingerprint(kept, "text", "fp"), "edited", "fp_edited").withColumn("fp_next", F.lead("fp").over(spec))
    return marked.filter(~F.col("last")).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_hex("fp").alias("fingerprint"), as_hex("fp_edited").alias("edited_fingerprint"),
        likeness("fp", "fp_edited").alias("near_edited"), likeness("fp", "fp_next").alias("near_next"),
    )
