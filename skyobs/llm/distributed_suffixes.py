"""The difference-cover suffix sort (modulo 3) across a cluster, for many strings that each end in a symbol of their own.

A string is a row (piece, symbols): symbols are packed little-endian 64-bit numbers from 1 on, and the last one occurs
nowhere else, in no string. So no comparison of two suffixes passes an end, and what a task needs to know about
a suffix's neighbours lies within its string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyobs.llm.runtime import checkpointed, partitions

#: Suffixes that are merged in one task, and most splitters that deal them.
MERGED, SPLITTERS = 1 << 19, 2_000


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, one string after the other, and the strings' lengths."""
    sizes = np.array([len(x) // 8 for x in column.to_pylist()], np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.int64), sizes


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each of consecutive stretches."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _ahead(values: np.ndarray, at: np.ndarray, lengths: np.ndarray, by: int) -> np.ndarray:
    """The value `by` places on in the same string; 0 past its end."""
    out = np.zeros(len(values), np.int64)
    out[: len(values) - by] = values[by:]
    out[at + by >= lengths] = 0
    return out


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, sizes = _numbers(batch.column(1))
        at, lengths, piece = _inside(sizes), np.repeat(sizes, sizes), np.repeat(batch.column(0).to_numpy(), sizes)
        sampled = at % 3 != 0
        columns = [s, _ahead(s, at, lengths, 1), _ahead(s, at, lengths, 2), piece, at]
        yield pa.RecordBatch.from_arrays([pa.array(c[sampled]) for c in columns], names=["t0", "t1", "t2", "piece", "at"])


def numbered_runs(ordered: DataFrame, keys: list[str], kept: str) -> tuple[DataFrame, int, int]:
    """Rows of `kept` columns and `run`, a number from 1 that grows with each change of keys in the global order.

    ordered is checkpointed: its partitions, one after the other, are in order. Each partition tells its first
    and last keys and how many changes it has; their prefix sums, and whether a partition goes on with the
    key that the one before ended with, give each partition's first number. Returns the runs and rows, too.
    """

    def fresh_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            fresh = np.zeros(batch.num_rows, bool)
            for c in columns:
                values = c.to_numpy(zero_copy_only=False)
                fresh[1:] |= values[1:] != values[:-1]
            fresh[0] = before is None or before != [c[0].as_py() for c in columns]
            before = [c[-1].as_py() for c in columns]
            yield batch, fresh

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        part = runs = rows = 0
        for batch, fresh in fresh_ones(batches):
            part = batch.column(batch.schema.get_field_index("_part"))[0].as_py()
            edge = lambda k: {c: batch.column(batch.schema.get_field_index(c))[k].as_py() for c in keys}  # noqa: B023, E731
            first, last = first or edge(0), edge(-1)
            runs, rows = runs + int(fresh.sum()), rows + batch.num_rows
        if rows:
            yield pa.RecordBatch.from_pylist([{"part": part, "runs": runs, "n": rows, "first": first, "last": last}], schema=ends_schema)

    slim = ordered.select(*keys)
    key_type = pa.struct([pa.field(k, {"bigint": pa.int64(), "binary": pa.binary()}[slim.schema[k].dataType.simpleString()]) for k in keys])
    ends_schema = pa.schema([("part", pa.int32()), ("runs", pa.int64()), ("n", pa.int64()), ("first", key_type), ("last", key_type)])
    inner = ", ".join(f"{k}: {slim.schema[k].dataType.simpleString()}" for k in keys)
    numbered = ordered.withColumn("_part", F.spark_partition_id())
    told = numbered.select(*keys, "_part").mapInArrow(ends, f"part int, runs long, n long, first struct<{inner}>, last struct<{inner}>").collect()  # a row a partition
    offsets, total, rows, last = {}, 0, 0, None
    for r in sorted(told, key=lambda r: r["part"]):
        offsets[r["part"]] = total - (last == r["first"])
        total, rows, last = offsets[r["part"]] + r["runs"], rows + r["n"], r["last"]

    names = kept.split()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch, fresh in fresh_ones(batches):
            if at is None:
                at = offsets[batch.column(batch.schema.get_field_index("_part"))[0].as_py()]
            run = at + np.cumsum(fresh)
            at = int(run[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(run)], names=[*names, "run"])

    schema = ", ".join(f"{c} {ordered.schema[c].dataType.simpleString()}" for c in names) + ", run long"
    return numbered.mapInArrow(number, schema), total, rows


def _packed(values: DataFrame, name: str, reorder: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(piece, name): the values of (piece, at, run) packed for each piece, in the order of `reorder` of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            piece, at, value = (table[c].to_numpy() for c in ("piece", "at", "run"))
            order = np.lexsort((reorder(at), piece))
            piece, value = piece[order], value[order].astype(np.int64)
            edges = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1], [True])))
            raw = value.tobytes()
            return pa.RecordBatch.from_arrays([pa.array(piece[edges[:-1]]), pa.array([raw[8 * a : 8 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["piece", name])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            piece = table["piece"].to_numpy()
            cut = int(np.searchsorted(piece, piece[-1]))  # the last piece may go on
            if cut:
                yield flush(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    n = partitions(values.sparkSession)
    return values.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(run, f"piece long, {name} binary")


def _sample_order(at: np.ndarray) -> np.ndarray:
    """Places that are 1 modulo 3 before those that are 2."""
    return at % 3 << 40 | at


def _tuples(prefix: int) -> Callable:
    """Each suffix with what comparing it with any other takes: its class (place modulo 3), two symbols, two ranks, its own rank.

    With `prefix`, only suffixes of at least so many symbols before the end, and their first symbols as bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, sizes = _numbers(batch.column(1))
            ranks, _ = _numbers(batch.column(2))
            at, lengths, piece = _inside(sizes), np.repeat(sizes, sizes), np.repeat(batch.column(0).to_numpy(), sizes)
            own = np.zeros(len(s), np.int64)
            own[np.lexsort((_sample_order(at), np.repeat(np.arange(len(sizes)), sizes)))[_order_of_samples(at, sizes)]] = ranks
            columns = {"class": at % 3, "s0": s, "s1": _ahead(s, at, lengths, 1), "r1": _ahead(own, at, lengths, 1), "r2": _ahead(own, at, lengths, 2), "own": own, "piece": piece, "at": at}
            wanted = np.flatnonzero(at + prefix < lengths) if prefix else np.arange(len(s))
            arrays = [pa.array(c[wanted]) for c in columns.values()]
            if prefix:
                low = np.minimum(s, 257).astype(np.uint16)
                views = np.lib.stride_tricks.sliding_window_view((low - 1).astype(np.uint8), prefix) if len(s) >= prefix else np.zeros((0, prefix), np.uint8)
                arrays.append(pa.array([v.tobytes() for v in views[wanted]], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *(["prefix"] if prefix else [])])

    return run


def _order_of_samples(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where, among all places of the strings ordered by _sample_order within each, the sampled ones stand: all but those of class 0, which come first."""
    zeros = -(-sizes // 3)
    return np.flatnonzero(_inside(sizes) >= np.repeat(zeros, sizes))


def _coded(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Small numbers in the same order as the values, as far as comparing them with the known (sorted, distinct) ones goes."""
    at = np.searchsorted(known, values)
    return 2 * at + (known[np.minimum(at, len(known) - 1)] == values)


def _buckets(rows: DataFrame, suffixes: int) -> tuple[DataFrame, int]:
    """rows with `bucket`, ascending in the order of suffixes: splitters are sampled suffixes, whose order is known, at equal distances."""
    count = int(min(SPLITTERS, suffixes // MERGED))
    n_sampled = rows.agg(F.max("own")).first()[0] or 0
    marks = sorted({n_sampled * j // (count + 1) for j in range(1, count + 1)} - {0})
    if not marks:
        return rows.withColumn("bucket", F.lit(0)), 1
    found = sorted((r.own, r["class"], r.s0, r.s1, r.r1, r.r2) for r in rows.filter(F.col("own").isin(marks)).select("own", "class", "s0", "s1", "r1", "r2").collect())  # SPLITTERS rows at most
    own = np.array([f[0] for f in found])
    symbols = np.unique([x for f in found for x in f[2:4]])
    ones, twos = ([f for f in found if f[1] == c] for c in (1, 2))
    # by its class a splitter is compared with a suffix of class 0 by a symbol and a rank, or by two symbols and a rank
    key_one = np.sort((_coded(np.array([f[2] for f in ones], np.int64), symbols) << 48) | np.array([f[4] for f in ones], np.int64))
    pair = lambda s0, s1: _coded(s0, symbols) * (2 * len(symbols) + 2) + _coded(s1, symbols)
    pairs = np.unique(pair(np.array([f[2] for f in twos], np.int64), np.array([f[3] for f in twos], np.int64))) if twos else np.zeros(1, np.int64)
    key_two = np.sort((_coded(pair(np.array([f[2] for f in twos], np.int64), np.array([f[3] for f in twos], np.int64)), pairs) << 48) | np.array([f[5] for f in twos], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, s0, s1, r1, r2, mine = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("class", "s0", "s1", "r1", "r2", "own"))
            below = np.searchsorted(key_one, _coded(s0, symbols) << 48 | r1) + np.searchsorted(key_two, _coded(pair(s0, s1), pairs) << 48 | r2)
            bucket = np.where(kind == 0, below, np.searchsorted(own, mine, "right"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int32))], names=[*batch.schema.names, "bucket"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", bucket int"
    return rows.mapInArrow(run, schema), len(own) + 1


def merge_order(kind: np.ndarray, s0: np.ndarray, s1: np.ndarray, r1: np.ndarray, r2: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The order of a bucket's suffixes: sampled ones are in the order of their ranks, and each finds how many of class 0 come before it."""
    zero, sampled = np.flatnonzero(kind == 0), np.flatnonzero(kind)
    zero = zero[np.lexsort((r1[zero], s0[zero]))]
    sampled = sampled[np.argsort(own[sampled])]
    before = np.zeros(len(sampled), np.int64)
    for c, keys in ((1, (r1, s0)), (2, (r2, s1, s0))):
        mine = np.flatnonzero(kind[sampled] == c)
        both = np.concatenate((zero, sampled[mine]))
        order = np.lexsort(tuple(k[both] for k in keys))
        passed = np.cumsum(order < len(zero))
        theirs = order >= len(zero)
        before[mine[order[theirs] - len(zero)]] = passed[theirs]
    out = np.empty(len(kind), np.int64)
    places = before + np.arange(len(sampled))
    out[places] = sampled
    rest = np.ones(len(kind), bool)
    rest[places] = False
    out[rest] = zero
    return out


def _merged(strings: DataFrame, ranks: DataFrame, suffixes: int, prefix: int = 0) -> DataFrame:
    """All suffixes (or those with a prefix) in their order: partition after partition, a bucket of about MERGED each; checkpointed."""
    schema = "class long, s0 long, s1 long, r1 long, r2 long, own long, piece long, at long" + (", prefix binary" if prefix else "")
    known = strings.join(ranks, "piece", "left").select("piece", "symbols", F.coalesce("ranks", F.lit(b"")).alias("ranks"))
    rows, buckets = _buckets(known.mapInArrow(_tuples(prefix), schema), suffixes)
    kept = ["piece", "at", *(["prefix"] if prefix else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(held)
            order = merge_order(*(table[c].to_numpy() for c in ("class", "s0", "s1", "r1", "r2", "own")))
            yield from table.select(kept).take(pa.array(order)).to_batches(max_chunksize=10_000)

    dealt = rows.repartitionById(buckets, "bucket")
    return checkpointed(dealt.mapInArrow(run, "piece long, at long" + (", prefix binary" if prefix else "")))


def _ranks(strings: DataFrame) -> DataFrame:
    """(piece, ranks): of the sampled places of each string, in the order of _sample_order, packed.

    Triples are sorted by ranges and named. Unless all names differ, the strings of names are the next level's
    strings: their suffixes are ordered in the same way, and that order is the rank. Every string ends in a
    symbol of its own, so names of triples with it are unique, and levels end once names span the longest string.
    """
    n, schema = partitions(strings.sparkSession), "t0 long, t1 long, t2 long, piece long, at long"
    keys = ["t0", "t1", "t2"]
    # a name of many triples is split over ranges by piece and place
    ordered = checkpointed(strings.mapInArrow(_triples, schema).repartitionByRange(n, *keys, "piece", "at").sortWithinPartitions(*keys, "piece", "at"))
    named, names, rows = numbered_runs(ordered, keys, "piece at")
    if names == rows:
        return checkpointed(_packed(named, "ranks", _sample_order))
    deeper = checkpointed(_packed(named, "symbols", _sample_order))
    order = _merged(deeper, _ranks(deeper), rows)
    placed, _, _ = numbered_runs(order, ["piece", "at"], "piece at")
    return checkpointed(_packed(placed, "ranks", lambda at: at))


def equal_prefixes(strings: DataFrame, prefix: int) -> DataFrame:
    """(piece, at, run): suffixes of strings (symbols: bytes plus 1, an end of its own) with at least `prefix` bytes; run is equal where those bytes are.

    The suffixes are sorted, and the first bytes of neighbours are compared, across partitions by the last row
    of the one before.
    """
    strings = checkpointed(strings)
    suffixes = strings.agg(F.sum(F.octet_length("symbols") / 8)).first()[0] or 0
    order = _merged(strings, _ranks(strings), int(suffixes), prefix)
    return numbered_runs(order, ["prefix"], "piece at")[0]
