"""Exact removal of repeated byte strings with distributed difference-cover suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skyobs.llm.distributed_suffixes import equal_prefixes
from skyobs.llm.runtime import HOT_SHARE, checkpointed, in_batches, named, partitions, remove_folder, shared_folder, spread_join
from skyobs.llm.suffix_array import suffix_array

#: Length of a repeated string, and of the grams of which each window of that length has one as its anchor.
LENGTH, GRAM = 100, 32
#: Bytes of text that are worked on at once, and bytes of contexts that are suffix-sorted together.
SLICE, SORTED_TOGETHER = 1 << 20, 1 << 20
#: Distinct contexts of an anchor up to which one task sorts their suffixes; those of more are sorted across the cluster.
TOGETHER = 24_000
#: One in so many documents tells which anchors are hot, which matters for how rows are dealt alone; parts that rows of one document are dealt to.
SAMPLED, SALTS = 64, 16
FIRST = -(1 << 63)


def _spread(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers by splitmix64."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


_BYTE, _OTHER, _LEVEL = _spread(256, 1), _spread(256, 7919), _spread(8, 104729)
_BASE = int(_spread(1, 31)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by running minima in blocks from both sides."""
    n = len(keys) - width + 1
    full = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(keys)] = keys
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def contexts(raw: np.ndarray, owner: np.ndarray, with_content: bool = True) -> tuple[np.ndarray, ...]:
    """Anchors of all LENGTH-byte windows of concatenated texts; owner names the text of each byte.

    A window's anchor is its gram of least hash, the leftmost of equal ones: a matter of the window's bytes
    alone, so equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a
    context. Returns each context's anchor hash, hash of its bytes (from its first window's start to its last
    one's end), first start and last start.
    """
    n, width = len(raw), LENGTH - GRAM + 1
    empty = np.zeros(0, np.uint64)
    if n < LENGTH:
        return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, size = _BYTE[raw], 1
    for level in _LEVEL:
        if size == GRAM:
            break
        h = h[:-size] * level + h[size:]
        size *= 2
    h = _mixed(h)
    low = np.uint64(0xFFFFFFFF)
    anchor = (_window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low).astype(np.int64)
    inside = np.flatnonzero(owner[: n - LENGTH + 1] == owner[LENGTH - 1 :])
    if not len(inside):
        return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    named = anchor[inside]
    cut = np.flatnonzero(named[1:] != named[:-1]) + 1
    first, last = inside[np.concatenate(([0], cut))], inside[np.concatenate((cut - 1, [len(inside) - 1]))]
    a = h[anchor[first]]
    if not with_content:
        return a, empty, first, last
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OTHER[raw] * power[:-1])))
    c = (total[last + LENGTH] - total[first]) * back[first] + (last - first).astype(np.uint64) * _LEVEL[0]
    return a, _mixed(c), first, last


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of about SLICE bytes: bytes, their texts' numbers, and by number where the slice starts in the text and in the bytes.

    A longer text is cut so that each window is in one slice.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(b) for _, _, b in parts])
        starts = np.cumsum(lengths) - lengths
        return np.frombuffer(b"".join(b for _, _, b in parts), np.uint8), np.repeat(np.arange(len(parts)), lengths), np.array([(k, at) for k, at, _ in parts]).reshape(-1, 2), starts

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), SLICE):
            part = text[at : at + SLICE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if parts and size + len(part) > SLICE:
                yield joined()
                parts, size = [], 0
            parts.append((k, at, part))
            size += len(part)
    if parts:
        yield joined()


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [contexts(raw, owner, False)[0] for raw, owner, _, _ in _pieces([t.encode() for t in batch.column(0).to_pylist()])]
        if found:
            a, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], names=["a", "n"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for raw, owner, origin, starts in _pieces([t.encode() for t in batch.column(2).to_pylist()]):
            a, c, first, last = contexts(raw, owner)
            if len(a):
                part = owner[first]
                text, place = origin[part, 0], first - starts[part] + origin[part, 1]
                p = place << 8 | (last - first)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(keys[text]), pa.array(tags[text]), pa.array(p)], names=["a", "c", "k", "tag", "p"])


#: What becomes of a context: all its windows start earlier elsewhere; some may; it is the first of a part of those with a hot anchor.
REPEATED, OPEN, HOT = 0, 1, 2


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of (by, hot, c, k, tag, p), where by is the anchor of all that aren't hot.

    Of equal contexts, which follow each other, the first stays and the others are REPEATED. A first one is OPEN if
    another context of its anchor comes before or after it; what has no neighbour of its anchor goes. Equal
    contexts of a hot anchor are dealt to several parts by keys of their own; the first of each part is HOT.
    """
    names = ["kind", "a", "c", "k", "tag", "p"]
    hot_before: tuple[int, int] | None = None
    before: tuple[int, int] | None = None  # anchor and context of the last row
    held: tuple | None = None  # the last first row, and whether it was told
    told = False
    for batch in batches:
        hot = batch.column(batch.schema.get_field_index("hot")).to_numpy(zero_copy_only=False)
        every = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names[1:]}
        parts = []

        def add(kind: int, rows: dict[str, np.ndarray]) -> None:
            if len(rows["a"]):
                parts.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(rows["a"]), kind, np.int32)), *(pa.array(rows[c]) for c in names[1:])], names=names))  # noqa: B023

        if hot.any():
            by, c = batch.column(batch.schema.get_field_index("by")).to_numpy()[hot], every["c"][hot]
            fresh = np.ones(len(by), bool)
            fresh[1:] = (by[1:] != by[:-1]) | (c[1:] != c[:-1])
            fresh[0] = hot_before != (by[0], c[0])
            hot_before = (by[-1], c[-1])
            add(HOT, {n: v[hot][fresh] for n, v in every.items()})
            add(REPEATED, {n: v[hot][~fresh] for n, v in every.items()})
            every = {c: v[~hot] for c, v in every.items()}
        a, c = every["a"], every["c"]
        if len(a):
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            fresh[0] = before != (a[0], c[0])
            before = (a[-1], c[-1])
            add(REPEATED, {n: v[~fresh] for n, v in every.items()})
            first = {n: v[fresh] for n, v in every.items()}
            if held is not None:
                first = {n: np.concatenate(([x], first[n])) for n, x in zip(names[1:], held, strict=True)}
            anchors = first["a"]
            if len(anchors):
                same = anchors[1:] == anchors[:-1]
                is_open = np.concatenate(([False], same)) | np.concatenate((same, [False]))
                if told:
                    is_open[0] = False
                add(OPEN, {n: v[is_open] for n, v in first.items()})
                told = bool(is_open[-1]) or (told and len(anchors) == 1)
                held = tuple(v[-1] for v in first.values())
        yield from parts


def _spans(k: np.ndarray, tag: np.ndarray, p: np.ndarray, of: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Runs of windows (context number, offset in it), in that order, as byte spans."""
    fresh = np.flatnonzero((of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1
    begin = np.concatenate(([0], fresh)).astype(np.int64)
    end = np.concatenate((fresh, [len(of)])).astype(np.int64) - 1
    base = (p >> 8)[of[begin]]
    return pa.RecordBatch.from_arrays(
        [pa.array(k[of[begin]]), pa.array(tag[of[begin]]), pa.array(base + offset[begin]), pa.array(base + offset[end] + LENGTH)], names=["k", "tag", "start", "end"]
    )


def _trimmed(k: np.ndarray, tag: np.ndarray, p: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Contexts cut to the stretch from their first to their last window whose hash occurs twice; those without one go.

    Equal windows have equal hashes, so no repeat is lost. Whether windows are equal is left to the sort.
    """
    lengths = np.array([len(c) for c in contents])
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(b"".join(contents), np.uint8)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), _BASE, np.uint64))))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), _INVERSE, np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OTHER[raw] * power[:-1])))
    counts = (p & 0xFF) + 1
    of = np.repeat(np.arange(len(p)), counts)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[of] + offset
    hashed = _mixed((total[at + LENGTH] - total[at]) * back[at])
    order = np.argsort(hashed)
    same = hashed[order[1:]] == hashed[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.flatnonzero(twice)
    if not len(hit):
        return k[:0], tag[:0], p[:0], []
    heads = np.flatnonzero(np.concatenate(([True], of[hit][1:] != of[hit][:-1])))
    tails = np.concatenate((heads[1:], [len(hit)])) - 1
    kept, low, high = of[hit[heads]], offset[hit[heads]], offset[hit[tails]]
    cut = [contents[i][a : b + LENGTH] for i, a, b in zip(kept.tolist(), low.tolist(), high.tolist(), strict=True)]
    return k[kept], tag[kept], ((p[kept] >> 8) + low) << 8 | (high - low), cut


def repeated_windows(k: np.ndarray, tag: np.ndarray, p: np.ndarray, contents: list[bytes]) -> pa.RecordBatch | None:
    """Spans of the windows of contexts that also start earlier among these contexts.

    The contexts, in the order of their places, are joined with separators and suffix-sorted. Neighbours in
    that order whose first LENGTH bytes are equal form groups, in which all but the earliest are repeated.
    """
    order = np.lexsort((p, tag, k))
    same = (k[order[1:]] == k[order[:-1]]) & (tag[order[1:]] == tag[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
    order = order[np.concatenate(([True], ~same))]  # of a repeated row, one copy: with more, its windows would all seem to start earlier
    k, tag, p = k[order], tag[order], p[order]
    contents = [contents[i] for i in order]
    k, tag, p, contents = _trimmed(k, tag, p, contents)
    if not contents:
        return None
    lengths = np.array([len(c) for c in contents])
    starts = np.cumsum(lengths + 1) - lengths - 1
    raw = np.frombuffer(b"\0".join([*contents, b""]), np.uint8)
    symbols = raw.astype(np.int64) + 2
    symbols[starts + lengths] = 1
    counts = (p & 0xFF) + 1
    is_window = np.zeros(len(raw), bool)
    of = np.repeat(np.arange(len(p)), counts)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = starts[of] + offset
    is_window[places] = True
    ranked = suffix_array(symbols)
    ranked = ranked[is_window[ranked]]
    views = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    equal = np.zeros(max(0, len(ranked) - 1), bool)
    for i in range(0, len(equal), 16384):
        pair = ranked[i : i + 16385]
        equal[i : i + 16384] = (views[pair[:-1]] == views[pair[1:]]).all(axis=1)
    heads = np.concatenate(([0], np.flatnonzero(~equal) + 1))
    earliest = np.minimum.reduceat(ranked, heads)
    again = np.ones(len(raw), bool)
    again[earliest] = False
    hit = np.flatnonzero(again[places])
    return _spans(k, tag, p, of[hit], offset[hit]) if len(hit) else None


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sort runs of rows with one anchor, several small ones at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(upto: pa.Table) -> Iterator[pa.RecordBatch]:
        if upto.num_rows > 1:
            found = repeated_windows(upto["k"].to_numpy(), upto["tag"].to_numpy(), upto["p"].to_numpy(), upto["content"].to_pylist())
            if found is not None:
                yield found

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= SORTED_TOGETHER:
            table = pa.Table.from_batches(held)
            a = table["a"].to_numpy()
            cut = int(np.flatnonzero(a != a[-1])[-1]) + 1 if a[0] != a[-1] else 0  # the last anchor's rows may go on
            if cut:
                yield from flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
    if held:
        yield from flush(pa.Table.from_batches(held))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, k, tag, p, content, large) of the contexts that are wanted of each text: rows of (k, tag, text, wanted)."""
    for batch in batches:
        a, k, tags, p, contents = [], [], [], [], []
        large = []
        for key, tag, text, wanted in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "tag", "text", "wanted")), strict=True):
            raw = text.encode()
            for w in wanted:
                at = w["p"] >> 8
                a.append(w["a"])
                large.append(w["large"])
                k.append(key)
                tags.append(tag)
                p.append(w["p"])
                contents.append(raw[at : at + (w["p"] & 0xFF) + LENGTH])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(k, pa.int64()), pa.array(tags, pa.int64()), pa.array(p, pa.int64()), pa.array(contents, pa.binary()), pa.array(large, pa.bool_())], names=["a", "k", "tag", "p", "content", "large"])


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings for the distributed sort: bytes plus 1, and an end that is the piece's own."""
    for batch in batches:
        made = [np.concatenate((np.frombuffer(c, np.uint8).astype(np.int64) + 1, [257 + n])).tobytes() for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["piece", "symbols"])


def _sorted_across(cut: DataFrame) -> DataFrame:
    """Spans (k, tag, start, end) of the windows of contexts cut(a, k, tag, p, content) that also start earlier among them, by the distributed suffix sort.

    Windows whose first LENGTH bytes are equal make a run, in which all but the earliest are repeated. Long runs are spread.
    """
    pieces = checkpointed(cut.withColumn("piece", F.monotonically_increasing_id()))
    if pieces.isEmpty():
        return pieces.select("k", "tag", F.col("p").alias("start"), F.col("p").alias("end"))
    runs = equal_prefixes(pieces.select("piece", "content").mapInArrow(_symbols, "piece long, symbols binary"), LENGTH)
    # a piece has at most 69 windows, so no key of this join is hot
    windows = checkpointed(runs.join(pieces.select("piece", "k", "tag", "p"), "piece").select("run", "k", "tag", (F.shiftright("p", 8) + F.col("at")).alias("start")))
    first = windows.groupBy("run").agg(F.min(F.struct("k", "tag", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = spread_join(windows, checkpointed(first), "run", "n", ["k", "tag", "start"]).filter(F.struct("k", "tag", "start") > F.col("first"))
    return later.select("k", "tag", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(text: DataFrame) -> DataFrame:
    """k, tag and spans: per text the byte spans covered by LENGTH-byte strings that also start earlier.

    text has k (the order of documents), tag (tells texts of one k apart) and text, and no two rows are equal in k and tag.

    1. Each window is represented by its anchor; a context is a stretch of windows with one anchor. Contexts are
       dealt by anchor, each row once, and sorted there. Equal ones (64 bits of hash of the anchor and as many of
       the context) follow each other: all but the first are repeated. Contexts whose anchor no other
       has can't hold a repeated window and go. Hot anchors, told by a sample, are dealt by anchor, context and
       one of SALTS parts; the first contexts of the parts, few rows, then meet.
    2. Different contexts that share their anchor may still have some windows in common. Their suffixes are sorted
       by the difference-cover algorithm and neighbours' first LENGTH bytes compared: in the task that the
       anchor is dealt to, or, if it has more than TOGETHER of them, across the cluster. Equal windows have
       equal anchors, so no match is lost between tasks.
    """
    spark = text.sparkSession
    schema = "a long, c long, k long, tag long, p long"
    some = text.filter(F.pmod(F.xxhash64("k", "tag"), F.lit(SAMPLED)) == 0).select("text")
    counts = checkpointed(in_batches(some, _anchor_counts, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")))
    seen = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(8, seen // HOT_SHARE)).select(F.col("a").alias("hot_a"))
    marked = in_batches(text, _context_rows, schema).join(F.broadcast(hot), F.col("a") == F.col("hot_a"), "left").withColumn("hot", F.col("hot_a").isNotNull())
    # a hot anchor's rows are dealt to many tasks, those of one context to SALTS
    dealt = marked.withColumn("by", F.when(F.col("hot"), F.xxhash64("a", "c", F.pmod(F.xxhash64("k", "tag", "p"), F.lit(SALTS)))).otherwise(F.col("a"))).select("by", "hot", *schema.replace(" long", "").split(", "))
    judged = dealt.repartition(partitions(spark), "by").sortWithinPartitions("by", "hot", "c", "k", "tag", "p").mapInArrow(_judge, f"kind int, {schema}")
    folder = shared_folder(spark, "contexts")
    judged.write.parquet(folder)
    found = spark.read.schema(f"kind int, {schema}").parquet(folder)

    whole = lambda rows: rows.select("k", "tag", F.shiftright("p", 8).alias("start"), (F.shiftright("p", 8) + F.col("p").bitwiseAND(F.lit(0xFF)) + LENGTH).alias("end"))
    hots = found.filter(F.col("kind") == HOT).select(F.struct("a", "c").alias("ac"), "k", "tag", "p")
    firsts = checkpointed(hots.groupBy("ac").agg(F.min(F.struct("k", "tag", "p")).alias("first"), F.count(F.lit(1)).alias("n")))
    later = spread_join(hots, firsts.filter("n > 1"), "ac", "n", ["k", "tag", "p"]).filter(F.struct("k", "tag", "p") > F.col("first"))
    open_ones = found.filter(F.col("kind") == OPEN).select("a", "k", "tag", "p").unionByName(firsts.select("ac.a", "first.k", "first.tag", "first.p"))
    sizes = open_ones.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    large = checkpointed(sizes.filter(F.col("n") > TOGETHER).withColumn("large", F.lit(True)))
    placed = spread_join(open_ones, large, "a", "n", ["k", "tag", "p"]).withColumn("large", F.coalesce("large", F.lit(False)))
    wanted = placed.groupBy("k", "tag").agg(F.collect_list(F.struct("a", "p", "large")).alias("wanted"))
    cut = in_batches(text.join(wanted, ["k", "tag"]), _contents, "a long, k long, tag long, p long, content binary, large boolean")
    every = whole(found.filter(F.col("kind") == REPEATED)).unionByName(whole(later))
    if not large.isEmpty():
        cut = checkpointed(cut)
        every = every.unionByName(_sorted_across(cut.filter("large")))
    small = cut.filter("not large").select("a", "k", "tag", "p", "content").repartition(partitions(spark), "a").sortWithinPartitions("a")
    every = every.unionByName(small.mapInArrow(_sort_groups, "k long, tag long, start long, end long"))
    spans = checkpointed(every.groupBy("k", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    remove_folder(spark, folder)
    return spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs shrunk to code point borders, so that what is left is UTF-8."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """k, tag, text and others (a struct of all other columns) of docs, and whether all ids differ.

    k is the id; nulls come first. If all ids differ, tag is 0; else it is a hash of the text that is checked to
    tell all texts of one id apart, and another one is taken if it doesn't.
    """
    k = F.coalesce(named(id_col).cast("long"), F.lit(FIRST)).alias("k")
    text = F.coalesce(named(text_col), F.lit("")).alias("text")
    others = F.struct(*[named(c) for c in docs.columns if c != text_col]).alias("others")
    if docs.select(k).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.select(k, F.lit(0).cast("long").alias("tag"), text, others), True
    for seed in range(8):
        tag = F.xxhash64(F.lit(seed), text).alias("tag")
        told = docs.select(k, tag, F.md5(text).alias("other")).groupBy("k", "tag").agg(F.min("other").alias("low"), F.max("other").alias("high"))
        if told.filter("low != high").isEmpty():
            return docs.select(k, tag, text, others), False
    raise RuntimeError("no hash tells the texts of one id apart")


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, tag, text, others (all columns but the text) and spans (of repeated_spans, null where there are none) for each row.

    Rows equal in id and text are one document; one of them stands for all, and each gets its spans. Rows of
    one document are dealt to SALTS parts to meet them.
    """
    wide, distinct = _keyed(docs, id_col, text_col)
    if distinct:
        return wide.join(repeated_spans(wide.select("k", "tag", "text")), ["k", "tag"], "left")
    once = checkpointed(wide.groupBy("k", "tag").agg(F.min("text").alias("text")))
    spans = repeated_spans(once).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = wide.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return salted.join(spans, ["k", "tag", "salt"], "left").drop("salt")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a LENGTH-byte string that also starts earlier, and digest what is left.

    Earlier: in a document of smaller id, or in the same one at an earlier byte; judged on the input alone,
    within documents. Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256. A null
    text counts as empty. Null ids come first; rows of one id are ordered by a hash of their texts; rows
    equal in both are one document, and each gets its result. Other columns are ignored; an empty table
    gives an empty one. Ids are whole numbers.
    """
    joined = _with_spans(docs.select(named(id_col), named(text_col)), id_col, text_col).select("k", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "text", "spans")), strict=True):
                raw = text.encode()
                runs = merged(spans or [])
                rows.append((None if key == FIRST else key, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(raw, runs)).hexdigest()))
            if rows:
                types = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = in_batches(joined, run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs, all their columns, with what `digests` removes cut from the texts, at code point borders.

    Texts of which nothing is left go, as do null and empty ones. count_col, if docs has it, gets the new length.
    """
    others = [c for c in docs.columns if c != text_col]
    joined = _with_spans(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "spans")), strict=True):
                raw = text.encode()
                texts.append(without(raw, whole_characters(raw, merged(spans or []))).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(batch.schema.get_field_index("others"))], names=["text", "others"])

    schema = StructType([StructField("text", StringType()), joined.schema["others"]])
    out = in_batches(joined.select("text", "spans", "others"), run, schema).filter("text != ''")
    made = {c: F.col("others").getField(c) for c in others} | {text_col: F.col("text")}
    if count_col in docs.columns:
        made[count_col] = F.length("text").cast(docs.schema[count_col].dataType)
    return out.select(*[made[c].alias(c) for c in docs.columns])
