"""SimHash near-duplicates by an inverted index on byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyobs.llm.components import components
from skyobs.llm.runtime import checkpointed, compacted, in_batches, named, spread_join

#: Words in a shingle, seed of the hash, most differing bits of a link.
SHINGLE, SEED, BITS = 3, 42, 3
#: Eight byte positions; a link's differing bits lie in BITS of them at most, so it shares SHARED positional bytes at least.
POSITIONS, SHARED = 8, 8 - BITS
#: The positions in two groups of four. Of SHARED positions three lie in one group, so LISTED of one group make a list.
GROUPS, LISTED = (range(4), range(4, 8)), 3
#: A list of more fingerprints is split by a further position.
LONG = 1 << 12
CHUNK = 1 << 14
#: Near copies: words in a shingle and least Jaccard similarity, as a fraction.
NEAR_SHINGLE, SIMILAR = 5, (4, 5)
#: Lists that a text stands in, minima that make a list, shingles that are hashed BANDS * BAND times at once.
BANDS, BAND, MINED = 30, 6, 1 << 12
#: Most rounds in which the members of a list are compared with one of them, before those still apart are compared pairwise;
#: pairs for each member from which on another such round comes first; pairs with one text that go to one task.
ROUNDS, DENSE, TOGETHER = 6, 8, 2_000
_RANDOM = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (2, BANDS * BAND), np.uint64)
_ODD, _PLUS = _RANDOM[0] | np.uint64(1), _RANDOM[1]
_FOLD, _PLACE = _RANDOM[1, :BAND] | np.uint64(1), _RANDOM[1, -BANDS:]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes; zero without words."""
    words = (text or "").encode().lower().split()  # bytes.lower: A to Z alone; bytes.split: at space and 9 to 13
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest, ends = xxhash.xxh64_intdigest, []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col and fp (the fingerprint's 64 bits as a signed bigint) for every whole text."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return in_batches(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def tally(x: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes are equal, from exclusive ors."""
    return POSITIONS - np.count_nonzero(x.view(np.uint8).reshape(*x.shape, POSITIONS), axis=-1)


def _masks(free: int) -> np.ndarray:
    """All 64-bit masks of one to BITS bits within the bits set in free."""
    bits = [1 << k for k in range(64) if free >> k & 1]
    return np.array([sum(c) for n in range(1, BITS + 1) for c in combinations(bits, n)], np.uint64)


def _forest(values: np.ndarray, free: int) -> Iterator[tuple[int, int]]:
    """Links between sorted distinct fingerprints of one list, less those that a forest of the others implies.

    Shared positional bytes are tallied for each pair; pairs with enough of them are verified bit by bit. Only a
    list whose SHARED bytes are all fixed can be LONG: no tally in it is too low, so its members are looked up
    under every mask of few bits in the free bytes instead.
    """
    n = len(values)
    parent = np.arange(n)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = int(parent[k])
        return k

    def join(left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)

    if n <= LONG:
        for k in range(n - 1):
            x = values[k + 1 :] ^ values[k]
            near = np.flatnonzero(tally(x) >= SHARED)
            near = near[np.bitwise_count(x[near]) <= BITS]
            if len(near):
                join(np.full(len(near), k), near + k + 1)
    else:
        for mask in _masks(free):
            other = values ^ mask
            at = np.minimum(np.searchsorted(values, other), n - 1)
            hit = np.flatnonzero((values[at] == other) & (at > np.arange(n)))
            join(hit, at[hit])
    for k in range(n):
        if (r := root(k)) != k:
            yield k, r


def _bytes_of(positions: tuple[int, ...]) -> int:
    """The mask of the bytes at some positions, as a signed number."""
    mask = sum(0xFF << 8 * k for k in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _listed(rows: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """(fp, place, bytes): each fingerprint once under each choice of positions; place is the mask of the choice."""
    entry = [F.struct(F.lit(_bytes_of(c)).alias("place"), F.col("fp").bitwiseAND(F.lit(_bytes_of(c))).alias("bytes")) for c in choices]
    return rows.select("fp", F.inline(F.array(*entry)))


def index_lists(nodes: DataFrame) -> DataFrame:
    """The index: (fp, place, bytes) such that any two fingerprints with SHARED equal positional bytes meet in a list.

    Lists are made by LISTED positions of one group. Members of a list of over LONG go on to lists of one more
    position, any of the others: two of them that share SHARED bytes in all share one of those. Lists of SHARED
    positions aren't split. Lists are counted by partial aggregates, and long ones are spread where they are split.
    """
    lists = checkpointed(_listed(nodes, [c for g in GROUPS for c in combinations(g, LISTED)]))
    done, width = None, LISTED
    while True:
        counted = lists.groupBy("place", "bytes").agg(F.count(F.lit(1)).alias("n"))
        if width == SHARED or (counted.agg(F.max("n")).first()[0] or 0) <= LONG:
            return lists if done is None else done.unionByName(lists)
        long = checkpointed(counted.filter(F.col("n") > LONG).select(F.xxhash64("place", "bytes").alias("at"), F.col("place").alias("long_place"), F.col("bytes").alias("long_bytes"), "n"))
        met = spread_join(lists.withColumn("at", F.xxhash64("place", "bytes")), long, "at", "n", ["fp"]).withColumn("split", (F.col("place") == F.col("long_place")) & (F.col("bytes") == F.col("long_bytes")))
        met = checkpointed(met.select("fp", "place", "bytes", F.coalesce("split", F.lit(False)).alias("split")))
        short = met.filter("not split").drop("split")
        done = short if done is None else done.unionByName(short)
        further = []
        for k in range(POSITIONS):
            byte = F.lit(_bytes_of((k,)))
            wider = F.col("place").bitwiseOR(byte)
            further.append(F.when(F.col("place").bitwiseAND(byte) == 0, F.struct(wider.alias("place"), F.col("fp").bitwiseAND(wider).alias("bytes"))))
        lists = checkpointed(met.filter("split").select("fp", F.inline(F.array_compact(F.array(*further)))).distinct())
        width += 1


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints nodes(fp), enough of them to connect all that are within BITS bits.

    A pair within BITS bits shares SHARED of its POSITIONS positional bytes, and so meets in a list of index_lists.
    Lists are sorted into runs. In the task, the shared positional bytes of a run's pairs are tallied, pairs that
    reach the guaranteed minimum are verified bit by bit, and a union-find keeps a forest: as many links as
    fingerprints at most leave it, never all pairs. There is no cap. A run holds 8 bytes a fingerprint.
    """
    dealt = index_lists(nodes).repartition("place", "bytes").sortWithinPartitions("place", "bytes", "fp")
    everything = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key = None

        def flush() -> Iterator[tuple[int, int]]:
            if held_key is not None:
                values = np.unique(np.concatenate(held))
                if len(values) > 1:
                    for k, r in _forest(values, everything & ~held_key[0]):
                        yield int(values[k].view(np.int64)), int(values[r].view(np.int64))

        for batch in batches:
            out: list[tuple[int, int]] = []
            fp, place, key = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("fp", "place", "bytes"))
            fp = fp.view(np.uint64)
            if not len(fp):
                continue
            edges = np.flatnonzero((place[1:] != place[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(fp)]))
            long = np.flatnonzero(ends - starts > 1)
            inner = set(long.tolist()) | {0, len(starts) - 1}
            for k in sorted(inner):
                name = (int(place[starts[k]]), int(key[starts[k]]))
                if name != held_key:
                    out += flush()
                    held, held_key = [], name
                held.append(fp[starts[k] : ends[k]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        if out := list(flush()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp and component_id (the smallest id that links reach, its own included) for every document.

    Equal fingerprints are one node of the graph, however many documents have them, so the work on links
    grows with distinct fingerprints, and those that very many documents have are spread over tasks. Texts without words have fingerprint zero and are linked like others.
    A null id counts for no minimum; a component of null ids alone has a null component_id. Repeated ids and
    rows are all kept; columns of other names are ignored; an empty table gives an empty one.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col)).withColumn("salt", F.monotonically_increasing_id())
    nodes = checkpointed(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(nodes.select("fp")))
    rooted = checkpointed(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named_ones = checkpointed(spread_join(rooted.select("fp", "n", "root"), checkpointed(smallest), "root", "m", ["fp"]).select("fp", "n", "component_id"))
    return spread_join(marked, named_ones, "fp", "n", ["salt"]).select(id_col, "fp", "component_id")


def minima(text: str | None) -> tuple[int, int, np.ndarray]:
    """A hash of the text's words, the SimHash of its distinct shingles of NEAR_SHINGLE words, and BANDS hashes of BAND minima each over them."""
    words = (text or "").encode().lower().split()
    hashes = np.fromiter(shingles(words), np.uint64)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), MINED):
        part = hashes[k : k + MINED]
        np.minimum(least, (part[:, None] * _ODD + _PLUS).min(axis=0), out=least)
        bits += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    banded = (least.reshape(BANDS, BAND) * _FOLD).sum(axis=1, dtype=np.uint64) + _PLACE
    banded = (banded ^ (banded >> np.uint64(31))) * _ODD[0]
    return xxhash.xxh64_intdigest(b" ".join(words), SEED), int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big"), banded.view(np.int64)


def shingles(words: list[bytes]) -> set[int]:
    """Hashes of the runs of NEAR_SHINGLE words; fewer words are one run, no words the empty run."""
    return {xxhash.xxh64_intdigest(b" ".join(words[k : k + NEAR_SHINGLE]), SEED) for k in range(max(1, len(words) - NEAR_SHINGLE + 1))}


def alike(a: str | None, b: str | None) -> bool:
    """Whether the Jaccard similarity of two texts' shingles is SIMILAR at least."""
    x, y = (shingles((t or "").encode().lower().split()) for t in (a, b))
    return len(x & y) * SIMILAR[1] >= len(x | y) * SIMILAR[0]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts(node, text) are alike. The text of a b with very many pairs goes to several tasks."""
    pairs = compacted(checkpointed(pairs))
    counted = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    most = counted.agg(F.max("n")).first()[0]
    if most is None:
        return pairs
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    if most <= TOGETHER:
        met = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    else:
        many = checkpointed(counted.withColumn("parts", F.ceil(F.col("n") / TOGETHER).cast("int")).filter("parts > 1"))
        dealt = spread_join(pairs, many, "b", "n", ["a"]).withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int"))
        copies = two.join(many.select("b", "parts"), "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        met = dealt.join(one, "a").join(copies, ["b", "part"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text_a", "text_b"))
            yield batch.select(["a", "b"]).filter(pa.array([alike(x, y) for x, y in zip(left, right, strict=True)], pa.bool_()))

    return checkpointed(in_batches(met, run, "a long, b long"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text (a hash of the text) and root for every document: roots are equal in each group that pairs of similar texts connect.

    Similar: Jaccard similarity of word shingles of SIMILAR at least, verified on the texts. Candidates are the
    links of op 7's index over SimHashes of the shingles, and texts that share one of BANDS hashes of BAND minima:
    texts at that similarity are some ten bits apart, too many for the index alone, while they share no list
    once in 9,000 times. Texts of equal words are one node. While there are over DENSE times as many pairs as
    members in lists of several groups, at most ROUNDS times, each such list's members are compared with the
    one of them that stands in the longest lists, the likely original of its copies; then pairs of a list that
    are still in different groups are compared, all of them. So lists of one group, however long, take time
    in proportion to their length, and there is no cap.
    """
    hashed = F.xxhash64(F.coalesce(named(text_col), F.lit("")))
    slim = docs.select(named(id_col).alias("_id"), hashed.alias("_text"), named(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, bands = zip(*map(minima, batch.column(2).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(nodes), long(prints), pa.array(list(bands), pa.list_(pa.int64()))], names=["_id", "_text", "node", "fp", "bands"])

    marked = checkpointed(in_batches(slim, run, f"_id {slim.schema['_id'].dataType.simpleString()}, _text long, node long, fp long, bands array<long>"))
    # a row a node, by partial aggregates; equal nodes have equal bands and prints
    nodes = compacted(checkpointed(marked.groupBy("node").agg(F.min("_text").alias("_text"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("n"))))
    listed = nodes.select("node", F.explode("bands").alias("band"))
    lists = checkpointed(listed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("length", F.col("n")))
    members = compacted(checkpointed(spread_join(listed, lists, "band", "n", ["node"]).filter("length is not null")))
    weights = members.groupBy("node").agg(F.sum("length").alias("weight"))

    prints = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")))
    same_print = spread_join(nodes.select("node", "fp"), prints.filter("n > 1"), "fp", "n", ["node"]).filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    of_print = lambda c: prints.select(F.col("fp").alias(f"fp_{c}"), F.col("least").alias(c))
    linked = links(prints.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(of_print("a"), "fp_a").join(of_print("b"), "fp_b").select("a", "b")
    by_index = checkpointed(same_print.unionByName(linked).distinct())

    wanted = members.select("node").unionByName(by_index.select(F.col("a").alias("node"))).unionByName(by_index.select(F.col("b").alias("node"))).distinct()
    once = slim.groupBy("_text").agg(F.min("text").alias("text"))
    texts = checkpointed(once.join(nodes.join(wanted, "node").select("node", "_text"), "_text").select("node", "text"))

    found = _verified(by_index, texts)
    pivots = None
    for turn in range(ROUNDS + 1):
        rooted = members.join(components(found), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        sizes = compacted(checkpointed(rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low != high")))
        pairs, open_members = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum("n")).first()
        if not open_members:
            break
        final = turn == ROUNDS or pairs <= DENSE * open_members
        left = compacted(checkpointed(spread_join(rooted, sizes, "band", "n", ["node"]).filter("low is not null").select("band", "node", "root")), open_members)
        if not final:
            open_ones = left if pivots is None else left.join(pivots, (left["band"] == pivots["pivot_band"]) & (left["node"] == pivots["pivot"]), "left_anti")
            chosen = open_ones.join(weights, "node").groupBy("band").agg(F.max_by(F.struct("node", "root"), F.struct("weight", "node")).alias("p"))
            chosen = compacted(checkpointed(chosen.join(left.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "band").select("band", "n", F.col("p.node").alias("pivot"), F.col("p.root").alias("pivot_root"))))
            used = chosen.select(F.col("band").alias("pivot_band"), "pivot")
            pivots = used if pivots is None else compacted(checkpointed(pivots.unionByName(used)))
            tried = spread_join(left, chosen, "band", "n", ["node"]).filter("root != pivot_root").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        else:
            tried = left.select("band", F.col("node").alias("a"), F.col("root").alias("root_a")).join(left.select("band", F.col("node").alias("b"), F.col("root").alias("root_b")), "band").filter("a < b and root_a != root_b").select("a", "b")
        found = compacted(checkpointed(found.unionByName(_verified(tried.distinct(), texts))))
        if final:
            break
    roots = checkpointed(nodes.select("node", "n").join(components(found), "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")))
    return spread_join(marked.select("_id", "_text", "node", F.monotonically_increasing_id().alias("_salt")), roots, "node", "n", ["_salt"]).select("_id", "_text", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all its columns, of each of `similar_groups`: that of the smallest id.

    Null ids come last. Of rows of one id, that of the least hash of its text stays, and of rows that are
    equal in both, that of the least hash of the other columns.
    """
    found = similar_groups(docs, id_col, text_col)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text")).alias("least"))
    kept = checkpointed(least.select(F.col("least._id").alias("_kept_id"), F.col("least._text").alias("_kept")))
    others = [named(f.name) for f in docs.schema.fields if f.name != text_col and "map<" not in f.dataType.simpleString()]
    row = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("_row"), F.xxhash64(*others).alias("_rest"), named(id_col).alias("_own"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("_text"))
    once = row.groupBy("_own", "_text").agg(F.min_by("_row", "_rest").alias("_row"))
    stay = once.join(kept, (F.col("_text") == F.col("_kept")) & F.col("_own").eqNullSafe(F.col("_kept_id")), "left_semi")
    return stay.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
