"""Operators on documents against brute force, on small fixtures with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyobs.llm import distributed_suffixes, fingerprint, kneser_ney, language_id, mixing, sentencepiece_bpe, sharding, simhash, suffix_dedup
from skyobs.llm.components import components
from skyobs.llm.queries import tokenizer_path
from skyobs.llm.runtime import checkpointed
from skyobs.llm.suffix_array import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use inside
CLASH = ["id", "size", "k", "tag", "a", "b", "u", "v", "h", "shard", "perplexity", "fp", "good", "kept", "name", "row", "copy", "key", "bucket", "last"]


def corpus(seed=0, n=60):
    g = random.Random(seed)
    words = ["".join(g.choice("etaoinshr") for _ in range(g.randint(1, 7))) for _ in range(80)]
    line = " ".join(g.choice(words) for _ in range(40))
    rows = []
    for k in range(n):
        text = " ".join(g.choice(words) for _ in range(g.randint(0, 90)))
        if k % 4 == 1:
            text = text[: len(text) // 2] + " " + line + " " + text[len(text) // 2 :]
        if k % 7 == 2 and rows:
            text = rows[k // 2][1]
        if k % 9 == 5 and rows and rows[k - 3][1]:
            text = rows[k - 3][1].replace("e", "E", 1)
        rows.append((1000 - 7 * k if k % 2 else 3 * k, text, g.choice(["en", "fr", None]), g.choice(["b", "a", None, "é"]), None))
    rows += [(5000, None, None, None, None), (5001, "", "en", "a", 0), (5002, "ab " * 400, "en", "a", None), (5003, "zß🙂 ▁x\n" * 90, "fr", "b", None), (5003, "ein", "fr", "b", None), (5003, "ein", "fr", "b", None), (None, "no id here", None, "a", None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("x") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return (row[0] is not None, row[0] or 0)


def test_shards(docs, rows, empty):
    got = sharding.byte_shards(docs, 8).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(8))
    order = [key((r.doc_id,)) for k in range(8) for r in sorted(by[k], key=lambda r: r.slot)]
    assert order == sorted(order)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes, most = [sum(r.size for r in v) for v in by.values()], max(r.size for r in got)
    assert max(sizes) - min(sizes) <= 2 * most
    assert sharding.byte_shards(empty).count() == 0


def filled(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Targets by handing the excess on until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], count(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    want = filled(sizes)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(r.size for r in got if r.source == s)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.mix(empty).count() == 0
    nulls = [(None, f"{k} " * 50, None, "b", None) for k in range(200)] + [(None, "same " * 50, None, "c", None)] * 200 + [(9, "x " * 50, None, "d", None)] * 100
    sums = mixing.mix(docs.sparkSession.createDataFrame(nulls, "doc_id long, text string, lang string, source string, n_chars long")).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("s")).collect()
    assert len(sums) == 3 and all(abs(r.t - r.s) <= 50 for r in sums)
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("x`y", F.lit(3))
    assert mixing.mixed_rows(odd).columns == odd.columns and mixing.mixed_rows(odd).count() == sum(r.copies for r in got)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in Counter(i for r in got for i in [r.doc_id] * r.copies).items()})


def test_many_sources(spark, monkeypatch):
    """Targets and thresholds of more sources than are broadcast."""
    from skyobs.llm import runtime

    monkeypatch.setattr(runtime, "SMALL", 5)
    rows = [(k, "w " * (k % 17), f"s{k % 40}" if k % 41 else None) for k in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = filled(sizes)
    assert len(got) == 2000 and all(r.target == pytest.approx(want[r.source]) for r in got)
    assert all(abs(taken[s] - t) <= 16 for s, t in want.items())


def test_targets_refill():
    assert filled({"a": 10, "b": 100, "c": 100})["a"] == 20


def test_simhash(docs, rows, empty):
    def brute(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    fps = [brute(r[1]) for r in rows]
    assert [simhash.fingerprint(r[1]) for r in rows] == fps
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), r[0])
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((r[0], least.get(find(k))) for k, r in enumerate(rows))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.doc_id == r.component_id}


def test_links_of_long_lists(spark, monkeypatch):
    """Lists of any length give the same components as comparing all pairs, and the tally turns pairs of a list away."""
    g = np.random.default_rng(3)
    base = int(g.integers(1 << 62))
    fps = {base}
    while len(fps) < 300:
        f = list(fps)[int(g.integers(len(fps)))]
        for b in g.integers(0, 64, 4):
            f ^= 1 << int(b)
        fps.add(f)
    # share three bytes of a group and no others: candidates of a list whose tally is too low
    fps |= {base & 0xFFFFFF | int(x) << 24 for x in g.integers(0, 1 << 39, 60)}
    fps = sorted(fps)
    signed = lambda v: [((int(f) - (1 << 64)) if int(f) >> 63 else int(f),) for f in v]
    df = spark.createDataFrame(signed(fps), "fp long")
    want = len(_classes(fps))
    values = np.array(fps, np.uint64)
    assert len(fps) - len(list(simhash._forest(values, (1 << 64) - 1))) == want
    low = np.array([f for f in fps if f & 0xFFFFFF == base & 0xFFFFFF], np.uint64)
    assert (simhash.tally(low[1:] ^ low[0]) < simhash.SHARED).sum() > 20
    for most in (1 << 12, 20, 2):
        monkeypatch.setattr(simhash, "LONG", most)
        lists = simhash.index_lists(df)
        widths = {bin(r.place & (1 << 64) - 1).count("1") // 8 for r in lists.select("place").distinct().collect()}
        assert widths == {4096: {3}, 20: {3, 4}, 2: {3, 4, 5}}[most]
        linked = components(simhash.links(df))
        assert len(fps) - linked.count() + linked.select("root").distinct().count() == want
    free = 0xFFFFFF
    near = np.unique(np.array([base & ~free | int(x) for x in g.integers(0, 1 << 12, 300)], np.uint64))
    assert len(near) - len(list(simhash._forest(near, free))) == len(_classes(near.tolist()))


def test_hot_fingerprints_and_hubs(spark, monkeypatch):
    """With every key hot or cold instead of broadcast: empty texts, copies and a hub are spread and lose nothing."""
    from skyobs.llm import runtime

    monkeypatch.setattr(runtime, "SMALL", 0)
    monkeypatch.setattr(runtime, "HOT_SHARE", 4)
    rows = [(None if k % 3 else k, "" if k % 2 else "the same few words") for k in range(120)] + [(200 + k, f"text {k} of its own kind {k * k}") for k in range(20)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.component_id for r in got) == Counter({0: 60, 3: 60}) + Counter(200 + k for k in range(20))
    star = [(0, k) for k in range(1, 200)] + [(k, 1000 + k) for k in range(1, 200)]
    found = components(spark.createDataFrame(star, "a long, b long")).collect()
    assert len(found) == 399 and {r.root for r in found} == {0}


def _classes(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3:
                root[find(i)] = find(j)
    return {find(i) for i in range(len(fps))}


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 90, 90: 90}


def test_estimates_stay_small(spark):
    """Rounds that join a checkpointed table with itself: its estimated size stays bounded; rows, partitions and their order stay."""
    found = spark.range(100).select(F.col("id").alias("a"))
    for _ in range(12):
        made = found.join(found.select(F.col("a").alias("b"), (F.col("a") * 2).alias("c")), F.col("a") == F.col("b")).select("a").repartition(3, "a").sortWithinPartitions("a")
        found = checkpointed(made)
        plan = found._jdf.queryExecution().optimizedPlan()
        assert plan.stats().sizeInBytes() < 1 << 63
    plain = made.checkpoint()._jdf.queryExecution().optimizedPlan()
    assert [re.sub(r"#\d+", "", x.toString()) for x in (plan.outputPartitioning(), plan.outputOrdering())] == [re.sub(r"#\d+", "", x.toString()) for x in (plain.outputPartitioning(), plain.outputOrdering())]
    parts = [[r.a for r in p] for p in found.rdd.glom().collect()]
    assert len(parts) == 3 and all(p == sorted(p) for p in parts) and sorted(sum(parts, [])) == list(range(100))


def brute_repeats(rows):
    def order(r):
        t = r[1] or ""
        return (r[0] if r[0] is not None else -(1 << 63),)

    seen, out = set(), []
    for r in sorted(rows, key=order):
        raw = (r[1] or "").encode()
        hit = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                hit[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        out.append((r[0], len(raw), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together", [24_000, 1])
def test_repeats(docs, rows, empty, together, monkeypatch):
    """In tasks, and with every anchor's contexts sorted across the cluster in several buckets."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(distributed_suffixes, "MERGED", 500)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    got = [tuple(r) for r in suffix_dedup.digests(docs).collect()]
    assert Counter(got) == Counter(brute_repeats(rows))
    assert suffix_dedup.digests(empty).count() == 0


@pytest.mark.parametrize("together", [24_000, 1])
def test_repeats_of_repeated_rows_and_null_ids(spark, together, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    g = random.Random(5)
    some = lambda n: "".join(g.choice("etaoinshr ") for _ in range(n))
    removed = lambda rows: [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    shared = some(300)
    one, two = (1, some(60) + "<" + shared + ">" + some(60)), (2, some(50) + "[" + shared[20:] + "]" + some(70))
    assert sorted(removed([one, one, two, one])) == [(1, 422, 0)] * 3 + [(2, 402, 280)]
    # null ids, one text of which agrees with another one in the last 23 bits of its hash
    p, q = some(200), some(200)
    hashed = spark.range(20_000).select(F.concat(F.when(F.col("id") % 2 == 0, p).otherwise(q), F.lit("#"), F.col("id")).alias("text"), (F.col("id") % 2).alias("kind"), F.xxhash64("text").bitwiseAND(F.lit((1 << 23) - 1)).alias("h"))
    first = hashed.filter("kind = 0").orderBy("h").first().text
    ps, qs = hashed.filter("kind = 0").select("h", F.col("text").alias("p")), hashed.filter("kind = 1").select("h", F.col("text").alias("q"))
    clash = ps.join(qs, "h").filter(F.col("p") != first).orderBy("h").first()
    got = removed([(None, first), (None, clash.p), (None, clash.q)])
    assert sorted(r[2] for r in got) == [0, 0, 201] and (None, len(clash.q), 0) in got


def test_distributed_suffix_order(spark, monkeypatch):
    """The order of all suffixes equals sorting them, with repetitive strings, short ones and several merge buckets."""
    monkeypatch.setattr(distributed_suffixes, "MERGED", 40)
    g = random.Random(2)
    pieces = [bytes(g.choice(b"ab") for _ in range(g.randint(0, 40))) for _ in range(25)] + [b"a" * 60, b"a" * 61, b"ab" * 40, b"", b"x"]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(pieces)], "piece long, content binary")
    strings = checkpointed(df.mapInArrow(suffix_dedup._symbols, "piece long, symbols binary"))
    symbols = [[b + 1 for b in c] + [257 + k] for k, c in enumerate(pieces)]
    want = sorted(((k, i) for k, s in enumerate(symbols) for i in range(len(s))), key=lambda x: symbols[x[0]][x[1] :])
    order = distributed_suffixes._merged(strings, distributed_suffixes._ranks(strings), len(want))
    runs, n, rows = distributed_suffixes.numbered_runs(order, ["piece", "at"], "piece at")
    assert [(r.piece, r.at) for r in sorted(runs.collect(), key=lambda r: r.run)] == want and n == rows == len(want)
    assert order.rdd.getNumPartitions() > 3
    groups = defaultdict(set)
    for r in distributed_suffixes.equal_prefixes(strings, 7).collect():
        groups[r.run].add((r.piece, r.at))
    brute = defaultdict(set)
    for k, c in enumerate(pieces):
        for i in range(len(c) - 6):
            brute[c[i : i + 7]].add((k, i))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_hot_anchors_and_copies(spark, monkeypatch):
    """One passage in nearly all texts, many null ids, and long rows that are repeated: equal to brute force."""
    from skyobs.llm import runtime

    g = random.Random(9)
    some = lambda n: "".join(g.choice("etaoinshr ") for _ in range(n))
    passage = some(260)
    texts = [some(g.randint(0, 120)) + passage[g.randint(0, 40) :] + some(g.randint(0, 90)) for _ in range(150)]
    rows = [(k if k % 3 else None, t) for k, t in enumerate(texts)] + [(None, texts[0])] * 40 + [(7, texts[5])] * 40
    order = {t: h for t, h in ((r[0], r[1]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64(F.lit(0), "t")).collect())}
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, order[r[1]]))
    want = dict(zip(distinct, [x[2:] for x in brute_repeats([(k, t) for k, (_, t) in enumerate(distinct)])]))
    for share, small in ((2_000, 10_000), (50, 0)):
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
        monkeypatch.setattr(suffix_dedup, "SAMPLED", 2)
        monkeypatch.setattr(runtime, "SMALL", small)
        got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert Counter((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r[0], *want[r]) for r in rows)


def test_repeats_cut_at_characters(spark):
    long = "".join(chr(0x100 + k) + "🙂" for k in range(120))
    df = spark.createDataFrame([(1, "a" + long, 9), (2, "b" + long + "tail", 9), (3, long, 9)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(df).collect()}
    assert got[1].text == "a" + long and got[2].n_chars == len(got[2].text) and got[2].text.endswith("tail")
    assert len(got[2].text) < 12 and 3 not in got


def test_suffix_array():
    g = random.Random(0)
    for _ in range(400):
        a = [g.randint(1, g.choice([1, 2, 3, 250])) for _ in range(g.randint(0, 70))]
        assert suffix_array(np.array(a, np.int64)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])


def test_tokens_match_the_library(docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = sentencepiece_bpe.tokenized(docs, tokenizer_path()).collect()
    want = Counter((r[0], tuple(sp.encode(r[1] or "", add_bos=True, add_eos=True))) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(list(r.ids)).encode()).hexdigest()
    assert sentencepiece_bpe.encode_decode(empty, tokenizer_path()).count() == 0


def test_tokens_of_odd_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    c = sentencepiece_bpe.Codec(sentencepiece_bpe.model_bytes(tokenizer_path()))
    g, letters = random.Random(1), " \n\t▁aAbeé0119.,!中文字🙂\x00́ßthe in ing"
    for k in range(600):
        x = "".join(g.choice(letters) for _ in range(g.randint(0, 60))) if k % 2 else g.choice([" ", "ab", "in", "x", "=", "1"]) * g.randint(1, 200) + g.choice(letters) * 9
        want = sp.encode(x, add_bos=True, add_eos=True)
        assert c.encode(x) == want
        assert c.decode(want) == sp.decode(want) == c.both(x)[1]
        ids = [g.randrange(32000) if g.random() < 0.5 else g.randrange(300) for _ in range(8)]
        assert c.decode(ids) == sp.decode(ids)


def brute_print(text):
    """The packed fingerprint by definition: one permutation, bins by leading bits, empty ones filled by probing."""
    chained = lambda seed, *parts: seed if not parts else chained(xxhash.xxh64_intdigest(parts[0], seed), *parts[1:])
    int32, int64 = (lambda v: v.to_bytes(4, "little")), (lambda v: v.to_bytes(8, "little"))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    w = [int64(xxhash.xxh64_intdigest(x, 42)) for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    least = {}
    for i in range(max(1, len(w) - 4)):
        h = chained(42, *w[i : i + 5])
        b = h >> 64 - fingerprint.BIN_BITS
        least[b] = min(least.get(b, h), h)
    out = []
    for k in range(fingerprint.BINS):
        asked = (chained(42, int32(k), int32(t)) % fingerprint.BINS for t in range(fingerprint.PROBES))
        at = next((b for b in [k, *asked] if b in least), None)
        value = least[at] if at is not None else min((signed(chained(42, int32(k), int32(b)) & ~255 | h & 255) for b, h in least.items()))
        out.append(value & 255)
    return bytes(out)


def likeness_of(x, y):
    equal = sum(a == b for a, b in zip(x, y)) / len(x)
    return max(0.0, (equal - 1 / 256) / (1 - 1 / 256))


def test_fingerprints(spark, docs, rows, empty):
    check_fingerprints(docs, rows)
    assert fingerprint.edited_pairs(empty).count() == 0
    # an id, and one row of it, that hold most rows: several buckets
    hot = [(None, f"some words of text {k % 50} and more", None, None, None) for k in range(300)] + [(7, "the very same row", None, None, None)] * 300 + [(k, f"other {k}", None, None, None) for k in range(40)]
    check_fingerprints(spark.createDataFrame(hot, SCHEMA).repartition(3), hot)


def check_fingerprints(docs, rows):
    got = fingerprint.edited_pairs(docs).collect()
    hashes = {r[0]: (r[1] & (1 << 64) - 1) >> 25 for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("t")).distinct().collect()}
    ordered = sorted(rows, key=lambda r: (*key(r), hashes[r[1] or ""]))
    texts = [r[1] or "" for r in ordered]
    prints = {t: brute_print(t) for t in set(texts)}
    want = Counter()
    for k, t in enumerate(texts):
        q, after = len(t) // 4, texts[(k + 1) % len(texts)]
        edited = t[: len(t) - q] + after[:q]
        p = prints.setdefault(edited, brute_print(edited))
        want[(ordered[k][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[t].hex(), p.hex(), round(likeness_of(prints[t], p), 9), round(likeness_of(prints[t], prints[after]), 9))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_likeness_is_unbiased(spark):
    g = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    pairs, truth = [], []
    for k in range(40):
        a = [g.choice(words) for _ in range(400)]
        cut = g.randint(0, 400)
        b = a[:cut] + [g.choice(words) for _ in range(400 - cut)]
        s = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        pairs.append((" ".join(a), " ".join(b)))
        truth.append(len(s(a) & s(b)) / len(s(a) | s(b)))
    df = spark.createDataFrame(pairs, "x string, y string")
    got = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "x", "fx"), "y", "fy").select(fingerprint.likeness("fx", "fy")).collect()
    err = np.array([r[0] for r in got]) - truth
    assert abs(err.mean()) < 0.02 and np.abs(err).max() < 0.15


def language_rows():
    g = random.Random(2)
    sounds = {"xx": "ka ki ku ta ti tu".split(), "yy": "schl ung heit ver ge".split(), "zz": "ção mente de os são".split()}
    return [(k, "".join(g.choice(sounds[lang]) + g.choice(["", " "]) for _ in range(g.randint(5, 60))), lang) for k in range(400) for lang in [g.choice("xyz") * 2]]


def test_language_accuracy(spark):
    df = spark.createDataFrame(language_rows() + [(900, None, "xx"), (901, "123 !? ² ½ ① Ⅷ _", "yy"), (902, "", None), (None, "kakitu tiku", None)], "doc_id long, text string, lang string")
    clash = df.withColumns({c: F.lit("x") for c in ("id", "hash", "chars", "n", "most")})
    got = language_id.predict(clash, language_id.train(clash)).join(df.select(F.col("doc_id").alias("d"), "lang"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert next(r for r in got if r.doc_id is None).lang_pred == "xx"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    none = language_id.predict(df, language_id.train(df.limit(0)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def brute_grams(text):
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text]
    return {tuple(low[i : i + n]) for n in language_id.ORDERS for i in range(len(low) - n + 1)} if any(c.isalpha() for c in text) else set()


def test_language_scores_by_definition(monkeypatch):
    """Kernel, landmarks, ridge and scores against the formulas on sets of n-grams; texts in pieces are the whole."""
    rows = language_rows()[:60]
    texts, langs = [t for _, t, _ in rows], [lang for _, _, lang in rows]
    sets = [brute_grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    names = sorted(set(langs))
    chosen = [k for name in names for k in [k for k, lang in enumerate(langs) if lang == name][:6]]
    k_mm = np.array([[kernel(sets[a], sets[b]) for b in chosen] for a in chosen])
    k_nm = np.array([[kernel(s, sets[b]) for b in chosen] for s in sets])
    w = np.diag([1 / langs.count(lang) for lang in langs])
    y = np.array([[float(lang == n) for n in names] for lang in langs])
    # ridge in the landmarks' feature space: minimise |K_nm a - y|^2 w + ridge a' K_mm a
    a = np.linalg.solve(k_nm.T @ w @ k_nm + 1e-3 * k_mm, k_nm.T @ w @ y)
    model = language_id.fit(texts, langs, landmarks=18)
    asked = texts[:5] + ["ka schl ção ß É x" * 40, "", "1 2"]
    want = np.array([[kernel(brute_grams(t), sets[b]) for b in chosen] for t in asked]) @ a
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        present = [language_id.grams(language_id.folded(t)) for t in asked]
        assert [len(g) for g in present] == [len(brute_grams(t)) for t in asked]
        assert np.allclose(model.scores(present), want, atol=1e-4)


def test_language_of_very_long_texts(spark):
    """A megabyte of text is told as well as a line, and equal rows reach the driver once."""
    g = random.Random(6)
    sounds = {"xx": "ka ki ku ta ti tu".split(), "yy": "schl ung heit ver ge".split()}
    long = {lang: "".join(g.choice(s) + g.choice(["", " "]) for _ in range(300_000)) for lang, s in sounds.items()}
    rows = [r for r in language_rows() if r[2] != "zz"] + [(2000 + k, long[lang] + "zq!", None) for k, lang in enumerate(sounds)] + [(k, "ka ki schl", "xx") for k in range(3000, 13000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.train(df)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).filter("doc_id between 2000 and 2001").collect()}
    assert got == {2000: "xx", 2001: "yy"}


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney probabilities by definition."""
    top = Counter()
    for t in texts:
        raw = bytes(order - 1) + t
        for i in range(len(t)):
            top[raw[i : i + order]] += 1
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: kneser_ney.discounts([float(sum(v == c for v in counts[k].values())) for c in (1, 2, 3, 4)]) for k in counts}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        same = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        low = p(gram[1:])
        if not same:
            return low
        total = sum(same.values())
        cut = lambda c: d[k][min(c, 3) - 1]
        own = max(same[gram] - cut(same[gram]), 0) / total if gram in same else 0
        return own + sum(cut(c) for c in same.values()) / total * low

    return p


@pytest.mark.parametrize("block", [16 << 20, 5])
def test_kneser_ney(spark, block, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", block)
    texts = [b"the cat sat on the mat", b"a cat and a rat sat", "süß".encode(), b"tat tat tat"]
    train = spark.createDataFrame([(t.decode(),) for t in texts], "text string")
    model = kneser_ney.model_of(kneser_ney.gram_counts(train, 3), 3)
    p = brute_model(texts, 3)
    ask = ["the rat sat", "zzz", "ü", "", None]
    got = {r.n: r.perplexity for r in kneser_ney.perplexity(spark.createDataFrame(list(enumerate(ask)), "n int, text string"), model, 3).collect()}
    for k, t in enumerate(ask[:3]):
        raw = bytes(2) + t.encode()
        logs = [np.log(p(raw[i : i + 3])) for i in range(len(t.encode()))]
        assert got[k] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-5)
    assert got[3] is None and got[4] is None
    assert sum(p(b"at" + bytes([c])) for c in range(256)) == pytest.approx(1)


def test_quality(spark):
    g = random.Random(4)
    words = ["".join(g.choice("etaoinshr") for _ in range(g.randint(2, 5))) for _ in range(50)]
    rows = [(k, " ".join(g.choice(words) for _ in range(60)), "en") for k in range(200)] + [(500 + k, " ".join(g.choice(["@@", "##", "QZX!!"]) for _ in range(40)), "en") for k in range(20)] + [(900, None, "en"), (None, " ".join(words), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in CLASH})
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 120)] + [(k, 1, None) for k in (3, 3)] + [(510, 0, 0), (199, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classified(docs, labels).collect()}
    assert len(got) == len(rows) and all(got[k].kept for k in range(200)) and got[None].kept
    assert not any(got[500 + k].kept for k in range(20)) and not got[900].kept and got[3].trusted and not got[199].trusted
    kept = kneser_ney.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 201
    assert kneser_ney.classified(docs.limit(0), labels).count() == 0
    assert kneser_ney.classified(docs, labels.limit(0)).filter("kept").count() == len(rows) - 1


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def test_near_copies_by_similarity(spark):
    g = random.Random(3)
    words = ["".join(g.choice("etaoinshr") for _ in range(5)) for _ in range(400)]
    rows = []
    for k in range(60):
        base = [g.choice(words) for _ in range(g.randint(60, 200))]
        rows.append((3 * k, " ".join(base)))
        for m in (1, 2):
            near = list(base)
            for _ in range(g.randint(1, 4)):
                near[g.randrange(len(near))] = "changed" + g.choice(words)
            rows.append((3 * k + m, " ".join(near)))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    assert 60 < len(least) < 150
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_near_copies_of_one_original(spark, monkeypatch):
    """Many copies of one text, far from each other but near it, and texts that share half of their words."""
    monkeypatch.setattr(simhash, "ROUNDS", 2)
    monkeypatch.setattr(simhash, "DENSE", 1)
    monkeypatch.setattr(simhash, "TOGETHER", 7)
    g = random.Random(5)
    words = ["".join(g.choice("etaoinshr") for _ in range(5)) for _ in range(500)]
    base = [g.choice(words) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 50):
        near = list(base)
        near[g.randrange(120)] = f"odd{k}"
        near[g.randrange(120)] = f"other{k}"
        rows.append((k, " ".join(near)))
    rows += [(100 + k, " ".join(base[:60] + [g.choice(words) for _ in range(60)])) for k in range(30)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "a.b": F.lit(2), "_text": F.lit(3), "_own": F.lit(4), "node": F.lit(5)})
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    want = [0] + [100 + k for k in range(30)]
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(None, a, 1), (None, a, 2), (None, b, 3), (7, b, 4), (7, b, 5), (8, c, 6), (8, c, 6), (9, None, 7), (None, "", 8)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.text or "", r.doc_id) for r in kept) == [("", 9), (a, None), (b, 7), (c, 8)]


def test_quality_of_each_row(spark):
    g = random.Random(8)
    words = ["".join(g.choice("etaoinshr") for _ in range(5)) for _ in range(50)]
    rows = [(k, " ".join(g.choice(words) for _ in range(50)), "en") for k in range(60)]
    good = " ".join(g.choice(words) for _ in range(50))
    rows += [(None, good, "en"), (None, "@%" * (len(good) // 2) + "@" * (len(good) % 2), "en")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    kept = kneser_ney.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    assert [r.text for r in kept.filter("doc_id is null").collect()] == [good]


def test_threshold_is_the_held_out_quantile(spark):
    g = random.Random(4)
    words = ["".join(g.choice("etaoinshrdlu") for _ in range(g.randint(3, 9))) for _ in range(300)]
    docs = spark.createDataFrame([(k, " ".join(g.choice(words) for _ in range(60)), "en") for k in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    fold, held = F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(2)), []
    for k in (0, 1):
        model = kneser_ney.model_of(kneser_ney.gram_counts(docs.filter(fold != k)))
        held += [r.perplexity for r in kneser_ney.perplexity(docs.filter(fold == k).select("doc_id", "text"), model).collect()]
    for r in kneser_ney.classified(docs, labels).collect():
        assert r.threshold == pytest.approx(sorted(held)[39] * np.exp(2 / np.sqrt(r.n_bytes)), rel=1e-6)


def test_quality_by_definition(spark, monkeypatch):
    """Perplexity, thresholds by language and kept against the definitions, in several blocks, with null and repeated ids and odd columns."""
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 700)
    monkeypatch.setattr(kneser_ney, "ENOUGH", 10)
    g = random.Random(12)
    words = ["".join(g.choice("etaoinsü") for _ in range(g.randint(2, 5))) for _ in range(30)]
    rows = [(k, " ".join(g.choice(words) for _ in range(g.randint(3, 20))), ["en", "fr", None][k % 3]) for k in range(60)]
    rows += [(None, "etao insü", "en"), (None, "@@##", "en"), (70, "%%", "fr"), (70, "ü", "fr"), (3, "another text of an id", "xx"), (71, None, "en"), (72, "", None)] + [rows[0]] * 3
    good = {k for k in range(45)} | {70}
    labels = spark.createDataFrame([(k, 1, 0) for k in good] + [(50, 0, 0), (51, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumns({"a.b": F.lit(1), "_id": F.lit(2), "_hash": F.lit(3), "payload": F.lit(4), "block": F.lit(5)})
    fold = {r[0]: r[1] for r in docs.select("text", F.pmod(F.xxhash64(F.xxhash64(F.coalesce("text", F.lit("")))), F.lit(2))).collect()}
    raw = lambda t: (t or "").encode()
    trusted = [(raw(t), fold[t], lang) for k, t, lang in rows if k in good]
    pick = [brute_model([t for t, f, _ in trusted if f != k], 4) for k in (None, 0, 1)]

    def value(p, t):
        padded = bytes(3) + t
        return np.exp(-np.mean([np.log(p(padded[i : i + 4])) for i in range(len(t))])) if t else None

    held = defaultdict(list)
    for t, f, lang in trusted:
        if t:
            held[lang].append(value(pick[f + 1], t))
    top = lambda v: sorted(v)[max(0, int(np.ceil(0.99 * len(v))) - 1)]
    of_all = top([x for v in held.values() for x in v])
    want = Counter()
    for k, t, lang in rows:
        x = value(pick[0], raw(t))
        limit = (top(held[lang]) if len(held[lang]) >= 10 else of_all) * np.exp(2 / np.sqrt(max(1, len(raw(t)))))
        want[(k, lang, len(raw(t)), k in good, None if x is None else float(f"{x:.4g}"), float(f"{limit:.4g}"), bool(x is not None and x <= limit))] += 1
    got = kneser_ney.classified(docs, labels).collect()
    assert Counter((r.doc_id, r.lang, r.n_bytes, r.trusted, None if r.perplexity is None else float(f"{r.perplexity:.4g}"), float(f"{r.threshold:.4g}"), r.kept) for r in got) == want
    kept = kneser_ney.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(n for r, n in want.items() if r[-1])


def test_scoring_holds_little_memory(spark):
    """A block's texts are looked at in slices: what a worker holds beyond them doesn't grow with the block."""
    import tracemalloc

    raw = np.random.Generator(np.random.PCG64(3)).integers(97, 123, 12 << 20, np.uint8).tobytes()
    texts = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    none = kneser_ney.Scorer(*(np.zeros(0, kind) for kind in (np.int32, np.int64, np.float64, np.float64)))
    tracemalloc.start()
    found = none.perplexities(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and all(abs(x - 256) < 1e-6 for x in found)
    assert most < 100 << 20


def test_scoring_has_one_worker_a_task(spark):
    """Python steps of the quality classifier that follow each other without a shuffle are one step: two would hold two workers a task."""
    schema = "payload struct<id: long>, text string"
    docs = spark.createDataFrame([((k,), "some words " * k) for k in range(6)], schema)
    model = kneser_ney.model_of(kneser_ney.gram_counts(docs))
    plan = kneser_ney._scored(docs, model, kneser_ney.ORDER)._jdf.queryExecution().sparkPlan()
    steps = 0

    def below(node, over: bool) -> None:
        nonlocal steps
        name = node.nodeName()
        steps += name == "MapInArrow"
        assert not (over and name == "MapInArrow")
        alone = name in ("MapInArrow", "Project", "Filter")
        for k in range(node.children().size()):
            below(node.children().apply(k), alone and (over or name == "MapInArrow"))

    below(plan, False)
    assert steps == 3


def test_wanted_grams_and_views():
    """A block's texts are views of one copy, whose n-grams are those of the texts."""
    import zstandard

    texts = ["".join(chr(97 + (k * j) % 26) for j in range(40)).encode() for k in range(1, 6)] + [b"", "Ünï".encode()]
    views = kneser_ney._texts([len(t) for t in texts], zstandard.ZstdCompressor().compress(b"".join(texts)))
    assert [bytes(v) for v in views] == texts and len({id(v.obj) for v in views}) == 1
    assert (kneser_ney.packed_grams(views)[0] == kneser_ney.packed_grams(texts)[0]).all()
