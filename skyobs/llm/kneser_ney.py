"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyobs.llm.runtime import checkpointed, fresh, in_batches, named, partitions, spread_join

#: Bytes in an n-gram of the highest order; a gram is packed into a bigint, so 7 is the most.
ORDER = 4
#: Share of trusted documents of a language under the threshold, and the standard errors, at one nat a byte,
#: by which the log perplexity of a text may exceed it: short texts vary more.
QUANTILE, ERRORS = 0.99, 2.0
#: Parts of the trusted documents; each is scored for the quantile by a model of the others.
FOLDS = 2
#: Trusted documents that a language needs for a threshold of its own; others take that of all languages.
ENOUGH = 30
#: Text bytes of a block, whose distinct n-grams are joined with the shards of a model; parts that the rows of one id are dealt to.
BLOCK_BYTES, SALTS = 16 << 20, 16
#: Bytes whose n-grams are looked at together in a task; their sorting and sums take some 40 bytes a byte.
SLICE = 1 << 20


def packed_grams(texts: list[bytes] | list[memoryview], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, and the texts' lengths. Zero bytes stand before a text."""
    pad = bytes(order - 1)
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join([x for t in texts for x in (pad, t)]), np.uint8)
    n = len(raw) - order + 1
    if n <= 0 or not sizes.sum():
        return np.zeros(0, np.int64), sizes
    grams = np.zeros(n, np.uint32 if order <= 4 else np.uint64)
    for k in range(order):
        np.left_shift(grams, grams.dtype.type(8), out=grams)
        np.bitwise_or(grams, raw[k : k + n], out=grams)
    real = np.ones(len(raw), bool)
    starts = np.cumsum(sizes + order - 1) - sizes - (order - 1)
    for k in range(order - 1):
        real[starts + k] = False
    return grams[real[order - 1 :]], sizes


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and n: how often each n-gram of the highest order occurs in texts(text).

    Each batch sends its distinct n-grams; sums by gram are partial before the shuffle and in shards after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, _ = packed_grams([(t or "").encode() for t in batch.column(0).to_pylist()], order)
            found, counts = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["gram", "n"])

    return in_batches(texts.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _mod(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1))


def model_of(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of counts(gram, n) as rows (n, gram, p0, g0); see models_of."""
    return models_of(counts.withColumn("which", F.lit(0)), 1, order)


def models_of(counts: DataFrame, models: int, order: int = ORDER) -> DataFrame:
    """Models of counts(which, gram, n), which from 0 to models - 1, as rows (n, gram, p0, g0, p1, g1, ...).

    They are made together, by joins of count tables that stay sharded by gram. p is the interpolated
    probability of the gram's last byte after its others, null where the gram stands only as a context; g is
    the weight that the gram, as a context, hands to the next lower order, null where it is none. The highest
    order counts occurrences, lower ones distinct bytes before (continuations). Each order has three
    discounts from its counts of counts, for counts of 1, 2 and more.
    """
    levels = {order: checkpointed(counts)}
    for k in range(order - 1, 0, -1):
        levels[k] = checkpointed(levels[k + 1].groupBy("which", _mod(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    lower: DataFrame | None = None
    rows = []
    for k in range(1, order + 1):
        seen = {r["which"]: [float(r[f"c{c}"]) for c in (1, 2, 3, 4)] for r in levels[k].groupBy("which").agg(*[F.count_if(F.col("n") == c).alias(f"c{c}") for c in (1, 2, 3, 4)]).collect()}  # a row a model
        cuts = [discounts(seen.get(w, [0.0] * 4)) for w in range(models)]
        of_count = F.array(*[F.array(*map(F.lit, c)) for c in cuts])
        discount = F.get(F.get(of_count, F.col("which")), F.least(F.col("n"), F.lit(3)).cast("int") - 1)
        context = F.shiftright("gram", 8)
        gammas = checkpointed(
            levels[k].groupBy(F.col("which").alias("w"), context.alias("context")).agg(F.sum("n").cast("double").alias("total"), (F.sum(discount) / F.sum("n").cast("double")).alias("gamma"))
        )
        rows.append(gammas.select(F.lit(k - 1).alias("n"), F.col("context").alias("gram"), F.col("w").alias("which"), F.lit(None).cast("double").alias("p"), F.col("gamma").alias("g")))
        # contexts have at most 256 continuations, so no key of these joins is hot on the left; the right side has one row a key
        mixed = levels[k].join(gammas, (F.col("which") == F.col("w")) & (context == F.col("context"))).select(
            "which", "gram", (F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")).alias("own"), "gamma", _mod(F.col("gram"), k - 1).alias("suffix")
        )
        if lower is None:
            found = mixed.select("which", "gram", (F.col("own") + F.col("gamma") / 256).alias("p"))
        else:
            below = lower.select(F.col("which").alias("w"), F.col("gram").alias("below_gram"), F.col("p").alias("below"))
            found = mixed.join(below, (F.col("which") == F.col("w")) & (F.col("suffix") == F.col("below_gram"))).select("which", "gram", (F.col("own") + F.col("gamma") * F.col("below")).alias("p"))
        lower = checkpointed(found)
        rows.append(lower.select(F.lit(k).alias("n"), "gram", "which", "p", F.lit(None).cast("double").alias("g")))
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    wide = [F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{c}{w}") for w in range(models) for c in "pg"]
    return checkpointed(out.groupBy("n", "gram").agg(*wide))


def discounts(seen: list[float]) -> tuple[float, float, float]:
    """The three discounts from the numbers of grams with counts 1, 2, 3 and 4, within [0, count]; where a number is 0, plain ones."""
    n1, n2, n3, n4 = seen
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    found = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


class Scorer:
    """Log probabilities of packed n-grams from model rows: all of them, or at least those that the grams need."""

    def __init__(self, n: np.ndarray, gram: np.ndarray, p: np.ndarray, gamma: np.ndarray, order: int = ORDER) -> None:
        self.order, self.levels = order, []
        for k in range(order + 1):
            at = np.flatnonzero(n == k)
            at = at[np.argsort(gram[at])]
            self.levels.append((gram[at].astype(np.uint64), p[at].astype(np.float32), gamma[at].astype(np.float32)))

    def _find(self, k: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.levels[k][0]
        if not len(keys):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return at, keys[at] == grams

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        grams = grams.astype(np.uint64)
        p = np.full(len(grams), 1 / 256)
        for k in range(1, self.order + 1):
            part = grams & np.uint64((1 << 8 * k) - 1)
            at, known = self._find(k - 1, part >> np.uint64(8))
            gamma = np.where(known, self.levels[k - 1][2][at], np.nan) if len(self.levels[k - 1][0]) else np.full(len(grams), np.nan)
            backed = p * np.where(np.isnan(gamma), 1.0, gamma)
            at, known = self._find(k, part)
            own = np.where(known, self.levels[k][1][at], np.nan) if len(self.levels[k][0]) else np.full(len(grams), np.nan)
            p = np.where(np.isnan(own), backed, own)
        return np.log(np.maximum(p, 1e-12))

    def perplexities(self, texts: list[bytes] | list[memoryview]) -> list[float | None]:
        """exp of the mean negative log probability of a text's bytes; None for an empty text."""
        out: list[float | None] = []
        for start, end in _slices(texts):
            grams, sizes = packed_grams(texts[start:end], self.order)
            distinct, back = np.unique(grams, return_inverse=True)
            sums = np.concatenate(([0.0], np.cumsum(self.log_p(distinct)[back])))
            ends = np.cumsum(sizes)
            out += [float(np.exp((sums[e - s] - sums[e]) / s)) if s else None for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return out


def _packed(docs: DataFrame, with_text: bool, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, returns: str | None = None) -> DataFrame:
    """docs(payload, text) in blocks of about BLOCK_BYTES of text, made where the rows are read: a row a block.

    Returns block (the partition read from and the block's number there), part (the shuffle partition that it
    is dealt to), check (a hash of all its texts), payloads, sizes and hashes of the texts and, if with_text,
    the compressed texts; or what `then` makes of these rows in the same Python worker, of the schema `returns`:
    a second mapInArrow would give each task two workers. A block is the same whenever its rows are read again;
    check tells if it isn't.
    """
    n = partitions(docs.sparkSession)
    schema = returns or "block long, part int, check long, payloads array<%s>, sizes array<long>, hashes array<long>, texts binary" % docs.schema["payload"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = 0, 0
        payloads: list[pa.Array] = []
        sizes: list[int] = []
        digests: list[int] = []
        size = 0
        # texts are compressed as they come: the worker holds none of the block's but the last
        fresh_coder = zstandard.ZstdCompressor(level=3).compressobj
        coder, pieces = fresh_coder(), []

        def close() -> pa.RecordBatch:
            hashes = pa.array(np.array(digests, np.uint64).view(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), c) for c in (pa.concat_arrays(payloads), pa.array(sizes, pa.int64()), hashes)]
            check = np.uint64(xxhash.xxh64_intdigest(hashes.to_numpy().tobytes())).view(np.int64)
            coded = b"".join((*pieces, coder.flush())) if with_text else None
            columns = [pa.array([task << 32 | made], pa.int64()), pa.array([(3 * task + made) % n], pa.int32()), pa.array([check], pa.int64()), *lists, pa.array([coded], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "part", "check", "payloads", "sizes", "hashes", "texts"])

        for batch in batches:
            start = 0
            if batch.num_rows:
                task = batch.column(2)[0].as_py()
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = (text or "").encode()
                sizes.append(len(raw))
                digests.append(xxhash.xxh64_intdigest(raw, 42))
                size += len(raw)
                if with_text:
                    pieces.append(coder.compress(raw))
                if size >= BLOCK_BYTES:
                    payloads.append(batch.column(0).slice(start, k + 1 - start))
                    yield close()
                    made, payloads, sizes, digests, size, start = made + 1, [], [], [], 0, k + 1
                    coder, pieces = fresh_coder(), []
            if start < batch.num_rows:
                payloads.append(batch.column(0).slice(start))
        if sizes:
            yield close()

    # the scan's own partition: a task's number counts the parts of a union that come before
    made = docs.select("payload", "text", F.spark_partition_id().alias("task"))
    return in_batches(made, run if then is None else lambda batches: then(run(batches)), schema)


def _texts(sizes: list[int], coded: bytes) -> list[memoryview]:
    """Views of a block's texts; they share one copy."""
    raw = memoryview(zstandard.ZstdDecompressor().decompress(coded, max_output_size=max(1, sum(sizes))))
    ends = np.cumsum(sizes).tolist()
    return [raw[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def _slices(texts: list[bytes] | list[memoryview]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes, or a longer text alone."""
    start = 0
    while start < len(texts):
        end, size = start + 1, len(texts[start])
        while end < len(texts) and size + len(texts[end]) < SLICE:
            size += len(texts[end])
            end += 1
        yield start, end
        start = end


def _wanted(order: int):
    """What makes rows of _packed the distinct n-grams and contexts of all orders that each block needs: (block, part, n, gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, part, sizes, coded = (batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("block", "part", "sizes", "texts"))
                texts = _texts(sizes, coded)
                parts = [np.unique(packed_grams(texts[a:b], order)[0]) for a, b in _slices(texts)]
                del texts
                grams = np.unique(np.concatenate(parts)).astype(np.int64)
                for n in range(order + 1):
                    own = grams & ((1 << 8 * n) - 1)
                    context = (grams & ((1 << 8 * (n + 1)) - 1)) >> 8 if n < order else own
                    found = np.unique(np.concatenate((own, context)))
                    same = lambda x, kind: pa.array(np.full(len(found), x), kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(block, pa.int64()), same(part, pa.int32()), same(n, pa.int32()), pa.array(found, pa.int64())], names=["block", "part", "n", "gram"])

    return run


def _folds(hashes: np.ndarray) -> np.ndarray:
    """The fold of each text, by a hash of its hash."""
    return np.array([(xxhash.xxh64_intdigest(int(h).to_bytes(8, "little", signed=True), 42) + (1 << 63)) % (1 << 64) - (1 << 63) for h in hashes.tolist()], np.int64) % FOLDS


def _scored(docs: DataFrame, model: DataFrame, order: int, flags: DataFrame | None = None) -> DataFrame:
    """docs(payload, text) with n_bytes, hash, block, at, trusted, perplexity and held_out: all rows of all blocks.

    Each block's distinct n-grams are joined with the model, sharded by (n, gram), and what is found meets the
    block again: text is shuffled once, compressed. perplexity is by the first model. flags(block, part, check,
    trusted: places) tells trusted texts, whose held_out is by the model that was made without their fold.
    """
    models = (len(model.columns) - 2) // 2
    values = [f"{c}{w}" for w in range(models) for c in "pg"]
    packed = _packed(docs, True)
    wanted = _packed(docs, True, _wanted(order), "block long, part int, n int, gram long")
    own = wanted.join(model.hint("shuffle_hash"), ["n", "gram"])
    rows = own.withColumn("kind", F.lit(0)).unionByName(packed.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    if flags is not None:
        rows = rows.unionByName(flags.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    else:
        rows = rows.withColumn("trusted", F.lit(None).cast("array<int>"))
    dealt = rows.repartitionById(partitions(docs.sparkSession), "part").sortWithinPartitions("block", "kind")
    names = ["payload", "n_bytes", "hash", "block", "at", "trusted", "perplexity", "held_out"]
    schema = f"payload {docs.schema['payload'].dataType.simpleString()}, n_bytes long, hash long, block long, at int, trusted boolean, perplexity double, held_out double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        marked: tuple[int, int, list[int]] | None = None
        at_block = None
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            blocks, kinds = column("block").to_numpy(), column("kind").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), [True]))) if len(blocks) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True) if len(edges) else ():
                if blocks[a] != at_block:
                    held, marked, at_block = [], None, blocks[a]
                if kinds[a] == 0:
                    held.append(batch.slice(a, b - a).select(["n", "gram", *values]))
                elif kinds[a] == 1:
                    marked = column("check")[a].as_py(), column("trusted")[a].as_py()
                else:
                    for k in range(a, b):
                        check, sizes = column("check")[k].as_py(), column("sizes")[k].as_py()
                        if marked is not None and marked[0] != check:
                            raise RuntimeError("the documents weren't read in the same blocks twice")
                        hashes = column("hashes")[k].values.to_numpy()
                        texts = _texts(sizes, column("texts")[k].as_py())
                        trusted = np.zeros(len(texts), bool)
                        if marked is not None:
                            trusted[marked[1]] = True
                        table = pa.Table.from_batches(held) if held else None
                        whole = _scorer(table, 0, order).perplexities(texts)
                        apart: list[float | None] = [None] * len(texts)
                        folds = _folds(hashes) if trusted.any() else np.zeros(len(texts), np.int64)
                        for w in range(1, models):
                            mine = np.flatnonzero(trusted & (folds == w - 1)).tolist()
                            for i, x in zip(mine, _scorer(table, w, order).perplexities([texts[i] for i in mine]) if mine else (), strict=True):
                                apart[i] = x
                        columns = [column("payloads")[k].values, pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(np.full(len(texts), at_block), pa.int64()), pa.array(np.arange(len(texts)), pa.int32()), pa.array(trusted), pa.array(whole, pa.float64()), pa.array(apart, pa.float64())]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(run, schema)


def _scorer(table: pa.Table | None, which: int, order: int) -> Scorer:
    """A scorer from joined model rows of one model; without any, all is by chance."""
    if table is None:
        return Scorer(*(np.zeros(0, kind) for kind in (np.int32, np.int64, np.float64, np.float64)), order)
    number = lambda c: table[c].to_numpy().astype(np.float64)
    p, g = number(f"p{which}"), number(f"g{which}")
    known = ~(np.isnan(p) & np.isnan(g))
    return Scorer(table["n"].to_numpy()[known], table["gram"].to_numpy()[known], p[known], g[known], order)


def perplexity(docs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """docs (whose columns are text and others) with `perplexity` in place of `text`; null for null and empty texts."""
    others = [c for c in docs.columns if c != "text"]
    found = _scored(docs.select(F.struct(*map(named, others)).alias("payload"), "text"), model, order)
    return found.select(*[F.col("payload").getField(c).alias(c) for c in others], "perplexity")


def classified(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """doc_id, lang, n_bytes, trusted, perplexity, threshold and kept for every document.

    Trusted are documents with a label of quality 1 that is not toxic; all their text trains the model. A
    language's threshold is a quantile of its trusted documents' perplexities, each under a model of the FOLDS
    that it isn't in (equal texts are in one), and wider for short texts. A language with few of them (null is
    one, too) takes that of all. A document is kept if its perplexity is at most the threshold. An empty or null
    text has no perplexity and isn't kept. Without trusted text there are no thresholds, and all other documents
    are kept. Repeated ids, labels and rows: a document is trusted if any of its labels is, and all rows are
    returned. Columns of other names are ignored; empty tables work.
    """
    found = _judged(docs, labels, order, quantile, id_col, text_col, lang_col)
    return found.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_bytes", "trusted", "perplexity", "threshold", "kept")


def _judged(docs: DataFrame, labels: DataFrame, order: int, quantile: float, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, lang, n_bytes, hash (of the text), trusted, perplexity, threshold and kept for every document."""
    slim = docs.select(F.struct(named(id_col).alias("id"), named(lang_col).alias("lang")).alias("payload"), named(text_col).alias("text"))
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").alias("good")).filter("good is not null").distinct()
    # labels grow with the corpus: they are never broadcast, however few they are here; an id with very many rows is dealt to SALTS parts
    salted = good.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = _packed(slim, False)
    placed = blocks.select("block", "part", "check", F.posexplode(F.transform("payloads", lambda x: x["id"])).alias("at", "id")).filter("id is not null").withColumn("of", F.pmod("at", F.lit(SALTS)))
    trusted = placed.join(salted.hint("merge"), (F.col("id") == F.col("good")) & (F.col("of") == F.col("salt")), "left_semi")
    # a row a block, with as many places as it has rows at most
    flags = checkpointed(trusted.groupBy("block", "part", "check").agg(F.collect_list("at").alias("trusted")))
    counts = checkpointed(_training_counts(_packed(slim, True), flags, order))
    every = counts.withColumn("which", F.explode(F.array_compact(F.array(F.lit(0), *[F.when(F.col("fold") != k, F.lit(k + 1)) for k in range(FOLDS)]))))
    models = models_of(every.groupBy("which", "gram").agg(F.sum("n").alias("n")), FOLDS + 1, order)
    scored = checkpointed(_scored(slim, models, order, flags))

    wider = F.exp(F.lit(ERRORS) / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1))))
    marked = scored.select("payload.id", "payload.lang", "n_bytes", "hash", "block", "at", "trusted", "perplexity", "held_out").withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null")))
    of_trusted = F.percentile_approx("held_out", quantile, 10_000)  # null but for trusted texts
    by_lang = checkpointed(marked.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.when(F.count("held_out") >= ENOUGH, of_trusted).alias("own")))
    joined = spread_join(marked, by_lang, "name", "n", ["block", "at"]).crossJoin(F.broadcast(marked.agg(of_trusted.alias("of_all"))))
    threshold = F.coalesce("own", "of_all") * wider
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return joined.select("id", "lang", "n_bytes", "hash", "trusted", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def _training_counts(packed: DataFrame, flags: DataFrame, order: int) -> DataFrame:
    """(fold, gram, n): how often each n-gram of the highest order occurs in the trusted texts of each fold."""
    places = flags.select(F.col("block").alias("_block"), F.col("check").alias("_check"), "trusted")
    met = packed.join(places.hint("merge"), F.col("block") == F.col("_block")).select("check", "_check", "sizes", "hashes", "texts", "trusted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                check, other, sizes = (batch.column(c)[k].as_py() for c in (0, 1, 2))
                if check != other:
                    raise RuntimeError("the documents weren't read in the same blocks twice")
                texts, chosen = _texts(sizes, batch.column(4)[k].as_py()), sorted(batch.column(5)[k].as_py())
                folds = _folds(batch.column(3)[k].values.to_numpy())
                for fold in range(FOLDS):
                    mine = [texts[i] for i in chosen if folds[i] == fold]
                    for a, b in _slices(mine):
                        found, n = np.unique(packed_grams(mine[a:b], order)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), fold), pa.int32()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["fold", "gram", "n"])

    return met.mapInArrow(run, "fold int, gram long, n long").groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def keep_good(docs: DataFrame, labels: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all their columns, whatever their names, that `classified` keeps. Each row is judged by its own text and language."""
    found = _judged(docs, labels, order, QUANTILE, id_col, text_col, lang_col)
    i, lang, text = (fresh(c, docs.columns) for c in ("_id", "_lang", "_hash"))
    good = checkpointed(found.filter("kept").select(F.col("id").alias(i), F.col("lang").alias(lang), F.col("hash").alias(text)).distinct())
    same = named(id_col).eqNullSafe(F.col(i)) & named(lang_col).eqNullSafe(F.col(lang)) & (F.xxhash64(F.coalesce(named(text_col), F.lit(""))) == F.col(text))
    return docs.join(good, same, "left_semi")
