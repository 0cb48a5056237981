"""Language identification with blended-spectrum string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyobs.llm.runtime import in_batches

#: n-gram lengths of the blended spectrum, landmarks in all, ridge.
ORDERS, LANDMARKS, RIDGE = (1, 2, 3, 4), 192, 1e-3
#: Training: most languages, distinct texts of a language and of all, code points of a text, and those of a text of a
#: language that has no shorter one. They bound what reaches the driver.
LANGUAGES, TRAINING_ROWS, ALL_ROWS, TRAINING_CHARS, MOST_CHARS = 1000, 400, 20_000, 20_000, 1_000_000
#: Documents in a matrix product, code points whose n-grams are sorted at once.
BATCH, CHUNK = 64, 1 << 20
UNDETERMINED = "und"
_folded: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to lower-cased letter; all that is no letter to a space. 4 MB, made once a worker."""
    if not _folded:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def folded(text: str | None) -> np.ndarray:
    """The text's code points: lower-cased letters, and spaces for all else. Without a letter: empty."""
    codes = _fold()[np.frombuffer((text or "").encode("utf-32-le"), np.uint32)]
    return codes if (codes != 32).any() else codes[:0]


def grams(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of ORDERS in a whole text's code points."""
    factor, mix, most = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), max(ORDERS)
    found = []
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK + most - 1].astype(np.uint64)
        hashed, every = part + np.uint64(1), []
        for n in ORDERS:
            if n > 1:
                hashed = hashed[:-1] * factor + part[n - 1 :] + np.uint64(1)
            every.append((hashed ^ np.uint64(n)) * mix)
            if len(part) <= n:
                break
        found.append(np.unique(np.concatenate(every)))
    if not found:
        return np.zeros(0, np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass(frozen=True)
class Model:
    """languages, the landmarks' n-grams (sorted hashes), and the kernel expansion as a weight for each of them and language.

    The expansion over landmarks, sum of a_l |x and l| / sqrt(|x| |l|), is linear in the presence vector of x
    and zero for n-grams that no landmark has. So the landmarks' presence times coefficients, summed once, gives
    the same scores by one product with the batch's presence matrix, whose rows are kept as lists of columns.
    """

    languages: tuple[str, ...]
    known: np.ndarray
    weights: np.ndarray

    def scores(self, present: list[np.ndarray]) -> np.ndarray:
        """A row a text, a column a language, of the texts' sorted n-grams."""
        out = np.zeros((len(present), len(self.languages)))
        if not len(self.known) or not present:
            return out
        columns = []
        for g in present:
            at = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
            columns.append(at[self.known[at] == g])
        ends = np.cumsum([len(c) for c in columns])
        sums = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(self.weights[np.concatenate(columns)], axis=0, dtype=np.float64)))
        norms = np.sqrt([max(1, len(g)) for g in present])
        return (sums[ends] - sums[np.concatenate(([0], ends[:-1]))]) / norms[:, None]


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression in the Nyström space of the first texts of each language, `landmarks` in all or two a language."""
    names = tuple(sorted(set(languages)))
    if not names:
        return Model((), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    each, taken = max(2, landmarks // len(names)), dict.fromkeys(names, 0)
    chosen = []
    for k, lang in enumerate(languages):
        if taken[lang] < each:
            taken[lang] += 1
            chosen.append(k)
    present = [grams(folded(t)) for t in texts]
    known = np.unique(np.concatenate([present[k] for k in chosen]))
    places = [np.searchsorted(known, present[k]) for k in chosen]
    # the landmarks that have each known n-gram: a list of lists in two arrays
    order = np.argsort(np.concatenate(places), kind="stable")
    having = np.repeat(np.arange(len(chosen)), [len(p) for p in places])[order]
    starts = np.searchsorted(np.concatenate(places)[order], np.arange(len(known) + 1))
    mark_norms = np.sqrt([max(1, len(present[k])) for k in chosen])
    cross = np.empty((len(texts), len(chosen)))
    for k, g in enumerate(present):
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        at = at[known[at] == g]
        lengths = starts[at + 1] - starts[at]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        cross[k] = np.bincount(having[np.repeat(starts[at], lengths) + inside], minlength=len(chosen)) / mark_norms / np.sqrt(max(1, len(g)))
    values, vectors = np.linalg.eigh(cross[chosen])
    kept = values > 1e-8 * values.max(initial=0)
    root = vectors[:, kept] / np.sqrt(values[kept])
    mapped = cross @ root
    share = {name: languages.count(name) for name in names}
    w = np.array([1 / share[lang] for lang in languages])  # languages weigh the same
    column = {name: k for k, name in enumerate(names)}
    target = np.zeros((len(texts), len(names)))
    target[np.arange(len(texts)), [column[lang] for lang in languages]] = 1
    gram = mapped.T @ (mapped * w[:, None]) + ridge * np.eye(mapped.shape[1])
    coefficients = root @ np.linalg.solve(gram, mapped.T @ (target * w[:, None])) / mark_norms[:, None]
    weights = np.zeros((len(known), len(names)), np.float32)
    for k, p in enumerate(places):
        weights[p] += coefficients[k]
    return Model(names, known, weights)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of distinct whole texts with a label that aren't held out.

    Of the LANGUAGES most frequent languages, each gives at most `rows` distinct texts (fewer if there are so
    many languages that ALL_ROWS would be passed) of at most TRAINING_CHARS code points; a language with longer
    ones only gives those as short as its shortest, unless that has over MOST_CHARS. A hash of the text decides,
    with a bound set by the language's count, so repeated rows weigh once and only about the rows needed reach
    the driver. Texts without letters and the label 'und' aren't used.
    """
    length = F.length(text_col)
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.col(lang_col) != UNDETERMINED) & F.col(text_col).isNotNull() & (length <= MOST_CHARS)).filter(F.regexp_like(text_col, F.lit("\\p{L}")))
    slim = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(11), F.col(text_col)).alias("hash"), length.alias("chars"), F.col(text_col).alias("text"))
    least = slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.min("chars"), F.lit(TRAINING_CHARS)).alias("most")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not least:
        return fit([], [])
    rows = max(4, min(rows, ALL_ROWS // len(least)))
    in_map = lambda values: F.create_map(*[F.lit(x) for pair in values for x in pair])[F.col("lang")]
    short = slim.filter(F.col("chars") <= in_map([(r["lang"], r["most"]) for r in least]))
    counts = {r["lang"]: r["count"] for r in short.select("lang", "hash").distinct().groupBy("lang").count().collect()}
    bound = 1 << 30
    limits = in_map([(lang, min(bound, int(bound * (1.2 * rows + 20) / n))) for lang, n in counts.items()])
    drawn = short.filter(F.shiftrightunsigned("hash", 34) < limits).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    sample: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["hash"] & (1 << 64) - 1)):
        if len(sample.setdefault(r["lang"], [])) < rows and len(folded(r["text"])):
            sample[r["lang"]].append(r["text"])
    pairs = [(t, lang) for lang in sorted(sample) for t in sample[lang]]
    return fit([t for t, _ in pairs], [lang for _, lang in pairs])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred and score (0 to 1) of every whole text.

    A null text, or one without letters, and every text if nothing was learned, gets 'und' and 0. Rows
    with null or repeated ids are all kept; columns of other names are ignored; an empty table gives an
    empty one. Ties go to the language that sorts first. Very long texts are worked on in pieces whose
    distinct n-grams are united, so their scores are those of the whole.
    """
    slim = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            labels: list[str] = []
            values: list[float] = []
            for k in range(0, len(texts), BATCH):
                present = [grams(folded(t)) for t in texts[k : k + BATCH]]
                for g, row in zip(present, model.scores(present), strict=True):
                    known = len(g) and len(row)
                    labels.append(model.languages[int(row.argmax())] if known else UNDETERMINED)
                    values.append(float(min(1.0, max(0.0, row.max()))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(values, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return in_batches(slim, run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
