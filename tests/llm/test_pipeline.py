"""Every stage of the pipeline against a plain version on the stage's own input, and the stages run one after the other."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyobs.llm import kneser_ney, simhash
from skyobs.llm.queries import tokenizer_path
from tests.llm.test_text_ops import _classes, brute_model, filled


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    g = random.Random(11)
    words = ["".join(g.choice("etaoinshrü") for _ in range(g.randint(2, 6))) for _ in range(60)]
    passage = " ".join(g.choice(words) for _ in range(60))
    rows = []
    for k in range(150):
        text = " ".join(g.choice(words) for _ in range(g.randint(20, 80)))
        if k % 5 == 1:
            text += " " + passage + " " + g.choice(words)
        if k % 6 == 2:
            text = rows[k // 2][1]
        rows.append((k, text, g.choice(["en", "fr"]), g.choice(["a", "b", None]), len(text)))
    rows += [(500 + k, " ".join(g.choice(["@@", "QZX!!", "%%9"]) for _ in range(50)), "en", "a", 1) for k in range(10)] + [(900, None, None, "b", None), (901, "", "en", "a", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 100)] + [(k, 0, 0) for k in range(500, 505)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        seen.append((docs.collect(), spark.read.parquet(str(tmp_path / str(k))).collect()))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    check_quality(*seen[0])
    check_copies(*seen[1])
    check_repeats(*seen[2])
    check_mix(*seen[3])
    check_tokens(*seen[4])
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(str, again)) == Counter(map(str, seen[4][1]))


def check_quality(before, after):
    trusted = [r.text.encode() for r in before if r.doc_id < 100]
    p, known = brute_model(trusted, kneser_ney.ORDER), {}

    def perplexity(text):
        raw = bytes(kneser_ney.ORDER - 1) + text.encode()
        grams = [raw[i : i + kneser_ney.ORDER] for i in range(len(text.encode()))]
        for g in set(grams) - set(known):
            known[g] = np.log(p(g))
        return float(np.exp(-np.mean([known[g] for g in grams])))

    some = [r for r in before if r.text and (r.doc_id >= 500 or r.doc_id % 25 == 0)]
    values = {r.doc_id: perplexity(r.text) for r in some}
    top = max(v for k, v in values.items() if k < 100)
    kept = {r.doc_id for r in after}
    assert {k for k, v in values.items() if v <= top} <= kept and not {k for k, v in values.items() if v > 3 * top} & kept
    assert kept == set(range(150))


def check_copies(before, after):
    order = sorted(before, key=lambda r: r.doc_id)
    fps = [simhash.fingerprint(r.text) for r in order]
    assert len(after) == len(_classes(fps)) < len(before)
    least = {}
    for r, f in zip(order, fps):
        least.setdefault(f, r.doc_id)
    assert {r.doc_id for r in after} <= set(least.values())


def check_repeats(before, after):
    seen, want = set(), {}
    for r in sorted(before, key=lambda r: r.doc_id):
        raw = r.text.encode()
        hit = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                hit[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        cut = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(hit))]
        kept, at = b"", 0
        for a, b in cut:  # characters that a run covers in part stay
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        if kept:
            want[r.doc_id] = kept.decode()
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    assert sum(map(len, want.values())) < sum(len(r.text) for r in before)


def check_mix(before, after):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most, taken, copies = Counter(), defaultdict(int), Counter(), Counter(r.doc_id for r in after)
    for r in before:
        sizes[r.source] += count(r.text)
        most[r.source] = max(most[r.source], count(r.text))
        taken[r.source] += copies[r.doc_id] * count(r.text)
    assert max(copies.values()) <= 2
    for s, t in filled(sizes).items():
        assert abs(taken[s] - t) <= most[s]


def check_tokens(before, after):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    assert Counter((r.doc_id, tuple(r.ids)) for r in after) == Counter((r.doc_id, tuple(sp.encode(r.text, add_bos=True, add_eos=True))) for r in before)


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
