"""ARC and WARC, TIFF: round trips and flaws."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyobs.llm import tiff, warc


@settings(max_examples=120, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4))
def test_coders(data, repeat):
    data = data * repeat
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_fills_its_table():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes() + b"ab" * 20_000
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compression", list(tiff.ENCODERS))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages(compression, predictor, tile, order):
    g = np.random.default_rng(1)
    pages = [g.integers(0, 256, s).astype(np.uint8) for s in ((70, 33), (1, 1), (64, 48))]
    back = list(tiff.read_pages(tiff.write_pages(pages, compression, predictor, tile, order)))
    assert [p.number for p in back] == [0, 1, 2]
    assert all((b.samples[:, :, 0] == p).all() for b, p in zip(back, pages))


def test_media_rows(spark):
    rows = [(1, "x" * 5), (2, None), (3, ""), (4, "ü" * 288), (5, "abc" * 200_000), (5, "x" * 5), (None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("feature", F.lit(1)).withColumn("id", F.lit(2))
    got = tiff.media_rows(df).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(rows, key=lambda r: (r[0] or 0, len((r[1] or "").encode())))):
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.n_bytes == 5}) == 1
    assert tiff.media_rows(df.limit(0)).count() == 0


def test_forms_of_payloads(spark):
    """Texts of all forms come back whole, from every coder, layout and byte order."""
    texts = [f"{k} " + "ab " * (k % 60) for k in range(400)]
    seen = {tuple(tiff.form_of(tiff.padded(t.encode())).values()) for t in texts}
    assert seen == set(tiff.FORMS) and tiff.form_of(b"x" * 576 * 20)["compression"] == tiff.DEFLATE
    got = tiff.media_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.payload_sha256 for r in got} == {k: hashlib.sha256(tiff.padded(t.encode())).hexdigest() for k, t in enumerate(texts)}


def test_decoders_on_bytes_from_the_specification():
    # the example of PackBits in the specification's section 9, and its table of codes of LZW in section 13
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa".replace(" ", ""))
    assert tiff.packbits_decode(packed) == bytes.fromhex("aa aa aa 80 00 2a aa aa aa aa 80 00 2a 22 aa aa aa aa aa aa aa aa aa aa".replace(" ", ""))
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.lzw_decode(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_hostile_files(spark):
    def directory(*entries):
        return b"II" + (42).to_bytes(2, "little") + (8).to_bytes(4, "little") + len(entries).to_bytes(2, "little") + b"".join(t.to_bytes(2, "little") + k.to_bytes(2, "little") + n.to_bytes(4, "little") + v.to_bytes(4, "little") for t, k, n, v in entries) + bytes(4)

    usual = [(258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, 8), (278, 4, 1, 1 << 22), (279, 4, 1, 64)]
    files = [
        directory((256, 4, 1, 1 << 20), (257, 4, 1, 1 << 22), *usual),
        directory((256, 4, (1 << 32) - 1, 8), (257, 4, 1, 2), *usual),
        directory((256, 4, 1, 0), (257, 4, 1, 2), *usual),
        directory((256, 4, 1, 8), (257, 4, 1, 2), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, 1, 8), (278, 4, 1, 2), (279, 4, 1, 64)),
        directory((256, 4, 1, 8), (257, 4, 1, 2), *usual),
    ]
    df = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)], "id int, data binary")
    got = {r.id: r for r in tiff.page_rows(df, "id", "data").collect()}
    assert [got[k].page for k in range(5)] == [-1, -1, -1, -1, 0] and all(got[k].error for k in range(4))


def test_page_rows(spark):
    good = tiff.to_tiff(tiff.padded(b"a" * 400_000))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"nonsense")), (3, None)], "id int, data binary")
    got = tiff.page_rows(df, "id", "data").collect()
    assert sorted((r.id, r.page) for r in got) == [(1, 0), (1, 1), (2, -1), (3, -1)]
    assert all((r.error is None) == (r.id == 1) for r in got)


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    date = "20080430204825"
    bodies = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\nhi\n\n", b"", b"plain\nwarcinfo\n"]
    data = warc.arc_file_header(version, "f.arc", date) + b"".join(warc.arc_record(version, {"url": f"http://e/{k} x", "ip": "1.2.3.4", "date": date, "type": "text/html"}, b) for k, b in enumerate(bodies))
    opening, *got = warc.parse_arc(data)
    assert opening.opens_file and warc.convert(opening).headers["WARC-Type"] == "warcinfo" and b"f.arc" in warc.convert(opening).block
    assert [a.body for a in got] == bodies and {a.version for a in got} == {version} and [a.place for a in got] == [1, 2, 3]
    r = warc.convert(got[0])
    assert (r.headers["WARC-Type"], r.headers["WARC-Date"], r.headers["WARC-Target-URI"]) == ("response", "2008-04-30T20:48:25Z", "http://e/0%20x")
    assert r.headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>\nhi\n\n").digest()).decode()
    assert warc.convert(got[2]).headers["WARC-Type"] == "resource"
    back = list(warc.parse_warc(b"".join(warc.warc_bytes(warc.convert(a)) for a in got)))
    assert [b.block for b in back] == bodies
    for bad in (data[:-4], b"http://x 1.1.1.1 2008 text/html ten\n", b"one two\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


@given(st.integers(-(1 << 63), (1 << 63) - 1))
def test_identifiers(n):
    assert warc.number_of(warc.record_id(n, "", "", "")) == n
    assert warc.number_of(warc.record_id(None, "u", "d", "x")) is None


def test_archives(spark, tmp_path):
    rows = [(5, "http://a", "<p>ü</p>"), (3, "http://b", "<p>ü</p>"), (9, None, None), (4, "http://c", ""), (7, "http://d", "z" * 9_000_000), (8, "http://e", "z" * 9_000_000), (7, "http://f", "other"), (None, "http://g", "<p>ü</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("number", F.lit(1)).withColumn("digest", F.lit(1)).repartition(3)
    got = warc.write_and_read(df, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 1 << 60), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = first.get(h or "") is not None and first[h or ""] != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(str, want)) == sorted(str((r.number, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert warc.write_and_read(df.limit(0), str(tmp_path / "e")).count() == 0
    dates = {r.number: r.date for r in got}
    assert dates[5] == "2001-01-01T00:00:05Z" and len(set(dates.values())) > 4


def test_repeated_pages_and_odd_urls(spark, tmp_path):
    """Equal rows, many copies of one payload, urls that look like a version block."""
    rows = [(1, "filedesc://x", "a"), (1, "filedesc://x", "a"), (2, "filedesc:// y\n\r", "b")] + [(10 + k, None, "hot") for k in range(700)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.write_and_read(df, str(tmp_path / "w")).collect()
    assert sorted(((r.number, r.record_type, r.refers_to) for r in got), key=str) == sorted([(1, "response", None)] * 2 + [(2, "response", None), (10, "response", None)] + [(10 + k, "revisit", 10) for k in range(1, 700)], key=str)
    assert {r.url for r in got if r.number < 3} == {"filedesc://x", "filedesc://%20y%0A%0D"}


def test_arc_source(spark, tmp_path):
    """Files of both versions, plain and gzipped, with many records, a broken one, and their archives as files."""
    old = "19980102030405"
    one = warc.arc_file_header(1, "one.arc", old) + b"".join(warc.arc_record(1, {"url": f"http://a/{k}", "ip": "1.1.1.1", "date": old, "type": "text/html"}, b"HTTP/1.0 200 OK\r\n\r\nbody%d" % k) for k in range(5))
    two = [warc.arc_file_header(2, "two.arc", old)] + [warc.arc_record(2, {"url": f"http://b/{k}", "ip": "1.1.1.1", "date": "1999", "type": "text/plain"}, b"body%d" % k) for k in range(3)]
    odd = b"http://c/ 1.2.3.4 19990909090909 text/html; charset=x 5\nhello\n"
    (tmp_path / "in").mkdir()
    for name, content in (("one.arc", one), ("two.arc.gz", b"".join(map(warc.gzip_member, two))), ("bad.arc", one[:-9]), ("cut.arc.gz", warc.gzip_member(one)[:-12]), ("odd.arc", warc.arc_file_header(1, "o", old) + odd), ("none.arc", b"")):
        (tmp_path / "in" / name).write_bytes(content)
    files = warc.arc_source(spark, str(tmp_path / "in"))
    got = warc.arc_records(files).collect()
    of = lambda name: [r for r in got if r.file.endswith("/" + name)]
    assert [(r.version, r.url, r.date, r.payload_bytes) for r in of("one.arc")] == [(1, f"http://a/{k}", old, 5) for k in range(5)]
    assert [(r.version, r.date) for r in of("two.arc.gz")] == [(2, "1999")] * 3
    assert [r.error is None for r in of("bad.arc")] == [True] * 4 + [False] and [r.place for r in of("cut.arc.gz")] == [-1]
    assert of("odd.arc")[0].type == "text/html; charset=x" and not of("none.arc")
    whole = files.filter("file not like '%bad%' and file not like '%cut%'")
    made = warc.to_warc(whole, warc.revisits(warc.arc_records(whole)))
    assert {r.bytes for r in warc.write_files(made, str(tmp_path / "out")).collect()} == {f.stat().st_size for f in (tmp_path / "out").iterdir()}
    back = list(warc.parse_warc(warc.unpacked((tmp_path / "out" / "one.warc.gz").read_bytes())))
    assert [r.headers["WARC-Type"] for r in back] == ["warcinfo"] + ["response"] * 5 and back[1].headers["WARC-Date"] == "1998-01-02T03:04:05Z"
    assert sorted(r.date for r in warc.read_archives(made).collect())[-1] == "1999-09-09T09:09:09Z"


def test_large_payloads_take_all_forms(spark):
    """A payload's size doesn't choose its form: texts of many strips and tiles, and of a few pages, are written by every coder."""
    texts = [f"{k} " + " ".join(str(j * j % (k + 7)) for j in range(2_000 + 400 * k)) for k in range(64)] + ["long " * 120_000]
    seen = {tiff.form_of(tiff.padded(t.encode()))["compression"] for t in texts}
    assert seen == {tiff.DEFLATE, tiff.PACKBITS, tiff.LZW, tiff.NONE}
    got = {r.doc_id: r for r in tiff.media_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[k].payload_sha256 == hashlib.sha256(tiff.padded(t.encode())).hexdigest() for k, t in enumerate(texts))
    assert got[64].n_pages == 3
    full = tiff.padded(texts[64].encode())
    for form in tiff.FORMS:
        media = tiff.to_tiff(full, **dict(zip(("compression", "predictor", "tile", "order"), form, strict=True)))
        assert b"".join(p.samples.tobytes() for p in tiff.read_pages(media)) == full


def test_cut_and_odd_lzw():
    data = bytes(range(256)) * 90
    coded = tiff.lzw_encode(data)
    assert tiff.lzw_decode(coded, 700)[:700] == data[:700] and data.startswith(tiff.lzw_decode(coded[:5_000]))
    assert tiff.lzw_decode(b"") == b"" and tiff.lzw_decode(tiff.lzw_encode(b"")) == b""
    with pytest.raises(ValueError):
        tiff.lzw_decode(b"\0\0\0")  # no cleared table
