"""TIFF columns: write payloads as multi-page TIFF, and read the pages of any baseline-like TIFF."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyobs.llm.runtime import in_batches

# Fixed values of the TIFF 6.0 format: tags, field types and their widths, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Most bytes that one byte of a coded strip or tile can stand for, by compression: about 1032 by deflate, 64 a bit or so by
#: runs, and by LZW a code of 9 bits at least for 4096 bytes at most.
EXPANSION = {NONE: 1, LZW: 3700, DEFLATE: 1100, OLD_DEFLATE: 1100, PACKBITS: 64}

#: Most bytes in a page that is read; a larger one is an error.
MOST_BYTES = 256 << 20

#: Bytes in a row of a payload, rows in a page and rows in a strip, when payloads are written.
ROW, PAGE_ROWS, ROWS_IN_STRIP = 576, 512, 64


@dataclass
class Page:
    """One image directory: samples has shape (height, width, samples)."""

    number: int
    width: int
    height: int
    compression: int
    samples: np.ndarray


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three equal bytes and more, at most 128 a packet, and what lies between them."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(raw[1:] != raw[:-1]) + 1)) if len(raw) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(raw))
    long = np.flatnonzero(sizes > 2)
    out, done = bytearray(), 0

    def plain(end: int) -> None:
        for k in range(done, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
        plain(start)
        whole, rest = divmod(n, 128)
        out += bytes((129, data[start])) * whole
        if rest > 2:
            out += bytes((257 - rest, data[start]))
        done = start + n - (rest if rest < 3 else 0)
    plain(len(data))
    return bytes(out)


def _lzw_widths(first: int, n: int) -> np.ndarray:
    """Bits of n codes, from the first-th after a cleared table on: widths grow one code early, to 12."""
    following = 258 + np.arange(first, first + n)
    return 9 + (following >= 512) + (following >= 1024) + (following >= 2048)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends, widths grow one code early.

    A code's width follows from its place after the last 256, so codes are taken from the bits many at a time.
    """
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))).astype(np.uint32)
    out, table, last = bytearray(), [], b""
    at, place, step = 0, 0, 64  # the next code's first bit, its place after the last 256, codes taken at once
    while True:
        widths = _lzw_widths(place, step)
        ends = at + np.cumsum(widths)
        widths = widths[: np.searchsorted(ends, 8 * len(data), "right")]
        if not len(widths):
            return bytes(out)
        starts = ends[: len(widths)] - widths
        byte = starts >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (starts & 7) - widths).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
        special = np.flatnonzero(codes >> 1 == 128)
        n = int(special[0]) if len(special) else len(codes)
        for code in codes[:n].tolist():
            if most is not None and len(out) >= most:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif last and code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code beyond the table")
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
        at, place, step = int(ends[n - 1]) if n else at, place + n, min(2 * step, 4096)
        if n < len(codes):
            if codes[n] == 257 or (most is not None and len(out) >= most):
                return bytes(out)
            at, place, step = int(ends[n]), 0, 64
            table, last = [bytes((i,)) for i in range(256)] + [b"", b""], b""


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [256], [np.array([9])]
    table: dict[int, int] = {}  # a known word's code and the next byte, to the code of both
    find, following, word, done = table.get, 258, -1, 1
    for byte in data:
        if word < 0:
            word = byte
            continue
        longer = find(key := word << 8 | byte)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        table[key] = following
        following += 1
        word = byte
        if following == 4094:
            codes.append(256)
            widths.append(_lzw_widths(0, len(codes) - done))
            table.clear()
            following, done = 258, len(codes)
    if word >= 0:
        codes.append(word)
    codes.append(257)
    widths.append(_lzw_widths(0, len(codes) - done))
    high, width = np.array(codes, np.uint16), np.concatenate(widths)
    high <<= (16 - width).astype(np.uint16)  # a code's bits first, then bits to leave out
    bits = np.unpackbits(high.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) < width[:, None]]).tobytes()


def inflate(data: bytes, most: int | None = None) -> bytes:
    """The inflated data, of which no more than `most` bytes are made."""
    return zlib.decompress(data) if most is None else zlib.decompressobj().decompress(data, max(1, most))


#: Each takes the coded bytes and how many bytes are wanted at most.
DECODERS = {NONE: lambda data, most=None: data, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda data: zlib.compress(data, 1), PACKBITS: packbits_encode}


def read_pages(data: bytes) -> Iterator[Page]:
    """Each image directory of a TIFF, either byte order, strips or tiles, 8- or 16-bit samples, predictor 1 or 2."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, number, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while at:
        if at in seen:
            raise ValueError("image directories form a ring")
        seen.add(at)
        fields: dict[int, tuple] = {}
        count = struct.unpack_from(order + "H", data, at)[0]
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPES:
                if n > len(data):
                    raise ValueError("a field has more values than the file has bytes")
                form = f"{order}{n * len(TYPES[kind])}{TYPES[kind][0]}"
                place = at + 10 + 12 * k
                fields[tag] = struct.unpack_from(form, data, place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, place)[0])
        yield _page(data, order, fields, number)
        at, number = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0], number + 1


def _page(data: bytes, order: str, fields: dict[int, tuple], number: int) -> Page:
    one = lambda tag, default=None: fields[tag][0] if tag in fields else default
    width, height, depth = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits = fields.get(BITS, (1,))
    if width is None or height is None or len(set(bits)) > 1 or bits[0] not in (8, 16):
        raise ValueError("only 8- and 16-bit samples of one width are read")
    if one(PREDICTOR, 1) not in (1, 2) or one(COMPRESSION, NONE) not in DECODERS:
        raise ValueError("predictor or compression isn't known")
    kind = np.dtype(order + ("u1" if bits[0] == 8 else "u2"))
    planes = depth if one(PLANAR, 1) == 2 else 1
    inner = depth // planes
    tiled = TILE_OFFSETS in fields
    if tiled:
        across, down = one(TILE_WIDTH), one(TILE_HEIGHT)
        offsets, counts = fields[TILE_OFFSETS], fields[TILE_COUNTS]
    else:
        across, down = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = fields.get(STRIP_OFFSETS, ()), fields.get(STRIP_COUNTS, ())
    if width < 1 or height < 1 or across < 1 or down < 1 or not 1 <= depth <= 1 << 16:
        raise ValueError("a size isn't positive")
    if len(offsets) != len(counts):
        raise ValueError("offsets and lengths of strips or tiles differ in number")
    size, held = width * height * depth * kind.itemsize, min(len(data), sum(counts)) * EXPANSION[one(COMPRESSION, NONE)]
    if size > min(held, MOST_BYTES) or across * down * inner * kind.itemsize > MOST_BYTES:
        raise ValueError("the image is larger than its strips or tiles can hold, or than what is read")
    image = np.zeros((planes, height, width, inner), kind.newbyteorder("="))
    columns = max(1, -(-width // max(across, 1)))
    in_plane = columns * max(1, -(-height // max(down, 1)))
    for k, (offset, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(k, in_plane)
        top, left = place // columns * down, place % columns * across
        rows = down if tiled else min(down, height - top)
        raw = data[offset : offset + n]
        if one(FILL_ORDER, 1) == 2:
            raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).tobytes()
        if plane >= planes:
            raise ValueError("there are more strips or tiles than the image has room for")
        wanted = rows * across * inner * kind.itemsize
        block = np.frombuffer(DECODERS[one(COMPRESSION, NONE)](raw, wanted), kind, rows * across * inner).reshape(rows, across, inner)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        image[plane, top : top + rows, left : left + across] = block[: height - top, : width - left]
    return Page(number, width, height, one(COMPRESSION, NONE), np.moveaxis(image, 0, 2).reshape(height, width, depth))


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0, order: str = "<") -> bytes:
    """A TIFF of 8-bit pages of shape (height, width), in strips or, if tile is given, square tiles."""
    parts: list[bytes] = [(b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)]
    size, link = 8, 4  # where the next part goes, where the link to the next directory stands
    links: list[tuple[int, int]] = []
    for page in pages:
        height, width = page.shape
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = page
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            blocks = [page[y : y + ROWS_IN_STRIP] for y in range(0, height, ROWS_IN_STRIP)]
        if predictor == 2:
            blocks = [np.diff(b, axis=1, prepend=np.uint8(0)) for b in blocks]
        coded = [ENCODERS[compression](np.ascontiguousarray(b).tobytes()) for b in blocks]
        offsets = [size + sum(map(len, coded[:k])) for k in range(len(coded))] if len(coded) < 2 else (size + np.concatenate(([0], np.cumsum([len(c) for c in coded])[:-1]))).tolist()
        parts += coded
        size += sum(map(len, coded))
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            entries += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, [len(c) for c in coded])]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [ROWS_IN_STRIP]), (STRIP_COUNTS, 4, [len(c) for c in coded])]
        extra, body = b"", b""
        if size % 2:
            parts.append(b"\0")
            size += 1
        after = size + 2 + 12 * len(entries) + 4
        for tag, kind, values in sorted(entries):
            packed = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(packed) > 4:
                place, extra = struct.pack(order + "I", after + len(extra)), extra + packed
            else:
                place = packed.ljust(4, b"\0")
            body += struct.pack(order + "HHI", tag, kind, len(values)) + place
        links.append((link, size))
        link = size + 2 + len(body)
        parts.append(struct.pack(order + "H", len(entries)) + body + b"\0\0\0\0" + extra)
        size = after + len(extra)
    out = bytearray(b"".join(parts))
    for place, target in links:
        struct.pack_into(order + "I", out, place, target)
    return bytes(out)


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of ROW."""
    return raw + b"\xff" * (-len(raw) % ROW if raw else ROW)


def to_tiff(payload: bytes, **form) -> bytes:
    """A payload, a multiple of ROW, as pages of PAGE_ROWS rows of 8-bit samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return write_pages([rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)], **form)


#: Forms in which payloads are written, of any size: compression, predictor, tile (0: strips) and byte order.
FORMS = [(c, p, t, o) for c in (DEFLATE, PACKBITS, LZW, NONE) for p in (1, 2) for t in (0, 64) for o in "<>"]


def form_of(payload: bytes) -> dict:
    """How a payload is written, by the first bits of its checksum alone: every compression, layout and byte order occurs."""
    at = zlib.crc32(payload) * len(FORMS) >> 32
    return dict(zip(("compression", "predictor", "tile", "order"), FORMS[at], strict=True))


def features(pages: list[Page]) -> str:
    """Page count, sample count, mean, deviation and entropy of the samples' histogram."""
    counts = sum(np.bincount(p.samples.ravel(), minlength=256) for p in pages)
    n, values = counts.sum(), np.arange(256)
    mean = (counts * values).sum() / n
    share = counts[counts > 0] / n
    return f"pages={len(pages)};samples={n};mean={mean:.6f};std={np.sqrt((counts * (values - mean) ** 2).sum() / n):.6f};entropy={-(share * np.log2(share)).sum():.6f}"


def media_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as a TIFF, read its pages back and digest what was read.

    A null text counts as empty: one row of bytes 255. The text's checksum chooses compression, predictor,
    strips or tiles and byte order (see form_of). Returns id_col, n_bytes, payload_bytes,
    payload_sha256 and tail_crc32 (of the bytes read back), media_bytes, media_sha256, n_pages, feature.
    Each row depends on its text alone. Rows with null or repeated ids are all kept; other columns are
    ignored; an empty table gives an empty one.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = to_tiff(payload := padded(raw), **form_of(payload))
        pages = list(read_pages(media))
        back = b"".join(p.samples.tobytes() for p in pages)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(pages), features(pages)

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_pages", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if made := [one(t) for t in batch.column(1).to_pylist()]:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*made, strict=True))], names=["id", *names])

    kind = slim.schema["id"].dataType.simpleString()
    return in_batches(slim, run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pages long, feature string").withColumnRenamed("id", id_col)


def page_rows(images: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row for each page of each TIFF: id, page, width, height, samples_per_pixel, bits, data (row-major bytes), error.

    A null or unreadable file gives one row with page -1 and the reason in error; pages before the flaw are kept.
    """
    slim = images.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    kind = slim.schema["id"].dataType.simpleString()
    names = ["id", "page", "width", "height", "samples_per_pixel", "bits", "data", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, data = [], batch.column(1)[k].as_py()
                try:
                    for p in read_pages(data or b""):
                        rows.append((p.number, p.width, p.height, p.samples.shape[2], p.samples.itemsize * 8, p.samples.tobytes(), None))
                except (ValueError, ArithmeticError, MemoryError, struct.error, zlib.error, LookupError, TypeError) as e:
                    rows.append((-1, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                types = [pa.int32()] * 5 + [pa.binary(), pa.string()]
                ids = pa.array([batch.column(0)[k].as_py()] * len(rows), batch.column(0).type)
                if rows:
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return in_batches(slim, run, f"id {kind}, page int, width int, height int, samples_per_pixel int, bits int, data binary, error string").withColumnRenamed("id", id_col)
