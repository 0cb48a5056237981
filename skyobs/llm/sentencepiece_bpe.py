"""Exact encoding and decoding with a merge-type SentencePiece model, by backtracking."""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyobs.llm.runtime import in_batches

SPACE = "▁"
#: Spaces stand only at the start of a piece, so that no token spans a place where a space follows something else.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Most chunks and token pairs that a worker remembers (half are dropped then), and the longest chunk that it does.
REMEMBERED, LONGEST = 400_000, 48


class Codec:
    """A merge-type model with byte fallback, identity normalisation and a dummy prefix.

    A token sequence is what merging by score gives if and only if each adjacent pair is what merging gives
    for the pair's own text. So the encoder walks left to right: it takes the longest piece at a place (by Aho-Corasick) whose pair with the token before it survives re-merging, falls back to shorter ones, and when none fits goes
    back a token and marks the place in a bitfield of failed positions, which is not entered again. The
    time is linear in the text. Characters without a piece become byte tokens, which no merge crosses.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        count = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.texts: list[str | None] = [None] * count
        self.bytes_of: dict[int, bytes] = {}
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i in range(count):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} holds a space after other characters; chunks can't be cut at spaces")
                self.ids[piece], self.scores[piece], self.texts[i] = i, sp.get_score(i), piece
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        # pieces that merging doesn't give for their own text never occur
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        #: The longest piece on the way to each state of the automaton's trie.
        self.best = {piece[:k]: -1 for piece in self.ids for k in range(len(piece) + 1)}
        for state in sorted(self.best, key=len):
            self.best[state] = self.automaton.get(state, self.best.get(state[:-1], -1) if state else -1)
        self.longest = max(map(len, self.ids), default=1)
        self.lengths = [len(t) if t else 0 for t in self.texts]
        self.shorter = [-1] * count  # the longest piece that starts another piece
        for piece, i in self.ids.items():
            self.shorter[i] = self.best[piece[:-1]]
        # a model that normalises texts, merges otherwise or has no dummy prefix would show in one of these
        for probe in ("  A\u00c5\uff21\u00a0e\u0301  b\t\r\n", "\u2581\ufb01 \u3000\u200b\u00bd", "The same words, again and again."):
            if sp.encode(probe, add_bos=True, add_eos=True) != self.encode(probe):
                raise ValueError("the model's normalisation isn't the identity with a dummy prefix, or it isn't of the merge type")

    def merged(self, text: str) -> list[str]:
        """Symbols of a short text after merging the best-scored neighbours, leftmost first, again and again."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens' joint text merges back into the two."""
        a, b = self.texts[left], self.texts[right]
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def encode_chunk(self, chunk: str) -> list[int]:
        n, walk, best, lengths, shorter, pairs = len(chunk), self.automaton.longest_prefix, self.best.get, self.lengths, self.shorter, self.pairs.get
        failed = bytearray(n + 1)
        tokens: list[int] = []  # -1: a character without a piece
        at, left = 0, -1
        following = -2  # the candidate at this place; -2: look for the longest
        while at < n:
            if following == -2:
                ahead = chunk[at : at + self.longest]
                following = best(ahead[: walk(ahead)], -1)
                if following == -1:
                    tokens.append(-1)
                    left = -1
                    at += 1
                    following = -2
                    continue
            while following >= 0:
                if not failed[at + lengths[following]]:
                    if left < 0:
                        break
                    fit = pairs(left << 32 | following)
                    if fit or fit is None and self.fits(left, following):
                        break
                following = shorter[following]
            if following >= 0:
                tokens.append(following)
                at += lengths[following]
                left, following = following, -2
            else:
                failed[at] = 1
                if left < 0:
                    raise ValueError(f"no encoding for {chunk[:60]!r}")
                following = shorter[tokens.pop()]
                at -= lengths[left]
                left = tokens[-1] if tokens else -1
        return tokens if -1 not in tokens else self._with_bytes(chunk, tokens)

    def _with_bytes(self, chunk: str, tokens: list[int]) -> list[int]:
        lengths = self.lengths
        out, at = [], 0
        for i in tokens:
            if i >= 0:
                out.append(i)
                at += lengths[i]
            else:
                out.extend(self.byte_ids[b] for b in chunk[at].encode())
                at += 1
        return out

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> list[int]:
        """Token ids of a whole text; an empty text has none but the begin and end ids."""
        body = [i for chunk in self.split(text) for i in self.encode_chunk(chunk)]
        return [self.bos] * bos + body + [self.eos] * eos

    @staticmethod
    def split(text: str) -> list[str]:
        return CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def surface(self, ids: Iterable[int]) -> bytes:
        """Bytes of the tokens: spaces for space marks, raw bytes for byte tokens, nothing for begin and end."""
        try:
            return "".join(map(self.texts.__getitem__, ids)).replace(SPACE, " ").encode()
        except TypeError:  # a token without a text
            out = []
        for i in ids:
            if i in self.bytes_of:
                out.append(self.bytes_of[i])
            elif i == self.unk:
                out.append(" ⁇ ".encode())
            elif self.texts[i] is not None:
                out.append(self.texts[i].replace(SPACE, " ").encode())
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the dummy space at the start goes, each byte that is no UTF-8 becomes U+FFFD."""
        body = [i for i in ids if i not in (self.bos, self.eos)]
        raw = self.surface(body)
        if body and self.texts[body[0]] is not None and raw[:1] == b" ":
            raw = raw[1:]
        return valid(raw)

    def _forget(self) -> None:
        """Keep what was remembered since the last time, drop what is older."""
        self.old, self.chunks = self.chunks, {}
        self.odd = {k: v for k, v in self.odd.items() if k in self.old}

    def both(self, text: str) -> tuple[bytes, str]:
        """Little-endian ids with begin and end, and the text decoded from them; chunks are remembered.

        `chunks` has the ids of a chunk; what its tokens decode to is in `odd` where that isn't the chunk itself.
        """
        known, odd = self.chunks, self.odd
        parts = self.split(text)
        ids = list(map(known.get, parts))
        if None in ids or odd:
            for k, chunk in enumerate(parts):
                got = ids[k]
                if got is None:
                    got = known.get(chunk) or self.old.get(chunk)
                    if got is not None:
                        known[chunk] = got
                if got is None:
                    tokens = self.encode_chunk(chunk)
                    got = array("I", tokens).tobytes()
                    raw = self.surface(tokens).decode(errors="surrogateescape")
                    if len(chunk) <= LONGEST:
                        if len(known) >= REMEMBERED:
                            self._forget()
                            known, odd = self.chunks, self.odd
                        known[chunk] = got
                        if raw != chunk.replace(SPACE, " "):
                            odd[chunk] = raw
                    parts[k] = raw
                elif odd:
                    parts[k] = odd.get(chunk, chunk)
                ids[k] = got
        raw = "".join(parts).replace(SPACE, " ")
        return array("I", [self.bos]).tobytes() + b"".join(ids) + array("I", [self.eos]).tobytes(), valid(raw.encode(errors="surrogateescape")[1:])


def valid(raw: bytes) -> str:
    """Decode UTF-8; every byte of a malformed sequence becomes one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[at : at + e.start].decode() + "�")
                at += e.start + 1
        return "".join(out)


@functools.lru_cache(maxsize=1)
def codec(model: bytes) -> Codec:
    return Codec(model)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with begin and end ids, then decode it.

    Returns id_col, ids (array of int) and decoded. A null text counts as empty: [begin, end] and ''.
    Other columns are ignored; rows with null or repeated ids are all kept; an empty table gives an empty one.
    """
    return _mapped(docs, path, id_col, text_col, "ids array<int>, decoded string", lambda ids, text: (memoryview(ids).cast("I").tolist(), text))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like encode_decode, with n_tokens, ids_sha256 and decoded_sha256 in place of the contents."""
    return _mapped(
        docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()),
    )


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like digests, with ids (array of int) besides."""
    return _mapped(
        docs, path, id_col, text_col, "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, text: (memoryview(ids).cast("I").tolist(), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()),
    )


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, returns: str, make) -> DataFrame:
    """Rows of make(ids, decoded) beside the id. The model is read on the driver and travels with the code: it is one file of bounded size."""
    model = model_bytes(path)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    names = [x.split()[0] for x in returns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(model)
        for batch in batches:
            made = [make(*encoder.both(t or "")) for t in batch.column(1).to_pylist()]
            if made:
                columns = list(zip(*made, strict=True))
                arrays = [pa.array(c, pa.list_(pa.int32()) if isinstance(c[0], list) else None) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *names])

    return in_batches(slim, run, f"id {id_type}, {returns}").withColumnRenamed("id", id_col)
