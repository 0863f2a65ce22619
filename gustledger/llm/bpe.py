"""Byte-level BPE as a streaming transducer, and its inverse.

Merges inside a piece of text can depend on what follows, but only so far. ``lookahead`` computes
from the merge list how many bytes before a cut can still change: a merge across the cut is
uncertain; it decides whether a later merge left of it may happen, and so on, each step with a
later rule and one token further left. The longest such chain of rules bounds the reach. A token
that ends earlier is stable and is emitted, so a piece of any length needs a window of constant size.

``Encoder`` takes a text in parts of any size and returns ids as they become stable; ``Decoder``
takes ids in parts and returns text as soon as its UTF-8 bytes are complete. Bytes that are no
UTF-8 decode to U+FFFD. Null and empty texts have no ids.
"""

from __future__ import annotations

import codecs
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Fixed value: how the tokenizer cuts text into pieces before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_RUNS = [regex.compile(r"\p{White_Space}+"), regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"[^\p{White_Space}\p{L}\p{N}]+")]
#: What follows a piece can move its end by this many characters at most.
_HOLD = 3
#: Characters taken at once, and the longest piece that is kept whole while it may still grow.
PART = 1 << 16
_NEVER = 1 << 62


@dataclass
class Vocabulary:
    """Byte ids, rank of each mergeable pair (as one number), id each rank makes, bytes of each id, special tokens."""

    byte_ids: list[int]
    ranks: dict[int, int]
    made: list[int]
    bytes_of: list[bytes]
    specials: dict[str, int]
    lookahead: int
    longest: int


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before a cut whose tokens may depend on what follows the cut.

    ``reach[t]``: how far left of the cut the left edge of token ``t`` can lie while it is uncertain
    whether ``t`` is still there, given the rules so far. A rule ``(x, y)`` is uncertain when ``y`` may
    lie across the cut or is uncertain itself; then so are ``x`` and ``xy`` in its place.
    """
    reach: dict[bytes, int] = {}
    most = 0
    for left, right in merges:
        far = reach.get(right, 0) + len(left)
        for token in (left, left + right):
            if far > reach.get(token, 0):
                reach[token] = far
        most = max(most, far)
    return most


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    letters, model = _byte_letters(), content["model"]
    specials = {t["content"]: t["id"] for t in content["added_tokens"]}
    as_bytes = lambda t: bytes(letters[c] for c in t)
    bytes_of = [b""] * (1 + max([*model["vocab"].values(), *specials.values()]))
    for token, i in model["vocab"].items():
        bytes_of[i] = token.encode() if token in specials else as_bytes(token)
    for token, i in specials.items():
        bytes_of[i] = token.encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = model["vocab"]
    ranks = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
    byte_ids = [0] * 256
    for letter, b in letters.items():
        byte_ids[b] = vocab[letter]
    return Vocabulary(byte_ids, ranks, [vocab[a + b] for a, b in pairs], bytes_of, specials, lookahead([(as_bytes(a), as_bytes(b)) for a, b in pairs]), max(map(len, bytes_of)))


def merge(v: Vocabulary, data: bytes) -> list[int]:
    """Ids of a byte string: the earliest rule first, at its leftmost place, until none applies."""
    parts = [v.byte_ids[b] for b in data]
    rank = v.ranks.get
    pairs = [rank(a << 20 | b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == _NEVER:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [v.made[least]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank(parts[i - 1] << 20 | parts[i], _NEVER)
        if i < len(pairs):
            pairs[i] = rank(parts[i] << 20 | parts[i + 1], _NEVER)
    return parts


class Transducer:
    """Ids of one piece that comes in parts."""

    def __init__(self, v: Vocabulary):
        self.v, self.held = v, b""
        self.step = 4 * v.longest

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out: list[int] = []
        at, window = 0, self.step + self.v.lookahead
        while len(self.held) - at >= window:
            end = at + self.step
            for i in merge(self.v, self.held[at : at + window]):
                size = len(self.v.bytes_of[i])
                if at + size > end:
                    break
                out.append(i)
                at += size
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = merge(self.v, self.held), b""
        return out


class _Pieces(dict):
    """Ids of pieces met before, as bytes. Forgets everything when full."""

    def __init__(self, v: Vocabulary, most: int = 200_000):
        super().__init__()
        self.v, self.most = v, most

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) > 64:
            t = Transducer(self.v)
            return np.array(t.feed(data) + t.finish(), "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        out = self[piece] = np.array(merge(self.v, data), "<u4").tobytes()
        return out


class Encoder:
    """Text in parts to ids (little-endian unsigned 32-bit integers). ``finish`` ends a text."""

    def __init__(self, v: Vocabulary):
        self.v, self.pieces = v, _Pieces(v)
        self.carry, self.run, self.kind = "", None, None
        self.split = regex.compile("|".join(map(regex.escape, sorted(v.specials, key=len, reverse=True)))) if v.specials else None

    def feed(self, text: str) -> bytes:
        return self._take(self.carry + text, False)

    def finish(self) -> bytes:
        return self._take(self.carry, True)

    def encode(self, text: str) -> bytes:
        if len(text) <= PART:
            return self._take(text, True)
        return b"".join([*(self.feed(text[i : i + PART]) for i in range(0, len(text), PART)), self.finish()])

    def _take(self, text: str, last: bool) -> bytes:
        self.carry, out, at = "", [], 0
        for m in self.split.finditer(text) if self.split else ():
            out.append(self._part(text[at : m.start()], True))
            out.append(self.v.specials[m[0]].to_bytes(4, "little"))
            at = m.end()
        out.append(self._part(text[at:], last))
        return b"".join(out)

    def _hold(self, text: str) -> int:
        """Characters at the end that may yet become part of something else."""
        longest = max((k for s in self.v.specials for k in range(1, len(s)) if text.endswith(s[:k])), default=0)
        return _HOLD + longest

    def _part(self, text: str, last: bool) -> bytes:
        out = b""
        if self.run is not None:
            m = self.kind.match(text)
            end = m.end() if m else 0
            blank = self.kind is _RUNS[0]
            limit = len(text) - self._hold(text)
            more = not last and end > limit
            safe = max(0, min(end, limit)) if more else end
            if blank and end < len(text):
                safe = max(0, min(safe, end - 1))  # the last blank goes with what follows
            ids = self.run.feed(text[:safe].encode())
            text = text[safe:]
            if more:
                self.carry = text
                return np.array(ids, "<u4").tobytes()
            ids += self.run.finish()
            self.run, out = None, np.array(ids, "<u4").tobytes()
        pieces = PIECES.findall(text)
        if not last and pieces:
            hold, cut, size = self._hold(text), len(pieces), 0
            while cut and size < hold:
                cut -= 1
                size += len(pieces[cut])
            if len(pieces[cut]) > PART:
                long = "".join(pieces[cut:])
                self.kind = next(k for k in _RUNS if k.fullmatch(long[1:2]))
                self.run = Transducer(self.v)
                # The piece's first character may be a blank of another kind.
                started = np.array(self.run.feed(long[:1].encode()), "<u4").tobytes()
                return out + b"".join(map(self.pieces.__getitem__, pieces[:cut])) + started + self._part(long[1:], False)
            self.carry = "".join(pieces[cut:])
            pieces = pieces[:cut]
        return out + b"".join(map(self.pieces.__getitem__, pieces))


class Decoder:
    """Ids in parts to text; an incomplete character waits for its remaining bytes."""

    def __init__(self, v: Vocabulary):
        self.bytes_of = v.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def decode(self, ids: bytes) -> str:
        return "".join([*(self.feed(ids[i : i + 4 * PART]) for i in range(0, len(ids), 4 * PART)), self.finish()])


def _mapped(docs: DataFrame, column: str, added: str, make) -> DataFrame:
    """All columns of ``docs`` plus those that ``make(values of the column)`` gives, batch by batch."""
    new = StructType.fromDDL(added)
    kept = [c for c in docs.columns if c not in new.names]
    frame = docs.select(*kept)
    at = kept.index(column)

    def mapped(batches):
        work = make()
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                yield pa.record_batch([*part.columns, *work(part.column(at))], names=[*kept, *new.names])

    return frame.mapInArrow(mapped, StructType(frame.schema.fields + new.fields))


def encode(docs: DataFrame, v: Vocabulary, text_col: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``ids``, little-endian unsigned 32-bit integers as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def make():
        encoder = Encoder(shared.value)

        def work(texts):
            ids = [encoder.encode(t or "") for t in texts.to_pylist()]
            return pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())

        return work

    return _mapped(docs, text_col, "n_tokens long, ids binary", make)


def decode(docs: DataFrame, v: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids; null ids give an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def make():
        decoder = Decoder(shared.value)
        return lambda ids: [pa.array([decoder.decode(i or b"") for i in ids.to_pylist()], pa.string())]

    return _mapped(docs, ids_col, "decoded string", make)


def round_trip(docs: DataFrame, v: Vocabulary, text_col: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids`` and ``decoded`` in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def make():
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)

        def work(texts):
            ids = [encoder.encode(t or "") for t in texts.to_pylist()]
            return pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([decoder.decode(i) for i in ids], pa.string())

        return work

    return _mapped(docs, text_col, "n_tokens long, ids binary, decoded string", make)
