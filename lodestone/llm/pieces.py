"""SentencePiece BPE encoding and decoding by backtracking over longest matches.

A piece sequence is the merge result of a text exactly when every adjacent pair of pieces is the merge
result of its own concatenation, and when each piece is the merge result of itself. The encoder therefore
takes, at each position, the longest matching piece that goes with the piece before it; where none does it
steps back and marks the position in a bitfield, so that no position is tried twice after it failed.

Nulls and empty texts encode to the begin and end ids only and decode to the empty string. Texts of any
length are encoded whole. Repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
import weakref
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame

from lodestone.llm.tasks import per_row

SPACE = "▁"
NEVER = (float("inf"), 0)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("replace_each_byte", _each_byte)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a protobuf message: the file format of a SentencePiece model."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = varint(at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


class PieceCodec:
    """One BPE model with byte fallback. It holds two bounded memos: of chunks and of pairs of pieces."""

    def __init__(self, model: bytes, memo_chunks: int = 500_000, memo_pairs: int = 500_000):
        import ahocorasick

        self.pieces, self.kinds, scores = [], [], []
        prefix, squeeze, charsmap, escape = 1, 1, b"", 1
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a BPE model")
            elif field == 3:
                spec = dict(_fields(value))
                charsmap, prefix, squeeze, escape = spec.get(2, b""), spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
        if charsmap or squeeze or not escape or not prefix or USER_DEFINED in self.kinds:
            raise ValueError("only the identity normaliser with a leading space mark is supported")
        self.rank = {p: (-s, i) for i, (p, s, k) in enumerate(zip(self.pieces, scores, self.kinds, strict=True)) if k == NORMAL}
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece spans words")
        self.pairs, self.memo_pairs = {}, memo_pairs
        # only pieces that merging can reach belong in the automaton
        reached = {p: i for p, (_, i) in self.rank.items() if len(p) == 1 or self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in reached.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.shorter: list[tuple[int, int] | None] = [None] * len(self.pieces)  # the longest piece that begins this one
        for p, i in reached.items():
            self.shorter[i] = next(((n, reached[p[:n]]) for n in range(len(p) - 1, 0, -1) if p[:n] in reached), None)
        self.chunks = self._splitter()
        self.memo = _Memo(self._chunk_bytes, memo_chunks)
        self.surface = [self._surface(p, k) for p, k in zip(self.pieces, self.kinds, strict=True)]

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def _splitter(self):
        """Cuts a text where no piece can cross: before a run of space marks, and around runs of marks that no
        piece joins to other characters. The vocabulary decides which cuts are safe."""
        joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n")
        while bad := {m for a, b in joined for m, x in ((b, a), (a, b)) if m in marks and x not in marks and not (x == SPACE and m == b)}:
            marks -= bad
        m = re.escape("".join(sorted(marks)))
        return re.compile(f"{SPACE}+(?:[{m}]+|[^{SPACE}{m}]*)|[^{SPACE}{m}]+|[{m}]+" if marks else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def merge(self, text: str) -> list[str]:
        """Merges by definition: the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        parts, rank = list(text), self.rank
        joined = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while joined:
            best = min(joined)[0]
            if best == NEVER[0]:
                break
            i = next(k for k, r in enumerate(joined) if r[0] == best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(joined):
                joined[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stay apart when their concatenation is merged anew."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.memo_pairs:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.pairs[key] = self.merge(a + b) == [a, b]
        return found

    def _known(self, longest: list[tuple[int, int] | None]) -> list[int]:
        """Ids of a stretch of characters that are all pieces; `longest`: of the matches from each position."""
        pairs, shorter, size = self.pairs, self.shorter, len(longest)
        failed = 0  # bit i: no valid encoding passes through position i
        ids: list[int] = []
        tried: list[tuple[int, int] | None] = [longest[0]]  # the match to try next, for each piece taken and the one to come
        at = 0
        while at < size:
            option = tried[-1]
            while option:
                length, piece = option
                if not failed >> (at + length) & 1:
                    if not ids:
                        break
                    fits = pairs.get(ids[-1] << 32 | piece)
                    if fits or fits is None and self.compatible(ids[-1], piece):
                        break
                option = shorter[piece]
            if option:
                tried[-1] = option
                ids.append(piece)
                at += length
                if at < size:
                    tried.append(longest[at])
            else:
                failed |= 1 << at
                tried.pop()
                length, piece = tried[-1]
                ids.pop()
                at -= length
                tried[-1] = shorter[piece]
        return ids

    def _chunk_ids(self, chunk: str) -> list[int]:
        longest: list[tuple[int, int] | None] = [None] * len(chunk)
        for end, match in self.automaton.iter(chunk):
            longest[end - match[0] + 1] = match  # ends grow, so the longest match comes last
        if None not in longest:
            return self._known(longest)
        ids, start = [], 0
        for at, match in enumerate([*longest, None]):
            if match is None:  # no piece starts here: the character falls back to bytes and nothing merges over it
                if start < at:
                    ids += self._known(longest[start:at])
                ids += [self.byte_ids[b] for b in chunk[at : at + 1].encode("utf-8", "surrogatepass")]
                start = at + 1
        return ids

    def _chunk_bytes(self, chunk: str) -> bytes:
        ids = self._chunk_ids(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        body = b"".join(map(self.memo.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE)))) if text else b""
        return struct.pack("<I", self.bos) + body + struct.pack("<I", self.eos)

    def encode(self, text: str | None) -> list[int]:
        data = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD one by one. A control id ends a run of bytes."""
        start, stop = 0, len(ids)
        while start < stop and self.kinds[ids[start]] == CONTROL:
            start += 1
        while start < stop and self.kinds[ids[stop - 1]] == CONTROL:
            stop -= 1
        if start == stop:
            return ""
        surfaces = list(map(self.surface.__getitem__, ids[start:stop]))
        if self.kinds[ids[start]] == NORMAL and self.pieces[ids[start]].startswith(SPACE):
            surfaces[0] = surfaces[0][1:]
        if b"" not in surfaces[1:]:
            return b"".join(surfaces).decode("utf-8", "replace_each_byte")
        runs: list[list[bytes]] = [[]]
        for surface in surfaces:
            runs[-1].append(surface) if surface else runs.append([])
        return "".join(b"".join(run).decode("utf-8", "replace_each_byte") for run in runs)


class _Memo(dict):
    """Chunk to bytes of ids. When full, it becomes the older half, out of which chunks in use come back; long
    chunks aren't kept."""

    def __init__(self, make, most: int, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most // 2, longest, {}

    def __missing__(self, chunk: str) -> bytes:
        value = self.older.get(chunk) or self.make(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value


_CODECS: dict[bytes, PieceCodec] = {}
_PASSING: weakref.WeakValueDictionary[bytes, PieceCodec] = weakref.WeakValueDictionary()


def codec(model: bytes, passing: bool = False) -> PieceCodec:
    """The codec of a model, built once in each Python worker. One that is `passing` has smaller memos and goes with the
    last task that uses it: a worker outlasts its tasks, and its memory is that of the stages that follow."""
    key = hashlib.sha256(model).digest()
    if passing:
        found = _PASSING.get(key)
        if found is None:
            found = _PASSING[key] = PieceCodec(model, 150_000, 150_000)
        return found
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    """The model file, read by the driver; its size is that of a vocabulary and does not grow with the data."""
    with open(path, "rb") as f:
        return f.read()


def _encoding(model):
    import numpy as np

    c = codec(model.value, passing=True)
    return lambda text: (np.frombuffer(c.encode_bytes(text), "<i4"),)


def encode(docs: DataFrame, model: bytes, kept: list[str], text: str = "text") -> DataFrame:
    """The columns `kept` and `ids` (array<int>, with begin and end ids); null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return per_row(docs, kept, [text], "ids array<int>", partial(_encoding, shared))


def _decoding(model):
    c = codec(model.value, passing=True)
    return lambda ids: (c.decode(ids or []),)


def decode(encoded: DataFrame, model: bytes, kept: list[str], ids: str = "ids") -> DataFrame:
    """The columns `kept` and `decoded`, the text of the ids; null ids decode to the empty string."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    return per_row(encoded, kept, [ids], "decoded string", partial(_decoding, shared))


def _round_trip(model):
    c = codec(model.value)

    def run(text: str | None) -> tuple:
        data = c.encode_bytes(text)
        decoded = c.decode(struct.unpack(f"<{len(data) // 4}I", data))
        return len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()

    return run


def round_trip_digests(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, n_tokens, ids_sha256, decoded_sha256: every text encoded and its ids decoded in the same task, so that
    the ids, three times the text in size, don't cross between Python and the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return per_row(docs, [doc_id], [text], "n_tokens long, ids_sha256 string, decoded_sha256 string", partial(_round_trip, shared))
