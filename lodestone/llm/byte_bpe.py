"""Byte-level BPE encoding and decoding over a contiguous array of ranks.

A text is cut at special tokens and then into words by the pattern of its vocabulary. A short word holds its parts, each
up to the next boundary, and the ranks of adjacent parts in two lists: the least rank is found by a scan, the boundary
there is deleted and the ranks beside it are looked up anew, until no pair has a rank. A scan for each merge is quadratic in the
length of a word, so words above `longest` bytes, such as runs of one character, take the same merges from a heap.

Nulls and empty texts have no ids and decode to the empty string. Texts of any length are encoded whole, repeated rows
give repeated results, and other columns of the input, whatever their names, are ignored. Ids that decode to bytes
which are no UTF-8 give U+FFFD for each ill-formed sequence.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from functools import partial

from pyspark.sql import DataFrame

from lodestone.llm.pieces import _Memo
from lodestone.llm.tasks import per_row

#: Code points of letters and numbers that came after Unicode 16, the version the vocabulary's library
#: cuts words by. Newer pattern libraries take them for letters and numbers, where that one does not.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Fixed value: how the vocabulary cuts words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"

NEVER = 1 << 62
#: Ids and ranks are below this power of two.
BITS = 20
MASK = (1 << BITS) - 1
#: Texts without later characters than this, most Latin ones, are cut by a pattern of plain ranges.
LOW = 0x24F
SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteCodec:
    """One byte-level BPE vocabulary, with a bounded memo of words."""

    def __init__(self, vocabulary: bytes, longest: int = 256, memo_words: int = 500_000):
        import regex

        given = json.loads(vocabulary)
        model, cut = given["model"], given["pre_tokenizer"] or {}
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or given["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or (given["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without a normaliser or a prefix is supported")
        byte = _byte_characters()
        raw = lambda piece: bytes(byte[c] for c in piece)
        self.ids = {raw(piece): i for piece, i in model["vocab"].items()}
        pairs = ((raw(a), raw(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]))
        if max(len(self.ids), len(model["merges"])) > MASK:
            raise ValueError("too large a vocabulary")
        #: two ids side by side: the rank of their merge, and in the lower bits the id that it makes
        self.ranks = {self.ids[a] << BITS | self.ids[b]: r << BITS | self.ids[a + b] for r, (a, b) in enumerate(pairs)}
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.longest = longest
        self.surface = {i: piece for piece, i in self.ids.items()}
        self.special: dict[str, bytes] = {}
        for token in given["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError("an added token with conditions")
            self.special[token["content"]] = struct.pack("<I", token["id"])
            self.surface[token["id"]] = token["content"].encode()
        first = sorted(self.special, key=len, reverse=True)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, first)) + ")").split if first else lambda text: [text]
        later = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
        self.has_later = re.compile(f"[{later}]").search
        self.words = regex.compile(WORDS.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]")).findall
        old = lambda kind: f"(?:(?![{later}])\\p{{{kind}}})"
        self.words_with_later = regex.compile(WORDS.format(letter=old("L"), number=old("N"), other=rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])")).findall
        low = {k: "".join(re.escape(chr(c)) for c in range(LOW + 1) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        plain_words = WORDS.replace(r"\s+(?!\S)|\s+", f"[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        self.low_words = re.compile(plain_words.format(letter=f"[{low['L']}]", number=f"[{low['N']}]", other=f"[^{SPACES}{low['L']}{low['N']}]")).findall
        self.has_high = re.compile(f"[^\0-{chr(LOW)}]").search
        self.memo = _Memo(self._word_bytes, memo_words)

    def scanned(self, word: bytes) -> list[int]:
        """Ids of the merged parts of a short word."""
        get, parts = self.ranks.get, [self.bytes[b] for b in word]
        ranks = [get(a << BITS | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = least & MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << BITS | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(parts[i] << BITS | parts[i + 1], NEVER)
        return parts

    def queued(self, word: bytes) -> list[int]:
        """The same ids from a heap of pairs: (rank and id, start, both ids). A pair is stale once a part has changed."""
        size, parts = len(word), [self.bytes[b] for b in word]  # by their starts, -1 where none starts any more
        after = list(range(1, size + 1))  # the start of the part behind each
        before = list(range(-1, size))  # and of the one in front of it
        heap = []

        def push(start: int) -> None:
            if after[start] < size:
                pair = parts[start] << BITS | parts[after[start]]
                found = self.ranks.get(pair)
                if found is not None:
                    heapq.heappush(heap, (found >> BITS, start, found & MASK, pair))

        for i in range(size - 1):
            push(i)
        while heap:
            _, start, made, pair = heapq.heappop(heap)
            other = after[start]
            if other >= size or parts[start] << BITS | parts[other] != pair or parts[start] < 0:
                continue
            parts[start], parts[other] = made, -1
            after[start] = after[other]
            before[after[other]] = start
            if start:
                push(before[start])
            push(start)
        return [p for p in parts if p >= 0]

    def _word_bytes(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        ids = self.scanned(data) if len(data) <= self.longest else self.queued(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = self.low_words if not self.has_high(text) else self.words_with_later if self.has_later(text) else self.words
        out = []
        for part in self.cut_special(text):
            special = self.special.get(part)
            out.append(b"".join(map(self.memo.__getitem__, words(part))) if special is None else special)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        data = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; ids outside the vocabulary are passed over."""
        return b"".join([self.surface.get(i, b"") for i in ids]).decode("utf-8", "replace")


_CODECS: dict[bytes, ByteCodec] = {}


def codec(vocabulary: bytes) -> ByteCodec:
    """The codec of a vocabulary, built once in each Python worker."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteCodec(vocabulary)
    return _CODECS[key]


def _encoding(vocabulary):
    import numpy as np

    c = codec(vocabulary.value)
    return lambda text: (np.frombuffer(c.encode_bytes(text), "<i4"),)


def encode(docs: DataFrame, vocabulary: bytes, kept: list[str], text: str = "text") -> DataFrame:
    """The columns `kept` and `ids` (array<int>); `vocabulary` is the file of a tokenizer, read by the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return per_row(docs, kept, [text], "ids array<int>", partial(_encoding, shared))


def _decoding(vocabulary):
    c = codec(vocabulary.value)
    return lambda ids: (c.decode(ids or []),)


def decode(encoded: DataFrame, vocabulary: bytes, kept: list[str], ids: str = "ids") -> DataFrame:
    """The columns `kept` and `decoded`, the text of the ids; null ids decode to the empty string."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    return per_row(encoded, kept, [ids], "decoded string", partial(_decoding, shared))


def _round_trip(vocabulary):
    c = codec(vocabulary.value)

    def run(text: str | None) -> tuple:
        data = c.encode_bytes(text)
        decoded = c.decode(struct.unpack(f"<{len(data) // 4}I", data))
        return len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()

    return run


def round_trip_digests(docs: DataFrame, vocabulary: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, n_tokens, ids_sha256, decoded_sha256: every text encoded and its ids decoded in the task that reads it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return per_row(docs, [doc_id], [text], "n_tokens long, ids_sha256 string, decoded_sha256 string", partial(_round_trip, shared))
