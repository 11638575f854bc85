"""Importance resampling of documents towards a target collection, by hashed runs of words.

Each run of one to `longest` consecutive words is a feature and falls into one of `buckets` buckets by its CRC-32. A
bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, in floored thousandths; a
document's weight is the floored mean of its features' gains, looked up in one array. Weight plus Gumbel noise, keyed by
the seed and the id, is its score; the highest scores are drawn without replacement.

The draw sorts nothing whole. Every task sorts its eligible rows into a run and cuts the run at boundaries that split
all scores into ranges of about equal size. The pieces are kept as a table in the shared folder; how many rows each
range has says which ranges are drawn whole, which one in part, and the rank that each begins at. Each range is then
merged in a task of its own by a tournament tree over its runs. Pieces come to it in the order of their heads and are
opened as the merge reaches them, so a task holds one open block for each run and no whole range. Ranges behind the last
drawn rank are not merged, and the range that holds it stops there.

Null texts have no words, no features and weight 0. A null id is hashed like an empty one and ranks behind equal scores
with ids. Rows that repeat an id have the same noise, and each is drawn by itself. An empty corpus gives no rows; an
empty target gives gains against the corpus alone. Texts of any length are read whole, in blocks. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tasks import bounded_batches, per_row, removed, written

#: Bytes as they count: A to Z in lower case, digits, a to z and what is not ASCII; all others end a word.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

ROW = [("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())]
SCORED = "doc_id long, n_features long, weight long, score long"
PIECE = "part int, n long, head_score long, head_null int, head_id long, docs array<struct<doc_id: long, n_features: long, weight: long, score: long>>"


def word_blocks(text: str | None, carried: int, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text in blocks of about `size` bytes, each after the last `carried` words of those before it, and
    how many such words there are."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    at, last = 0, []
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        yield len(last), last + words
        last, at = (last + words)[-carried:] if carried else [], end


def features(text: str | None, longest: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of a text: its words, and the CRC-32 of every run of one to `longest` words that ends in it."""
    for old, words in word_blocks(text, longest - 1):
        ends = list(map(crc32, words))
        found = ends[old:]
        for n in range(1, longest):
            ends = [crc32(word, crc32(b" ", run)) for run, word in zip(ends, words[n:], strict=False)]
            found += ends[max(0, old - n) :]
        yield len(words) - old, np.array(found, np.uint32)


def _counted(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    total, waiting, size = np.zeros(buckets, np.int64), [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for _, found in features(text, longest):
                waiting.append(found)
                size += len(found)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(waiting) % buckets, minlength=buckets)
                    waiting, size = [], 0
    if waiting:
        total += np.bincount(np.concatenate(waiting) % buckets, minlength=buckets)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])


def bucket_counts(docs: DataFrame, buckets: int = 10_000, longest: int = 2, text: str = "text") -> np.ndarray:
    """Features of all texts in each bucket. A task sends one row for each bucket, so `buckets` bounds what moves."""
    bounded_batches(docs.sparkSession)
    counted = docs.select(text).mapInArrow(partial(_counted, buckets=buckets, longest=longest), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandths of the log ratio of each bucket's shares, with one added to every count."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratios = (float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Floored thousandths of Gumbel noise out of 32 bits of the digest of the seed and the id."""
    named = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int.from_bytes(hashlib.sha256(named).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scoring(gain: np.ndarray, longest: int, seed: int, least_words: int):
    def run(text: str | None, doc_id: int | None) -> tuple:
        n_words = n = total = 0
        for new, found in features(text, longest):
            n_words += new
            n += len(found)
            total += int(gain[found % len(gain)].sum())
        weight = total // n if n else 0
        return n, weight, weight + noise(seed, doc_id), n_words >= least_words

    return run


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 2, seed: int = 7, least_words: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, eligible: whether the document has enough words to be drawn."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    start = partial(_scoring, gain, longest, seed, least_words)
    return per_row(rows, ["doc_id"], ["text", "doc_id"], "n_features long, weight long, score long, eligible boolean", start)


class Tournament:
    """A tree of matches: every node holds the least key of its two sides, so the root holds the least of all. Its
    number of places doubles when a run is opened and none is free."""

    END = (math.inf,)

    def __init__(self) -> None:
        self.places = 1
        self.keys: list[tuple] = [self.END, self.END]
        self.free = [0]

    def put(self, place: int, key: tuple) -> None:
        at = self.places + place
        self.keys[at] = key
        while at := at >> 1:
            left, right = self.keys[2 * at], self.keys[2 * at + 1]
            self.keys[at] = left if left <= right else right

    def opened(self) -> int:
        """A free place."""
        if not self.free:
            last, n = self.keys[self.places :], self.places
            self.places, self.free = 2 * n, list(range(2 * n - 1, n - 1, -1))
            self.keys = [self.END] * (4 * n)
            self.keys[2 * n : 3 * n] = last
            for at in range(2 * n - 1, 0, -1):
                self.keys[at] = min(self.keys[2 * at], self.keys[2 * at + 1])
        return self.free.pop()

    def least(self) -> tuple:
        return self.keys[1]


def _keys(docs: list[dict]) -> list[tuple]:
    """What orders rows: higher scores first, then smaller ids, null ones last."""
    return [(-d["score"], d["doc_id"] is None, d["doc_id"] or 0, d["n_features"]) for d in docs]


def merged(pieces: Iterable[list[dict]], wanted: int) -> Iterator[tuple[dict, int | None]]:
    """The rows of sorted pieces that come in the order of their heads: the first `wanted` of all in order, each with
    its place from 0, then the others without a place and in no order."""
    coming = iter(pieces)
    tree, open_runs = Tournament(), {}
    piece = next(coming, None)
    place = 0
    while place < wanted:
        while piece and _keys(piece[:1])[0] <= tree.least():
            at = tree.opened()
            open_runs[at] = (piece, keys := _keys(piece), 0)
            tree.put(at, (*keys[0], at))
            piece = next(coming, None)
        if tree.least() == tree.END:
            break
        at = tree.least()[-1]
        rows, keys, i = open_runs[at]
        yield rows[i], place
        place += 1
        if i + 1 < len(rows):
            open_runs[at] = (rows, keys, i + 1)
            tree.put(at, (*keys[i + 1], at))
        else:
            del open_runs[at]
            tree.put(at, tree.END)
            tree.free.append(at)
    for rows, _, i in open_runs.values():
        yield from ((row, None) for row in rows[i:])
    while piece:
        yield from ((row, None) for row in piece)
        piece = next(coming, None)


def _runs(batches: Iterator[pa.RecordBatch], bounds: list[tuple], most: int, block: int, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted runs of up to `most` eligible rows, cut at the bounds and into blocks. Rows that can't be drawn go on as
    pieces of the part behind all others."""

    def cut(rows: list[dict]) -> pa.RecordBatch:
        order = sorted(range(len(rows)), key=_keys(rows).__getitem__)
        rows = [rows[i] for i in order]
        keys = _keys(rows)
        edges = [0, *(bisect.bisect_right(keys, b) for b in bounds), len(rows)]
        found = [(part, rows[a : min(a + block, high)]) for part, (low, high) in enumerate(zip(edges, edges[1:], strict=False)) for a in range(low, high, block)]
        return piece_batch(found)

    def piece_batch(found: list[tuple[int, list[dict]]]) -> pa.RecordBatch:
        heads = [docs[0] for _, docs in found]
        columns = [[p for p, _ in found], [len(docs) for _, docs in found], [-h["score"] for h in heads], [int(h["doc_id"] is None) for h in heads], [h["doc_id"] or 0 for h in heads], [docs for _, docs in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    waiting: list[dict] = []
    for batch in batches:
        rows = batch.select([n for n, _ in ROW]).to_pylist()
        can = batch.column("eligible").to_pylist()
        rest = [r for r, ok in zip(rows, can, strict=True) if not ok]
        if rest:
            yield piece_batch([(len(bounds) + 1, rest[a : a + block]) for a in range(0, len(rest), block)])
        waiting += [r for r, ok in zip(rows, can, strict=True) if ok]
        if len(waiting) >= most:
            yield cut(waiting)
            waiting = []
    if waiting:
        yield cut(waiting)


def _ranked(batches: Iterator[pa.RecordBatch], begins: dict[int, tuple[int, int]], size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Ranks of the pieces of each part, which come sorted. begins: of each part, the rows before it and the rows to draw."""
    kinds = pa.schema([*ROW, ("rank", pa.int64())])

    def pieces() -> Iterator[tuple[int, list[dict]]]:
        for batch in batches:
            parts = batch.column("part").to_pylist()
            for i, part in enumerate(parts):
                yield part, batch.column("docs")[i].as_py()

    def made(rows: list[tuple[dict, int | None]]) -> pa.RecordBatch:
        columns = [[r[n] for r, _ in rows] for n, _ in ROW] + [[rank for _, rank in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    coming = pieces()
    ahead = next(coming, None)
    out: list[tuple[dict, int | None]] = []
    while ahead:
        part = ahead[0]
        before, wanted = begins[part]

        def own() -> Iterator[list[dict]]:
            nonlocal ahead
            while ahead and ahead[0] == part:  # noqa: B023  used up before the next part begins
                docs = ahead[1]
                ahead = next(coming, None)
                yield docs

        for row, place in merged(own(), wanted):
            out.append((row, None if place is None else before + place + 1))
            if len(out) == size:
                yield made(out)
                out = []
    if out:
        yield made(out)


def drawn(rows: DataFrame, percent: int, range_rows: int = 2_000_000, least_range: int = 2000, block: int = 4096, run_rows: int = 200_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank: all rows of scored(), ranked where they are among the floor of `percent`
    percent of the eligible ones that have the highest scores (smaller ids first among equals), null elsewhere.

    Ranges have about `range_rows` rows, or fewer, down to `least_range`, while there are fewer ranges than shuffle
    partitions. Their bounds come from a sample of 64 rows a range; they decide how even the tasks are, not the result."""
    spark = rows.sparkSession
    rows, scored_path = written(rows)
    eligible = rows.filter("eligible")
    n = eligible.count()
    wanted = n * percent // 100
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-n // range_rows), min(partitions, n // least_range))
    one_in = max(1, n // (64 * ranges))
    picked = eligible.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(one_in)) == 0)
    sample = sorted(_keys([r.asDict() for r in picked.select("doc_id", "n_features", "score").collect()]))
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    kinds = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("head_score", pa.int64()), ("head_null", pa.int32()), ("head_id", pa.int64()), ("docs", pa.list_(pa.struct(ROW)))])
    bounded_batches(spark)
    pieces, _ = written(rows.mapInArrow(partial(_runs, bounds=bounds, most=run_rows, block=block, kinds=kinds), PIECE))
    removed(spark, scored_path)
    sizes = dict(pieces.filter(F.col("part") <= len(bounds)).groupBy("part").agg(F.sum("n")).collect())
    begins, before = {}, 0
    for part in range(len(bounds) + 1):
        begins[part] = (before, min(max(0, wanted - before), sizes.get(part, 0)))
        before += sizes.get(part, 0)
    last = max((part for part, (_, take) in begins.items() if take), default=-1)
    order = ["part", "head_score", "head_null", "head_id"]
    taken = pieces.filter(F.col("part") <= last).repartitionById(last + 1, "part").sortWithinPartitions(*order) if last >= 0 else pieces.limit(0)
    ranked = taken.select("part", "docs").mapInArrow(partial(_ranked, begins=begins), f"{SCORED}, rank long")
    rest = pieces.filter(F.col("part") > last).select(F.inline("docs")).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, buckets: int = 10_000, longest: int = 2, seed: int = 7, least_words: int = 20) -> DataFrame:
    """All of docs (doc_id, text), ranked where they are drawn to look like target (text)."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    return drawn(scored(docs, gain, longest, seed, least_words), percent)
