"""MinHash near-duplicates with DartMinHash signatures.

A text is a weighted set: its runs of `width` words, each with the times it occurs; a text of fewer words is one run.
An element's weight is cut into dyadic levels, [0, 1), [1, 3), [3, 7) and so on. Hashed darts fall on each level as a
Poisson process in rank, as dense as the level is wide, each at a hashed weight within it; they are the same in every
text, and a text is hit by those below its weight. It keeps, for each coordinate of its signature, the dart of lowest
rank; two texts agree in a coordinate with the probability of their weighted Jaccard similarity. Darts are thrown by
growing rank and only up to the rank below which all coordinates are expected to be hit, so a signature costs about
its elements, their levels and its coordinates, not their products and not its total weight.

Two texts are linked if they share a band of coordinates and their exact similarity reaches the threshold; classes are
the connected components of the links. This rule is the same for groups of all sizes; only the way to it differs:

Copies (equal word sequences) are one node; what follows sees each distinct text once. In each band every text is tied
to the least node of its bucket, so a bucket of n texts gives n pairs, and the connected components of these ties hold
every pair that shares a band. A component that fits one block is compared in one group, by products of sparse
incidence matrices; a group gives at most one link for each of its texts, so near copies are not expanded into pairs
and no class is lost. In larger components each text is first compared with a few hubs, texts that meet most others in
their bands. Then each bucket is cut into blocks of bounded size, and the blocks that the links to hubs do not already
put into one class meet pair by pair. A bucket whose texts the hubs do not link needs all its block pairs.

Null and empty texts have no words; they are copies of each other. Repeated rows are copies. Ids may be null or repeat:
a class without any id has a null class_id, and class_key tells such classes apart. An empty table gives an empty one.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.tasks import bounded_batches, boxed, join_uneven, per_likely_row, stored, unboxed

MASK = (1 << 64) - 1
#: A text counts once in a block, and once more for so many words, which bounds the bytes of a block.
LOAD_WORDS = 8192
_ODD, _STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of words, ascending, and how often each occurs."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        runs = runs * _ODD + each[k : k + n]
    return np.unique(_mix(runs), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two results of shingles()."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 1.0


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """The DartMinHash signature (size values) of each nonempty weighted set (element hashes, weights > 0). Weights
    far below 1 are slow; scaled alike in all sets they give the same similarities."""
    out = np.zeros((len(texts), size), np.uint64)
    lengths = np.array([len(e) for e, _ in texts])
    doc = np.repeat(np.arange(len(texts)), lengths)
    element = np.concatenate([e for e, _ in texts])
    weight = np.concatenate([w for _, w in texts]).astype(float)
    total = np.bincount(doc, weight, len(texts))
    levels = np.ceil(np.log2(weight + 1)).clip(1).astype(np.int64)  # level v is [2^v - 1, 2^(v+1) - 1)
    first = np.repeat(np.cumsum(levels) - levels, levels)
    level = np.arange(len(first)) - first
    width = np.ldexp(1.0, level)
    inside = np.repeat(weight, levels) - (width - 1)  # how much of the level lies below the weight
    key = _mix(np.repeat(element, levels) + level.astype(np.uint64) * _OTHER)
    doc = np.repeat(doc, levels)
    darts, open_docs = size * (np.log(size) + 2), np.ones(len(texts), bool)
    while open_docs.any():
        reach = np.where(open_docs, darts / total, 0.0)
        alive = np.flatnonzero(open_docs[doc])
        rank = np.zeros(len(alive))
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = 1
        while len(alive):
            throw = _mix(key[alive] + np.uint64(number * int(_STEP) & MASK))
            rank = rank - np.log((throw >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / width[alive]
            near = rank < reach[doc[alive]]
            alive, rank, throw = alive[near], rank[near], _mix(throw[near] ^ _OTHER)
            below = inside[alive] >= width[alive]
            if not below.all():
                below |= (_mix(throw) >> np.uint64(11)).astype(float) * 2.0**-53 * width[alive] < inside[alive]
            coordinate = (throw >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
            hits.append((rank[below], (doc[alive] * size + coordinate.astype(np.int64))[below], throw[below]))
            number += 1
        rank, cell, value = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(-rank)  # the last value put in a cell stays: that of lowest rank
        fresh, hit = np.zeros(len(texts) * size, np.uint64), np.zeros(len(texts) * size, bool)
        fresh[cell[order]] = value[order]
        hit[cell] = True
        full = hit.reshape(len(texts), size).all(axis=1) & open_docs
        out[full] = fresh.reshape(len(texts), size)[full]
        open_docs &= ~full
        darts *= 2
    return out


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of equally many coordinates; bands hash apart."""
    rows = signature.reshape(len(signature), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        h = _mix(h * _ODD + rows[:, :, k])
    return h.view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # at ASCII white space


def _signed(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int, work: int = 200_000) -> Iterator[pa.RecordBatch]:
    """doc_id, node (digest of the word sequence), load (of a group that holds it), bands (empty where there are no words)."""
    import xxhash

    def flush(ids, nodes, sets):
        some = [i for i, s in enumerate(sets) if len(s[0])]
        found: list = [[]] * len(sets)
        if some:
            for i, h in zip(some, band_hashes(signatures([sets[i] for i in some], bands * rows), bands), strict=True):
                found[i] = h
        load = pa.array([1 + int(c.sum()) // LOAD_WORDS for _, c in sets], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.binary()), load, pa.array(found, pa.list_(pa.int64()))], ["doc_id", "node", "load", "bands"])

    for batch in batches:
        nodes, sets, start, load = [], [], 0, 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = _words(text)
            nodes.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sets.append(shingles(words, width))
            load += len(words) + 8 * bands * rows
            if load >= work:
                yield flush(batch.column(0)[start : i + 1], nodes, sets)
                nodes, sets, start, load = [], [], i + 1, 0
        if nodes:
            yield flush(batch.column(0)[start:], nodes, sets)


def _together(column: np.ndarray, owner: np.ndarray, n: int, columns: int = 4096) -> np.ndarray:
    """How many values of `column` each two of n owners share; an owner has a value once."""
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    number = np.cumsum(np.r_[False, column[1:] != column[:-1]])
    shared = np.bincount(number)[number] > 1  # a value of one owner adds nothing
    owner, number = owner[shared], number[shared]
    number = np.cumsum(np.r_[False, number[1:] != number[:-1]]) if len(number) else number
    both = np.zeros((n, n), np.float32)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        here = slice(*np.searchsorted(number, [start, start + columns]))
        matrix = np.zeros((n, min(columns, int(number[-1]) + 1 - start)), np.float32)
        matrix[owner[here], number[here] - start] = 1
        both += matrix @ matrix.T
    return both


def linked(sets: list[tuple[np.ndarray, np.ndarray]], bands: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each weighted set the first one it is connected to by links: a common band and a similarity of at least the
    threshold."""
    n = len(sets)
    # the k-th occurrence of a shingle is an element of its own: then the weighted similarity is that of plain sets
    elements = np.concatenate([_mix(np.repeat(e, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64) * _STEP) for e, c in sets])
    size = np.array([c.sum() for _, c in sets], float)
    both = _together(elements, np.repeat(np.arange(n), size.astype(np.int64)), n)
    near = (both >= threshold * (size[:, None] + size[None, :] - both)) & (_together(np.concatenate(bands), np.repeat(np.arange(n), [len(b) for b in bands]), n) > 0)
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _stars(members: DataFrame, n_members: int, block: int, hubs: int) -> DataFrame:
    """node, hub, part: each text beside the `hubs` hubs it shares most bands with, in parts of about a block; the hub is
    in each of its parts. members: node, load, band, n; a band's hub is the text with most others in its bands."""
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    of_band = members.join(weight, "node").groupBy("band").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"), F.count(F.lit(1)).alias("n"))
    near = join_uneven(members.select("node", "load", "band"), stored(of_band), ["band"], n_members)
    near = near.filter("node != hub").groupBy("node", "load", "hub").agg(F.count(F.lit(1)).alias("bands"))
    order = Window.partitionBy("node").orderBy(F.col("bands").desc(), "hub")
    near = stored(near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= hubs).select("node", "load", "hub"))
    parts = stored(near.groupBy("hub").agg(F.ceil(F.sum("load") / F.lit(block)).alias("parts"), F.count(F.lit(1)).alias("n")))
    dealt = join_uneven(near, parts, ["hub"], n_members).select("node", "hub", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    own = parts.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return dealt.unionAll(own)


def _met(sets: DataFrame, known: DataFrame, n_sets: int, block: int) -> DataFrame:
    """node, set, mine (its block in the set), others (the blocks it has to meet). sets: node, load, set; known: node,
    label.

    A class that fills a block or more has blocks of its own, which do not meet each other, as it is linked already; the
    other texts share blocks that meet all. A set of one class has no blocks."""
    placed = sets.join(known, "node", "left").select("node", "load", "set", F.coalesce("label", "node").alias("class"))
    placed = stored(placed)
    classes = placed.groupBy("set", "class").agg(F.sum("load").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("unit", F.when(F.col("m") >= block, F.col("class")))
    units = classes.groupBy("set", "unit").agg(F.ceil(F.sum("m") / F.lit(block)).alias("blocks"), F.count(F.lit(1)).alias("n_classes"))
    whole = Window.partitionBy("set")
    before = F.sum("blocks").over(whole.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1))
    units = units.withColumns({"first": F.coalesce(before, F.lit(0)), "total": F.sum("blocks").over(whole), "n_classes": F.sum("n_classes").over(whole)}).filter("n_classes > 1")
    of_class = classes.select("set", "class", "unit", "n").join(units.withColumnsRenamed({"set": "of_set", "unit": "of_unit"}), (F.col("set") == F.col("of_set")) & F.col("unit").eqNullSafe(F.col("of_unit")))
    of_class = stored(of_class.select("set", "class", "n", F.col("unit").isNotNull().alias("own"), "first", "blocks", "total"))
    rows = join_uneven(placed, of_class, ["set", "class"], n_sets).withColumn("mine", F.col("first") + F.pmod(F.xxhash64("node"), "blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)
    others = F.filter(every, lambda x: ~F.col("own") | (x < F.col("first")) | (x >= F.col("first") + F.col("blocks")))
    return rows.select("node", "set", "mine", others.alias("others")).filter(F.size("others") > 0)


def _classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5, block: int = 128, hubs: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Each row of docs (doc_id, node), and each distinct text: node, first (its least id), copies, label (the least node
    of its class), n (rows that have the node)."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    signed = stored(given.mapInArrow(partial(_signed, width=width, bands=bands, rows=rows), f"doc_id {kind}, node binary, load bigint, bands array<bigint>"))
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("load").alias("load"), F.any_value("bands").alias("bands"))
    nodes = stored(nodes)

    in_bands = nodes.select("node", "load", F.explode("bands").alias("band"))
    shared = stored(in_bands.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    n_members = shared.agg(F.sum("n")).first()[0] or 0
    members = stored(join_uneven(in_bands, shared, ["band"], n_members))
    ties = components(members.filter("node > least").select("least", "node"), "least", "node")
    tied = stored(ties.join(nodes.select("node", F.col("first").alias("doc_id"), "load", "bands"), "node"))
    sizes = stored(tied.groupBy("label").agg(F.sum("load").alias("loads"), F.count(F.lit(1)).alias("n")))

    keyed = per_likely_row(given, "doc_id", tied, ["doc_id", "text"], ["text"], "node binary", _node_of)
    keyed = keyed.groupBy("node", _never_null("doc_id").alias("key")).agg(F.min("text").alias("text"))  # of repeated rows one
    texts = stored(keyed.join(tied.select("node", _never_null("doc_id").alias("key"), "bands"), ["node", "key"]).select("node", "text", "bands"))

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        label = linked([shingles(_words(t), width) for t in table.column("text").to_pylist()], [np.array(b, np.int64) for b in table.column("bands").to_pylist()], threshold)
        far = np.flatnonzero(label != np.arange(len(label)))
        found = table.column("node").combine_chunks()
        return pa.table({"a": found.take(pa.array(label[far])), "b": found.take(pa.array(far))})

    n_tied = sizes.agg(F.sum("n")).first()[0] or 0
    in_sets = join_uneven(tied.select("node", "load", "label"), sizes, ["label"], n_tied)
    one_block = in_sets.filter(F.col("loads") <= block).select("node", "label")
    found = one_block.join(texts, "node").groupBy("label").applyInArrow(links, "a binary, b binary")
    if not sizes.filter(F.col("loads") > block).isEmpty():
        wide = stored(members.join(in_sets.filter(F.col("loads") > block).select("node", "label"), "node").select("node", "load", "label", "band", "n"))
        n_wide = wide.count()
        stars = _stars(wide, n_wide, block, hubs)
        to_hubs = stored(stars.join(texts, "node").groupBy("hub", "part").applyInArrow(links, "a binary, b binary"))
        sets = wide.select("node", "load", F.col("band").alias("set"))
        met = _met(sets, components(to_hubs), n_wide, block).join(texts, "node").withColumn("other", F.explode("others"))
        met = met.select("node", "text", "bands", "set", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        found = found.unionAll(to_hubs).unionAll(met.groupBy("set", "i", "j").applyInArrow(links, "a binary, b binary"))
    label = components(found)
    labelled = nodes.select("node", "first", "copies").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return signed.select("doc_id", "node"), stored(labelled)


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id (the least id of the class), class_key, class_size, copies (rows of the same word sequence) for
    each row.

    Options: width (5 words), threshold (0.8), bands (32) of `rows` (5) coordinates, with which a pair at 0.8 shares no
    band once in 300,000 times, one at 0.85 once in 50 million; block (128 texts) and hubs (3) set the work of a task
    and don't change the result."""
    rows, nodes = _classes(docs, doc_id, text, **options)
    ids = nodes.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n"))
    n_nodes = nodes.count()
    of_node = join_uneven(nodes.select("node", "label", "copies"), stored(ids), ["label"], n_nodes)
    of_node = stored(of_node.select("node", "class_id", F.lower(F.hex("label")).alias("class_key"), "class_size", "copies", F.col("copies").alias("n")))
    n_rows = of_node.agg(F.sum("n")).first()[0] or 0
    return join_uneven(rows, of_node, ["node"], n_rows).select("doc_id", "class_id", "class_key", "class_size", "copies")


def _never_null(column: str) -> Column:
    """A string that is equal where the column is, and also for nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


def _node_of():
    import xxhash

    return lambda text: (xxhash.xxh3_128_digest(b" ".join(_words(text))),)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, with all columns: that of the least id, a null id last; of rows of equal id the least
    text digest decides, and of rows of equal words the least hash of the row."""
    _, nodes = _classes(docs, doc_id, text, **options)
    kept = nodes.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("one"))
    kept = stored(kept.select(F.col("one.first").alias("doc_id"), "one.node"))
    rows = boxed(docs, (doc_id, text), doc_id=doc_id, text=text)
    keyed = per_likely_row(rows, "doc_id", kept, rows.columns, ["text"], "node binary", _node_of)
    plain = [F.col(f"given.`{f.name}`") for f in rows.schema["given"].dataType if "map<" not in f.dataType.simpleString()]
    whole = F.struct("given", "doc_id", "text")
    keyed = keyed.groupBy("node", _never_null("doc_id").alias("key")).agg(F.min_by(whole, F.xxhash64("doc_id", "text", *plain)).alias("row"))
    return keyed.join(kept.select("node", _never_null("doc_id").alias("key")), ["node", "key"]).select("row.*").select(*unboxed(docs.columns, **{doc_id: F.col("doc_id"), text: F.col("text")}))
