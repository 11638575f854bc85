"""Rules of several terms: level-wise mining over bitmaps, closed sets, weights reinforced by outcomes.

Documents are dealt into blocks of up to 32,768 by the hash of their id and numbered within them, so a set of terms is,
in each block, a bitmap of the documents that hold all of them. Sets of one more term come from two sets that differ in
their last term and have no rare subset; their bitmaps are the conjunction of those two, block by block, and are never
larger than the documents, however many occurrences a term has. A set is closed if no larger set has all its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import listed, terms
from lodestone.session import stored

BITS = 32_768  # of a bitmap that bitmap_construct_agg makes
COUNTS = np.array([i.bit_count() for i in range(256)], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conjunctions: items, block, bits of rows (items, block, one, other), without the empty ones."""
    for batch in batches:
        if batch.num_rows:
            both = _matrix(batch.column("one")) & _matrix(batch.column("other"))
            some = np.flatnonzero(both.any(axis=1))
            rows = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch.column("items").take(rows), batch.column("block").take(rows), pa.array([both[i].tobytes() for i in some], pa.binary())], ["items", "block", "bits"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """items, n, n_good of rows (items, bits, good)."""
    for batch in batches:
        if batch.num_rows:
            bits, good = _matrix(batch.column("bits")), _matrix(batch.column("good"))
            yield pa.RecordBatch.from_arrays([batch.column("items"), pa.array(COUNTS[bits].sum(axis=1)), pa.array(COUNTS[bits & good].sum(axis=1))], ["items", "n", "n_good"])


def numbered(docs: DataFrame, labels: DataFrame, block_docs: int = BITS // 2) -> DataFrame:
    """block, at, good, terms of each labelled document: docs (doc_id, text), labels (doc_id, quality). Blocks have about
    `block_docs` documents; a block can't have more than a bitmap has bits, or numbering raises."""
    rows = docs.select("doc_id", F.array_distinct(terms(F.col("text"))).alias("terms")).join(labels.select("doc_id", "quality"), "doc_id")
    n_blocks = max(1, -(-labels.count() // block_docs))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("doc_id")) - 1)
    fits = F.when(F.col("at") < BITS, F.col("at")).otherwise(F.raise_error(F.lit("a block has more documents than its bitmap has bits: repeated ids, or block_docs too high")).cast("int"))
    return rows.select("block", fits.alias("at"), (F.col("quality") == 1).alias("good"), "terms")


def _frequent(bits: DataFrame, good: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Of bitmaps (items, block, bits) those of sets with `least` documents, and these sets (items, n, n_good)."""
    counted = bits.join(good, "block").select("items", "bits", "good").mapInArrow(_counted, "items array<string>, n long, n_good long")
    sets = stored(counted.groupBy("items").agg(F.sum("n").alias("n"), F.sum("n_good").alias("n_good")).filter(F.col("n") >= least))
    return stored(bits.join(sets.select("items"), "items", "left_semi")), sets


def mine(docs: DataFrame, labels: DataFrame, least: int, most: int = 3, **settings) -> DataFrame:
    """items (sorted terms), support, success, weight, closed: every set of up to `most` terms that `least` labelled
    documents hold; success is the share of these that are good, weight the log odds with one added to each side. Of the
    longest sets, closed says that no set found is larger with the same support."""
    rows = stored(numbered(docs, labels, **settings))
    at = F.bitmap_construct_agg(F.col("at").cast("long"))
    good = rows.groupBy("block").agg(F.coalesce(F.bitmap_construct_agg(F.when(F.col("good"), F.col("at").cast("long"))), F.unhex(F.lit("00" * (BITS // 8)))).alias("good"))
    good = stored(good)
    single = listed(rows, F.col("terms"), "term", "block", "at").groupBy(F.array("term").alias("items"), "block").agg(at.alias("bits"))
    bits, sets = _frequent(single, good, least)
    levels = [sets]
    for size in range(2, most + 1):
        head = lambda c: F.slice(c, 1, size - 2)  # noqa: E731, B023
        one = sets.select(head("items").alias("head"), F.col("items").alias("a"))
        other = sets.select(head("items").alias("head"), F.col("items").alias("b"))
        grown = one.join(other, "head").filter(F.element_at("a", -1) < F.element_at("b", -1))
        grown = grown.select("a", "b", F.concat("a", F.slice("b", size - 1, 1)).alias("items"))
        if size > 2:  # all subsets of one term less have to be frequent
            subsets = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.filter("items", lambda _, j: j != i))
            parts = grown.select("a", "b", "items", F.explode(subsets).alias("part"))
            known = parts.join(sets.select(F.col("items").alias("part")), "part", "left_semi")
            grown = known.groupBy("a", "b", "items").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == size).drop("n")
        grown = stored(grown)
        if grown.isEmpty():
            break
        side = lambda name, to: bits.select(F.col("items").alias(name), "block", F.col("bits").alias(to))  # noqa: E731, B023
        pairs = grown.join(side("a", "one"), "a").join(side("b", "other"), ["b", "block"]).select("items", "block", "one", "other")
        met = stored(pairs.mapInArrow(_met, "items array<string>, block int, bits binary"))
        bits, sets = _frequent(met, good, least)
        levels.append(sets)
    out = None
    for size, sets in enumerate(levels, 1):
        larger = levels[size] if size < len(levels) else sets.limit(0)
        inner = F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.filter("items", lambda _, j: j != i))
        same = larger.select(F.explode(inner).alias("items"), "n").distinct().withColumn("open", F.lit(True))
        found = sets.join(same, ["items", "n"], "left").withColumn("closed", F.col("open").isNull()).drop("open")
        out = found if out is None else out.unionByName(found)
    bad = F.col("n") - F.col("n_good")
    return out.select("items", F.col("n").alias("support"), F.round(F.col("n_good") / F.col("n"), 6).alias("success"), F.round(F.log((F.col("n_good") + 1.0) / (bad + 1.0)), 6).alias("weight"), "closed")


def reinforced(rules: DataFrame, docs: DataFrame, outcomes: DataFrame, rate: float = 0.1) -> DataFrame:
    """rules with `weight` moved by how they did: for each rule (items, weight) the documents that hold it say by how
    much their outcome (0 or 1) was above what the weight had foretold, and the weight moves by `rate` times the mean.
    docs: doc_id, text; outcomes: doc_id, outcome. Rules that no document with an outcome holds stay."""
    held = docs.select("doc_id", F.array_distinct(terms(F.col("text"))).alias("terms")).join(outcomes.select("doc_id", "outcome"), "doc_id")
    first = listed(held, F.col("terms"), "first", "doc_id", "outcome", "terms")
    keyed = rules.withColumn("first", F.col("items")[0])
    met = first.join(keyed.select("first", "items", F.col("weight").alias("old")), "first").filter(F.size(F.array_except("items", "terms")) == 0)
    surprise = F.col("outcome") - 1 / (1 + F.exp(-F.col("old")))
    moved = met.groupBy("items").agg(F.avg(surprise).alias("surprise"))
    rows = rules.join(moved, "items", "left")
    return rows.withColumn("weight", F.round(F.col("weight") + rate * F.coalesce("surprise", F.lit(0.0)), 6)).select(*rules.columns)
