"""Connected components of a graph whose edges and labels stay distributed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tasks import join_uneven, removed, written


def _forest(edges: pa.Table) -> pa.Table:
    """For each node of the edges but the least of its component an edge (hi, lo) to that one."""
    hi, lo = edges.column("hi").combine_chunks(), edges.column("lo").combine_chunks()
    nodes = pa.concat_arrays([hi, lo]).unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    hi, lo = (pc.index_in(x, nodes).to_numpy() for x in (hi, lo))
    label = np.arange(len(nodes))
    while True:
        a, b = label[hi], label[lo]
        apart = a != b
        if not apart.any():
            break
        hi, lo, a, b = hi[apart], lo[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    far = np.flatnonzero(label != np.arange(len(label)))
    return pa.table([nodes.take(pa.array(far)), nodes.take(pa.array(label[far]))], schema=edges.schema)


def _contract(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    waiting, n = [], 0
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        n += len(batch)
        if n >= most:
            forest = _forest(pa.concat_tables(waiting))
            if 2 * len(forest) > most:  # more nodes than a task should hold: these edges go on as they are
                yield from forest.to_batches()
                forest = forest.slice(0, 0)
            waiting, n = [forest], len(forest)
    if n:
        yield from _forest(pa.concat_tables(waiting)).to_batches()


def _contracted(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Edges with the same components, those of each partition replaced by a star for each of their components. A task
    holds about `most` edges at a time; with more nodes than that it makes several sets of stars."""
    return edges.mapInArrow(partial(_contract, most=most), edges.schema)


def _star(edges: DataFrame, large: bool, n_edges: int) -> tuple[DataFrame, str]:
    """One step of the alternating star algorithm on edges (hi, lo) with hi > lo, and the path of a table it needs:
    each node links its larger (or smaller) neighbours, and itself, to the least node among its neighbours and itself.
    The edges of a node with very many of them stay where they are. Large stars may give an edge more than once."""
    if large:
        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near"), F.lit(0).alias("own")).unionAll(edges.select(F.col("lo").alias("node"), F.col("hi").alias("near"), F.lit(1).alias("own")))
        least = both.groupBy("node").agg(F.min("near").alias("least"), F.sum("own").alias("n")).filter("n > 0").select("node", F.least("node", "least").alias("least"), "n")
        least, path = written(least)
        linked = join_uneven(edges.select(F.col("lo").alias("node"), F.col("hi").alias("far")), least, ["node"], n_edges)
        pairs = linked.select(F.col("far").alias("hi"), F.col("least").alias("lo"))
    else:
        least, path = written(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("n")))
        linked = join_uneven(edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")), least, ["node"], n_edges)
        pairs = linked.select(F.col("near").alias("hi"), F.col("least").alias("lo")).unionAll(least.select(F.col("node").alias("hi"), F.col("least").alias("lo")))
        pairs = pairs.distinct()
    return pairs.filter("hi > lo"), path


def _finished(edges: DataFrame) -> bool:
    """Whether each node has edges to one smaller node, or only to larger ones."""
    ends = edges.select(F.col("hi").alias("node"), "lo", F.lit(False).alias("down")).unionAll(edges.select(F.col("lo").alias("node"), F.lit(None).alias("lo"), F.lit(True).alias("down")))
    seen = ends.groupBy("node").agg(F.min("lo").alias("least"), F.max("lo").alias("most"), F.max("down").alias("down"))
    return seen.filter("least is not null and (down or least != most)").count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for each node that has an edge: the label is the least node of its component.

    Edges are first contracted within each partition, which takes no shuffle and leaves less than one edge for each node
    of the partition. Large and small stars, each contracted the same way, then alternate until every edge leads to the
    least node of its component. Each step's edges are written to the shared folder in place of the last; only counts
    come to the driver."""
    spark = edges.sparkSession
    now, path = written(_contracted(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo")))
    while not _finished(now):
        for large in (True, False):
            star, needed = _star(now, large, now.count())
            linked, linked_path = written(star)
            removed(spark, needed)
            removed(spark, path)
            now, path = written(_contracted(linked))
            removed(spark, linked_path)
    both = now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("label")))
    return both.distinct()
