"""Mixing sources to target weights by entropy balancing.

Of all document rates within [0, cap] that give each source its target of tokens, entropy balancing takes those
closest to 1 in relative entropy. They are tilted exponentially, rate = min(cap, exp(tilt of the source * tokens of
the document / mean tokens of the source)), and the tilts minimise a convex dual, one dimension for each source, so
its Hessian is diagonal and one Newton step for all sources is a single aggregation over the documents. Documents of
equal source and size have equal rates; they are counted once, before the iterations.

Rates become whole copies by error diffusion within blocks of a source, from long documents to short: a document
gets its rate rounded down or up, whichever keeps the tokens taken so far nearer to their target, so a block ends
within a short document of it. A large source has many blocks; no task holds a whole source.

A null source is a source of its own; null texts and texts without words have size 0, rate 1 and take no tokens.
Repeated rows count as documents of their own. An empty table gives an empty result. The result depends on the rows
alone, not on their order or partitions: what the iterations add up are decimals, whose sums have no order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.llm.corpus_words import n_words
from lodestone.llm.tasks import boxed, checkpointed, join_uneven, unboxed


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size (words of the text), computed once: every later step reads these few bytes."""
    return checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")))


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """source, source_size, weight: sources by code point, null last, take the weights in turn. One row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))


def share_out(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds `target`: `share` of all tokens by weight, at most `cap` times the source's size; what is above goes to
    the others by weight until none is above. Only sums over the sources come to the driver."""
    sources = checkpointed(sources)
    most = F.col("source_size") * F.lit(float(cap))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:  # at least one more source is full in each round
        above = most <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.count_if(above).alias("full"),
            F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["open"] <= 0 or row["full"] == full:
            break
        full, level = row["full"], (total - row["taken"]) / row["open"]
    return sources.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def _rate(size: Column, tilt: Column, mean: Column, cap: float) -> Column:
    """exp(tilt * size / mean), at most cap; no overflow."""
    power = tilt * size / mean
    return F.when(power >= F.log(F.lit(cap)), F.lit(cap)).otherwise(F.exp(power))


def _exact(value: Column) -> Column:
    """The sum of a double, to six places; the same in every order."""
    return F.sum(value.cast("decimal(28,6)")).cast("double")


def tilts(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-7, rounds: int = 200) -> DataFrame:
    """source, source_size, target, n, mean, tilt: Newton iterations on the dual, all sources at once.

    An iteration joins the tilts to the counts by (source, size) and sums tokens and their derivative by source. The
    step is Newton's for the logarithm of the tokens; where it would leave the bracket known to hold the root, which
    the cap makes possible, the bracket is halved, so that a handful of rounds is the rule; sources that are still open
    after `rounds` are an error. A target of all `cap` copies, or of none, is met at its bound."""
    cells = checkpointed(sizes.filter(F.col("size") > 0).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    size, n = F.col("size"), F.col("n")
    start = cells.groupBy("source").agg(F.sum(n).alias("n"), F.min(size).alias("least"), (F.sum(size * n) / F.sum(n)).alias("mean"), F.sum(size * n).alias("tokens"))
    t = targets.select(F.col("source").alias("of"), "source_size", "target")
    ratio = F.col("target") / F.col("tokens")
    highest = F.log(F.lit(cap)) * F.col("mean") / F.col("least")
    lowest = F.when(ratio < 1, F.log(F.greatest(ratio, F.lit(1e-300))) * F.col("mean") / F.col("least")).otherwise(F.lit(0.0))
    state = (
        start.join(t, F.col("source").eqNullSafe(F.col("of")))
        .withColumns({"high": highest, "low": lowest, "tilt": F.when(ratio >= cap * (1 - 1e-12), highest).otherwise(F.lit(0.0))})
        .withColumn("done", (ratio >= cap * (1 - 1e-12)) | (ratio <= 0))
        .withColumn("tilt", F.when(ratio <= 0, F.col("low")).otherwise(F.col("tilt")))
        .drop("of", "least", "tokens")
    )
    state = checkpointed(state)
    for _ in range(rounds):
        if state.filter(~F.col("done")).isEmpty():
            break
        rate = _rate(size, F.col("tilt"), F.col("mean"), cap)
        here = cells.select(F.col("source").alias("of"), "size", F.col("n").alias("docs")).join(state.filter(~F.col("done")), F.col("source").eqNullSafe(F.col("of")))
        sums = here.groupBy("source").agg(
            _exact(F.col("docs") * size * rate).alias("got"),
            _exact(F.when(rate < cap, F.col("docs") * size * size / F.col("mean") * rate).otherwise(F.lit(0.0))).alias("slope"),
        )
        moved = state.join(sums.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        near = F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target")
        within = (F.col("slope") > 0) & (newton > low) & (newton < high)
        step = F.when(near, F.col("tilt")).when(within, newton).otherwise((low + high) / 2)
        state = checkpointed(
            moved.select(
                "source", "n", "mean", "source_size", "target",
                F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("done"), F.col("tilt")).otherwise(step).alias("tilt"),
                (F.col("done") | near | (high - low <= 1e-13 * F.abs(high))).alias("done"),
            )
        )
    else:
        if not state.filter(~F.col("done")).isEmpty():
            raise ValueError(f"sources without a tilt after {rounds} rounds")
    return state.select("source", "source_size", "target", "n", "mean", "tilt")


def _diffuse(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Copies of one block's documents, from long to short."""
    table = table.sort_by([("size", "descending"), ("doc_id", "ascending")])
    size, rate = table.column("size").to_numpy().astype(float), table.column("rate").to_numpy()
    copies, owed = np.floor(rate).astype("int64"), 0.0
    part = rate - copies
    for i in np.flatnonzero(part > 0):
        owed += part[i] * size[i]
        if 2 * owed >= size[i]:
            copies[i] += 1
            owed -= size[i]
    return table.append_column("copies", pa.array(copies)).select(schema.names).cast(schema)


def mix(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, block_docs: int = 256) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies for each row of sized(); `targets` has source,
    source_size and target. A source has a block for each `block_docs` documents with words, however many they are; the
    documents of a large source meet its figures where they are."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias("key")  # noqa: E731  never null
    tilted = tilts(sizes, targets, cap).select(key("source"), F.col("n").alias("docs"), "mean", "tilt")
    rows_of = sizes.groupBy(key("source")).agg(F.count(F.lit(1)).alias("n"))
    known = targets.select(key("source"), "source_size", "target").join(tilted, "key", "left").join(rows_of, "key")
    known = checkpointed(known)
    n_rows = known.agg(F.sum("n")).first()[0] or 0
    rate = F.when((F.col("size") > 0) & F.col("tilt").isNotNull(), _rate(F.col("size"), F.col("tilt"), F.col("mean"), cap)).otherwise(F.lit(1.0))
    blocks = F.ceil(F.coalesce(F.col("docs"), F.lit(1)) / F.lit(block_docs))
    equal = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_equal"))
    each = equal.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n_equal"))).drop("n_equal")  # equal rows spread over the blocks
    rows = (
        join_uneven(each.select("*", key("source")), known, ["key"], n_rows)
        .withColumn("rate", rate)
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "nth"), blocks))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "block")
    )
    schema = T.StructType([rows.schema[c] for c in ("doc_id", "source", "size", "source_size", "target", "rate")] + [T.StructField("copies", T.LongType())])
    arrow = to_arrow_schema(schema)

    def diffused(table: pa.Table) -> pa.Table:
        return _diffuse(table, arrow)

    return rows.groupBy("source", "block").applyInArrow(diffused, schema)


def repeated(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, each as often as `mixed`, the result of mix() over them, says. Rows of equal id and size share
    the copies of all of them, so repeated rows don't multiply."""
    id_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")
    counts = mixed.groupBy(id_or("doc_id"), "size").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"))
    rows = boxed(docs, (text,), doc_id=doc_id, text=text).select("given", "text", id_or("doc_id"), n_words(F.col("text")).alias("size"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "size").orderBy(F.xxhash64("text"))))
    times = F.expr("cast(floor(all / rows) + if(nth <= all % rows, 1, 0) as int)")
    made = rows.join(counts, ["key", "size"]).withColumn("copy", F.explode(F.array_repeat(F.lit(0), times)))
    return made.select(*unboxed(docs.columns, **{text: F.col("text")}))
