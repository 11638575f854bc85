"""Whether runs differ: Poisson bootstrap and paired randomisation with hashed draws, and Holm's correction.

The draw of an item in a replicate is read off the md5 of the seed, the replicate and the item: a Poisson weight for the
interval and a sign for the test. So one pass over the items makes all replicates, each task sums its items before
anything moves, and reruns over any partitions draw the same. Values count in whole millionths, so sums are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _digest(replicate: str, item: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(replicate).cast("string"), F.col(item).cast("string")))


def poisson_limits(most: int = 12) -> list[int]:
    """Of a number below 2**32, how many of these it reaches is a draw from the Poisson distribution of mean 1."""
    total, limits = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        limits.append(min(2**32, math.floor(total * 2**32)))
    return limits


def differences(records: DataFrame) -> DataFrame:
    """item_id, metric, run_a, run_b, difference (of b to a, in millionths) for each pair of runs that both have the
    item, of records (run_id, item_id, metric, value). Null values count as missing."""
    value = F.round(F.col("value") * 1_000_000).cast("long")
    rows = records.filter(F.col("value").isNotNull()).select("run_id", "item_id", "metric", value.alias("value"))
    of_item = rows.groupBy("item_id", "metric").agg(F.array_sort(F.collect_list(F.struct("run_id", "value"))).alias("runs"))
    a = of_item.select("item_id", "metric", "runs", F.explode("runs").alias("a"))
    pairs = a.select("item_id", "metric", "a", F.explode(F.filter("runs", lambda r: r["run_id"] > F.col("a.run_id"))).alias("b"))
    return pairs.select("item_id", "metric", F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b"), (F.col("b.value") - F.col("a.value")).alias("difference"))


def replicates(found: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """metric, run_a, run_b, replicate, weighted, weights, flipped: sums over the items of differences()."""
    of_item = found.groupBy("item_id").agg(F.collect_list(F.struct("metric", "run_a", "run_b", "difference")).alias("d"))
    drawn = of_item.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("digest", _digest("replicate", "item_id", seed))
    u = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    weight = sum(((u >= limit).cast("long") for limit in poisson_limits()), F.lit(0).cast("long"))
    sign = F.when(F.instr(F.lit("13579bdf"), F.substring("digest", 9, 1)) > 0, -1).otherwise(1)  # type: ignore[arg-type]
    rows = drawn.select("replicate", weight.alias("w"), sign.alias("s"), F.explode("d").alias("d")).select("replicate", "w", "s", "d.*")
    return rows.groupBy("metric", "run_a", "run_b", "replicate").agg(F.sum(F.col("w") * F.col("difference")).alias("weighted"), F.sum("w").alias("weights"), F.sum(F.col("s") * F.col("difference")).alias("flipped"))


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with p_holm: p corrected for their number, so that the chance of any false finding stays what it is. One
    task takes them all: there is a row for each comparison, not for each item."""
    order = Window.orderBy(p, "metric", "run_a", "run_b")
    left = F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1
    rows = tests.withColumn("p_holm", F.least(F.lit(1.0), left * F.col(p)))
    return rows.withColumn("p_holm", F.round(F.max("p_holm").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6))


def compare(records: DataFrame, n: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """metric, run_a, run_b, items, difference (mean of b less that of a), low, high (the bootstrap's interval), p (of
    the randomisation test), p_holm, significant, for each pair of runs and metric."""
    found = differences(records)
    key = ["metric", "run_a", "run_b"]
    seen = found.groupBy(*key).agg(F.count(F.lit(1)).alias("items"), F.sum("difference").alias("total"))
    drawn = replicates(found, n, seed).join(seen.select(*key, "total"), key)
    mean = F.when(F.col("weights") > 0, F.col("weighted") / F.col("weights") / 1_000_000)
    tail = (1 - level) / 2
    tests = drawn.groupBy(*key).agg(
        F.round(F.percentile(mean, F.lit(tail)), 6).alias("low"),
        F.round(F.percentile(mean, F.lit(1 - tail)), 6).alias("high"),
        F.round((1 + F.count_if(F.abs("flipped") >= F.abs("total"))) / F.lit(n + 1), 6).alias("p"),
    )
    rows = seen.join(tests, key).select(*key, "items", F.round(F.col("total") / F.col("items") / 1_000_000, 6).alias("difference"), "low", "high", "p")
    return holm(rows).withColumn("significant", F.col("p_holm") < F.round(F.lit(1 - level), 9))
