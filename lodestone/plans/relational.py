"""Relational coverage over the star schema and the event stream."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.catalog import query
from lodestone.session import table


def cents(c: str) -> F.Column:
    """Money as a decimal: sums of it don't depend on their order."""
    return F.col(c).cast("decimal(14,2)")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges [low, high] that hold them. Both are cut into cells of `width`, a range into each cell it
    touches, so the join is by equality; each pair meets in the one cell of the point."""
    left = points.withColumn("cell__", F.floor(F.col(at) / width))
    right = ranges.withColumn("cell__", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.join(right, "cell__").filter(F.col(at).between(F.col(low), F.col(high))).drop("cell__")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the last `value` of right of the same key at or before each row: a union and one window."""
    rows = left.select(key, at, F.struct(*left.columns).alias("row__"), F.lit(None).cast(right.schema[value].dataType).alias("v__"), F.lit(1).alias("side__"))
    rows = rows.unionAll(right.select(key, at, F.lit(None).cast(rows.schema["row__"].dataType), F.col(value), F.lit(0)))
    last = F.last("v__", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "side__").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(f"last_{value}", last).filter("side__ = 1").select("row__.*", f"last_{value}")


@query("SELECT n_name, r_name, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(14, 2))) AS DOUBLE) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_inner(spark, folder):
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("c_acctbal")).cast("double").alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_outer(spark, folder):
    rows = table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.max("o_orderdate").alias("latest"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, folder):
    n = table(spark, folder, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(x), F.col("n_regionkey").alias(f"r_{x}")) for x in "ab")
    return a.join(b, (F.col("r_a") == F.col("r_b")) & (F.col("a") < F.col("b"))).select("a", "b")


@query("SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    one = lambda kind: c.join(o, "c_custkey", f"left_{kind}").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one("semi").unionAll(one("anti"))


@query("WITH b AS (SELECT p_partkey AS band, p_retailprice - 1 AS low, p_retailprice + 1 AS high FROM part), p AS (SELECT p_retailprice AS price, count(*) AS c FROM part GROUP BY 1) SELECT band, CAST(sum(c) AS BIGINT) AS n FROM p JOIN b ON price BETWEEN low AND high GROUP BY 1")
def range_join_bands(spark, folder):
    """How many parts cost about as much as each part. Prices are counted before they meet the ranges."""
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    prices = part.groupBy(F.col("p_retailprice").alias("price")).agg(F.count(F.lit(1)).alias("c"))
    bands = part.select(F.col("p_partkey").alias("band"), (F.col("p_retailprice") - 1).alias("low"), (F.col("p_retailprice") + 1).alias("high"))
    return range_join(prices, bands, "price", "low", "high", 2).groupBy("band").agg(F.sum("c").alias("n"))


@query("""WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)), v AS (SELECT user_id, ts, value FROM events WHERE event_type = (SELECT max(event_type) FROM events))
SELECT event_id, c.user_id, c.ts, v.value AS last_value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def asof_join_events(spark, folder):
    events = table(spark, folder, "events")
    kinds = events.agg(F.min("event_type").alias("low"), F.max("event_type").alias("high"))
    of = lambda end: events.join(F.broadcast(kinds), F.col("event_type") == F.col(end))
    return asof_join(of("low").select("event_id", "user_id", "ts"), of("high").select("user_id", "ts", "value"), "user_id", "ts", "value")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(14, 2))) AS DOUBLE) AS qty, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(spark, folder):
    rows = table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(cents("l_quantity")).cast("double").alias("qty"), F.grouping("l_returnflag").cast("int").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, folder):
    o = table(spark, folder, "orders")
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return o.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_nationkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)")
def window_rank(spark, folder):
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(w).alias("q"))


@query("SELECT event_id, lag(event_type) OVER w AS before, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS near, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def window_frame(spark, folder):
    w = Window.partitionBy("user_id").orderBy("event_id")
    near = w.rowsBetween(-4, 0)
    return table(spark, folder, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.count(F.lit(1)).over(near).alias("near"), F.max("value").over(near).alias("top"))


@query("(SELECT 'intersect' AS kind, k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10)) UNION ALL (SELECT 'except', k FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem))")
def set_ops(spark, folder):
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    keys = part.select(F.col("p_partkey").alias("k"))
    both = line.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).intersect(part.filter("p_size < 10").select("p_partkey"))
    return both.select(F.lit("intersect").alias("kind"), "k").unionAll(keys.subtract(line.select("l_partkey")).select(F.lit("except"), "k"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE CAST(o_totalprice AS DECIMAL(14, 2)) = (SELECT max(CAST(o_totalprice AS DECIMAL(14, 2))) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subquery_corr(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("price"))
    top = o.groupBy("o_custkey").agg(F.max("price").alias("price"))
    return o.join(top, ["o_custkey", "price"], "left_semi").select("o_orderkey", "o_custkey")


CHAINS = """WITH RECURSIVE s(conv_id, turn, depth, said) AS (SELECT conv_id, turn, 1, CAST(length(text) AS BIGINT) FROM conversations c WHERE turn = (SELECT min(turn) FROM conversations m WHERE m.conv_id = c.conv_id)
  UNION ALL SELECT c.conv_id, c.turn, s.depth + 1, s.said + length(c.text) FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.turn + 1)
SELECT conv_id, max(depth) AS depth, max(said) AS said FROM s GROUP BY conv_id"""


@query(CHAINS)
def recursive_cte(spark, folder):
    """Each conversation from its first turn on, turn by turn: how many follow without a gap, and their characters."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    view = f"conversations_{uuid.uuid4().hex}"
    table(spark, folder, "conversations").createOrReplaceTempView(view)
    return spark.sql(CHAINS.replace("conversations", view))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_extract(spark, folder):
    k = F.from_json("props", "k int").getField("k")
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(k).alias("k"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def array_hof(spark, folder):
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", F.round(square, 4).alias("norm"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_linestatus = 'F') AS filled FROM lineitem GROUP BY 1")
def pivot(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1)))
    return rows.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("open"), F.coalesce("F", F.lit(0)).alias("filled"))


@query("SELECT user_id, max(pause) AS longest FROM (SELECT user_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS pause FROM events) GROUP BY 1")
def session_gap(spark, folder):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("user_id", (us - F.lag(us).over(w)).alias("pause")).groupBy("user_id").agg(F.max("pause").alias("longest"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def topk_offset(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(5).limit(25)


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, folder):
    line = table(spark, folder, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    revenue = F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")))
    return line.groupBy("l_returnflag", "l_linestatus").agg(revenue.cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(corr(o_totalprice, o_custkey), 6) AS corr FROM orders GROUP BY 1")
def statistics(spark, folder):
    price = "o_totalprice"
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.round(F.stddev_samp(price), 4).alias("sd"), F.round(F.percentile(price, F.lit(0.5)), 4).alias("median"), F.round(F.corr(price, "o_custkey"), 6).alias("corr"))


@query("UNPIVOT (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax FROM lineitem) ON discount, tax INTO NAME rate VALUE value")
def unpivot(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return line.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "rate", "value")


@query("SELECT c_custkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def window_distribution(spark, folder):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, folder, "customer").select("c_custkey", F.round(F.percent_rank().over(w), 9).alias("p"), F.round(F.cume_dist().over(w), 9).alias("c"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour,
first_value(event_id) OVER w AS first, last_value(event_id) OVER w AS last, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_range(spark, folder):
    events = table(spark, folder, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    whole = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hour = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)
    return events.select("event_id", F.count(F.lit(1)).over(hour).alias("last_hour"), F.first("event_id").over(whole).alias("first"), F.last("event_id").over(whole).alias("last"), F.nth_value("event_id", 2).over(whole).alias("second"))


@query("SELECT user_id, string_agg(event_type || '=' || n, ' ' ORDER BY event_type) AS kinds FROM (SELECT user_id, upper(event_type) AS event_type, count(*) * 10 AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def map_functions(spark, folder):
    counts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    m = F.transform_keys(F.transform_values(F.map_filter("m", lambda k, v: v > 1), lambda k, v: v * 10), lambda k, v: F.upper(k))
    rows = maps.withColumn("m", m).filter(F.size("m") > 0)
    return rows.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("kinds"))


SUBQUERIES = """SELECT c_custkey, (SELECT count(*) FROM nation) AS nations, t.o_orderkey AS best
FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)"""


@query(SUBQUERIES)
def subqueries(spark, folder):
    """Scalar, exists and lateral subqueries, as Spark SQL writes them. A lateral ORDER BY with LIMIT becomes a window
    without an order after a global sort, whose order is lost in the exchange between them; so the best order is an
    aggregate. The complement turns the keys round, and null keys come last, as in the twin."""
    views = {t: f"{t}_{abs(hash(folder))}" for t in ("customer", "orders", "nation")}
    sql = SUBQUERIES.replace("(SELECT o_orderkey FROM", "(SELECT max_by(o_orderkey, struct(o_totalprice, ~o_orderkey)) AS o_orderkey FROM")
    sql = sql.replace("ORDER BY o_totalprice DESC, o_orderkey LIMIT 1", "GROUP BY o.o_custkey")
    for t, view in views.items():
        table(spark, folder, t).createOrReplaceTempView(view)
        sql = sql.replace(f"FROM {t}", f"FROM {view}")
    return spark.sql(sql)


@query("SELECT a.s_suppkey AS supplier, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal GROUP BY 1")
def join_inequality(spark, folder):
    """How many suppliers have more, for each: an inequality with no key. Instead of all pairs, a rank of distinct
    balances, whose counts are summed from the top; equal balances share it."""
    s = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    counts = s.groupBy("s_acctbal").agg(F.count(F.lit(1)).alias("n"))
    cell = F.floor(F.col("s_acctbal") / 100)
    cells = counts.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"))
    above = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a cell of balances
    before = cells.select("cell", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    within = Window.partitionBy("cell").orderBy(F.col("s_acctbal").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("cell", cell).withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    richer = ranks.join(before, "cell").select("s_acctbal", (F.col("before") + F.col("inside")).alias("richer")).filter("richer > 0")
    return s.join(richer, "s_acctbal").select(F.col("s_suppkey").alias("supplier"), "richer")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS sold, b.n AS listed FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a FULL JOIN (SELECT s_suppkey + 3 AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def join_full(spark, folder):
    sold = table(spark, folder, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("sold"))
    listed = table(spark, folder, "supplier").groupBy((F.col("s_suppkey") + 3).alias("k")).agg(F.count(F.lit(1)).alias("listed"))
    return sold.join(listed, "k", "full").select("k", "sold", "listed")


@query("SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_hints(spark, folder):
    """A merge join of two tables that grow, and a broadcast of one of 25 rows."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    rows = o.join(table(spark, folder, "customer").select("c_custkey", "c_nationkey").hint("merge"), "c_custkey")
    return rows.join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS exact, true AS near FROM lineitem GROUP BY 1")
def distinct_sketch(spark, folder):
    """Distinct counts, and whether the HyperLogLog sketch comes within 5 per cent of them."""
    rows = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg("l_suppkey", 14)).alias("about"))
    return rows.select("l_returnflag", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@query("SELECT o_orderpriority, max_by(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS dearest, min_by(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS cheapest, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1")
def agg_by(spark, folder):
    at = F.struct("o_totalprice", "o_orderkey")
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", at).alias("dearest"), F.min_by("o_orderkey", at).alias("cheapest"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query("""SELECT event_id, '{"type":"' || event_type || '","k":' || CAST(json_extract_string(props, '$.k') AS INT) || '}' AS body, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def json_variant(spark, folder):
    k = F.variant_get(F.parse_json("props"), "$.k", "int")
    return table(spark, folder, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("body"), k.alias("k"))


@query("SELECT r_name, count(*) AS pairs FROM region CROSS JOIN nation GROUP BY 1")
def join_cross(spark, folder):
    """Two tables of fixed size, 5 and 25 rows."""
    return table(spark, folder, "region").crossJoin(F.broadcast(table(spark, folder, "nation"))).groupBy("r_name").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT p_partkey, round(p_retailprice * 1.2 + 0.5, 4) AS gross, unnest(regexp_extract_all(p_name, '[a-z]+')) AS word FROM part")
def python_functions(spark, folder):
    """A pandas UDF and a table function; built-in functions would be the faster way to the same."""

    @F.pandas_udf("double")
    def gross(price: pd.Series) -> pd.Series:
        return price * 1.2 + 0.5

    @F.udtf(returnType="word: string")
    class Words:
        def eval(self, text: str):
            for word in re.findall("[a-z]+", text or ""):
                yield (word,)

    part = table(spark, folder, "part").select("p_partkey", "p_name", F.round(gross("p_retailprice"), 4).alias("gross"))
    return part.lateralJoin(Words(F.col("p_name").outer())).select("p_partkey", "gross", "word")
