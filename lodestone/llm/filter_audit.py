"""How filters of documents overlap: what each removes, and would remove, in every order they can be applied in.

Words are exploded and aggregated by (document, word), then by document, for the totals and the distinct words of its
text. The result is joined to the documents' other flags with an outer join, since texts without words are missing from
it. Which filters a document fails is a number of five bits; its 32 values are counted in conditional columns for each
part of the corpus, and what any filter does in any order follows from those counts alone.

Filters, by letter, and when a document fails them:
A  fewer than 50 words
B  distinct words are fewer than 65% of the words
C  capital letters A to Z are more than 5% of the code points
D  any of #$%&*| occurs
E  the same text belongs to a smaller id, anywhere in the table, removed or not

A null text is an empty one, with no words: it fails A alone of A to D, and E if it isn't the first. Null ids are
neither smaller nor larger than others: such rows never fail E and have no label. Rows that repeat an id are documents
of their own; those of one text don't fail E for each other. A document is good (toxic) if any of its labels is. A null
source counts as the part with the empty name. No documents give no parts and no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.corpus_words import WORD
from lodestone.llm.tasks import join_uneven, removed, written

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)


def _digest(text: Column) -> list[Column]:
    """128 bits of the SHA-256 of a text, as two longs: the key of equal texts."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "d1"), (17, "d2"))]


def word_counts(texts: DataFrame) -> DataFrame:
    """d1, d2, n_words, n_distinct of texts (d1, d2, text) that have words; equal texts give one row.

    Texts move once, to a partition of their digest and the task that read them, and are exploded and aggregated there:
    exploded words never move, and of a text with very many copies each partition gets those of one task only. Copies of
    one task are told apart from repeated words by their first words."""
    dealt = texts.withColumn("task", F.spark_partition_id()).repartition("d1", "d2", "task")
    words = dealt.select("d1", "d2", "task", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("at", "word")).filter("word IS NOT NULL")
    by_word = words.groupBy("d1", "d2", "task", "word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 0).alias("firsts"))
    by_doc = by_word.groupBy("d1", "d2", "task").agg(F.sum("n").alias("n"), F.sum("firsts").alias("copies"), F.count(F.lit(1)).alias("n_distinct"))
    return by_doc.groupBy("d1", "d2").agg(F.max(F.expr("n div copies")).alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def _text_flags(text: Column) -> list[Column]:
    """Whether C and D fail, each as its bit or 0."""
    c = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text)
    d = text.rlike(r"[#$%&*|]")
    return [F.when(c, 4).otherwise(0).alias("c"), F.when(d, 8).otherwise(0).alias("d")]


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic; rows without an id don't meet the labels."""
    one = lambda name, column: F.max(F.coalesce((F.col(column) == 1).cast("int"), F.lit(0))).alias(name)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(one("good", "quality"), one("toxic", "toxic"))
    found = rows.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    return found.unionByName(rows.filter(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and arrays docs, good and toxic: how many documents (doc_id, text, source) of a part fail just the filters
    of each mask, bit k for letter k, and how many of these are good and toxic. Equal documents are counted before they
    meet the labels, and texts with very many documents are met without moving those."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), *_digest(text), *_text_flags(text))
    rows, rows_path = written(seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias("n")))
    first = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))
    words = word_counts(docs.select(*_digest(text), text.alias("text")))
    texts, texts_path = written(first.join(words, ["d1", "d2"], "left").fillna(0, ["n_words", "n_distinct"]))
    flagged = join_uneven(_labelled(rows, labels), texts, ["d1", "d2"], rows.count(), "n_rows")
    a = F.when(F.col("n_words") < 50, 1).otherwise(0)
    b = F.when(100 * F.col("n_distinct") < 65 * F.col("n_words"), 2).otherwise(0)
    e = F.when(F.col("first_id") < F.col("doc_id"), 16).otherwise(0)
    marked = flagged.select("part", "n", (a + b + F.col("c") + F.col("d") + e).alias("mask"), "good", "toxic")
    kinds = {"docs": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    columns = [F.sum(F.when(F.col("mask") == m, n).otherwise(0)).alias(f"{kind}{m}") for kind, n in kinds.items() for m in range(MASKS)]
    counted = marked.groupBy("part").agg(*columns)
    found, _ = written(counted.select("part", *(F.array(*(f"{kind}{m}" for m in range(MASKS))).alias(kind) for kind in kinds)))
    for path in (rows_path, texts_path):
        removed(docs.sparkSession, path)
    return found


def _steps() -> Column:
    """Every step of every order: filter_order, step, the mask of the filters before it and the bit of its own."""
    found = []
    for order in permutations(range(len(LETTERS))):
        name, before = "".join(LETTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            found.append(F.struct(F.lit(name).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(1 << k).alias("own")))
            before |= 1 << k
    return F.array(*found)


def _total(counts: str, wanted: str, worth: str = "x") -> Column:
    """The sum over masks m, of x documents each, for which `wanted` holds."""
    return F.expr(f"aggregate(transform({counts}, (x, m) -> if({wanted}, {worth}, 0L)), 0L, (a, x) -> a + x)")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    part, order and step. A document that fails f filters is removed by each of them in 1 / f of all orders, which gives
    shapley, the removals of the step's filter summed over all orders, without a sum over them."""
    steps = mask_counts(docs, labels).select("part", "docs", "good", "toxic", F.explode(_steps()).alias("s"))
    rows = steps.select("part", "s.filter_order", "s.step", "docs", "good", "toxic", "s.before", "s.own")
    here, n_orders = "m & own <> 0 AND m & before = 0", len(list(permutations(LETTERS)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        _total("docs", "m & (before | own) = 0").alias("kept"),
        _total("docs", here).alias("removed"),
        _total("docs", "m & own <> 0 AND m & before <> 0").alias("redundant"),
        _total("docs", "m = own").alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        _total("docs", "m & own <> 0", f"x * ({n_orders} div bit_count(m))").alias("shapley"),
    )


ORACLE = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
  + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
k(i) AS (VALUES (0), (1), (2), (3), (4)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda i: 'ABCDE'[i + 1]), '') AS filter_order, step, 1 << p[step] AS own, coalesce(list_sum(list_transform(p[1:step - 1], lambda i: 1 << i)), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
