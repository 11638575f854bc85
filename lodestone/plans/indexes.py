"""Queries over what is stored or learned: indexes in blocks and segments, codes of vectors, embeddings, saved dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import blockmax, embedding, gate, positions, quantised, retrieval, rewriting, rules, selfplay, semantic, significance
from lodestone.plans.catalog import query
from lodestone.plans.evidence import BM25, QRELS, TERMS, _asked, _docs, _index, _qrels, _vectors
from lodestone.session import kept, shared_folder, spread, table
from lodestone.sources import files, literature
from lodestone.sources.segments import Store
from lodestone.streaming import conversations, incremental

RANKED = f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10"


@query(RANKED)
def bm25_blockmax(spark, folder):
    """The result of bm25_topk from an index with block maxima, without most of the postings."""
    return blockmax.search(blockmax.build_blocks(_docs(spark, folder)), _asked(spark, folder), 10)


@query(RANKED.replace("documents", "(SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"))
def segment_search(spark, folder):
    """An index that grows by a segment for each language, loses the copies of texts, and is merged; then a search."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    store = Store(spark, shared_folder(spark))
    for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):
        store.add(docs.filter(F.col("lang") == lang))
    first = docs.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first"))
    copies = docs.select("doc_id", F.md5("text").alias("digest")).join(first, "digest").filter(F.col("doc_id") > F.col("first"))
    store.delete(copies.select("doc_id"))
    store.merge()
    return blockmax.search(store.index(), _asked(spark, folder), 10)


@query()
def knn_quantised(spark, folder):
    """Approximate search: the 10 best by the exact product, out of a short list by codes; every row is indexed."""
    rows, at = _vectors(spark, folder), shared_folder(spark)
    quantised.build(rows, at)
    found = quantised.search(quantised.opened(spark, at), rows.filter(F.col("id") % 20 == 0), 11).filter("query_id <> doc_id").drop("rank")
    return retrieval.top_k(found, 10, "sim")


@query()
def semantic_search(spark, folder):
    """The documents nearest to each question by embeddings learned from the documents."""
    docs, asked = _docs(spark, folder), table(spark, folder, "benchmark")
    given = semantic.factory(spark, semantic.fit(docs))
    return retrieval.knn(embedding.embed(docs, "doc_id", factory=given), embedding.embed(asked, "item_id", factory=given), 10)


def _dumps(spark, folder, at):
    """The documents, saved as dumps of two sources."""
    literature.register(spark)
    docs = table(spark, folder, "documents")
    source = F.when(F.col("lang") == "en", "pubmed").otherwise("europepmc")
    articles = docs.select(F.col("doc_id").cast("string").alias("id"), source.alias("source"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("authors"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"), F.col("text").alias("abstract"))
    articles.write.format("literature").mode("append").save(at)


@query("SELECT CASE WHEN lang = 'en' THEN 'pubmed' ELSE 'europepmc' END AS source, CAST(2000 + doc_id % 25 AS INT) AS year, count(*) AS articles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1, 2")
def literature_years(spark, folder):
    """Articles of each source and year, from landed dumps read in one batch."""
    at = shared_folder(spark)
    _dumps(spark, folder, at)
    return spark.read.format("literature").load(at).groupBy("source", "year").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.length("abstract")).alias("n_chars"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN 'pubmed' ELSE 'europepmc' END AS source, substr(text, 1, 60) AS title, source AS authors,
  CAST(2000 + doc_id % 25 AS INT) AS year, length(text) AS n_chars FROM documents""")
def literature_stream(spark, folder):
    """Articles of two sources, saved as their dumps and loaded by a stream."""
    at = shared_folder(spark)
    _dumps(spark, folder, f"{at}/dumps")
    stream = spark.readStream.format("literature").load(f"{at}/dumps").withColumn("n_chars", F.length("abstract").cast("long")).drop("abstract")
    incremental.run(stream, f"{at}/target", f"{at}/progress")
    return spark.read.schema(stream.schema).parquet(f"{at}/target")


@query(f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({TERMS}, ' ') || ' ' AS held FROM documents), q AS (SELECT item_id AS query_id, ' ' || array_to_string({TERMS}, ' ') || ' ' AS phrase FROM benchmark),
f AS (SELECT query_id, doc_id, substr(held, 1, instr(held, phrase)) AS before FROM d JOIN q ON contains(held, phrase))
SELECT query_id, doc_id, CAST(length(before) - length(replace(before, ' ', '')) - 1 AS INT) AS start FROM f""")
def phrase_search(spark, folder):
    """The documents that hold a passage, term for term, and the place where it first begins."""
    asked = positions.query_places(table(spark, folder, "benchmark"), "item_id")
    found = positions.phrases(positions.positional(_docs(spark, folder)), asked)
    return found.select("query_id", "doc_id", F.col("starts")[0].alias("start"))


@query()
def rerank_learned(spark, folder):
    """The ten best of 50 candidates of BM25 by a ranker that half of the judged questions have taught."""
    docs = _docs(spark, folder)
    queries = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    index = retrieval.build_index(docs)
    candidates = kept(retrieval.top_k(retrieval.bm25(index, retrieval.query_terms(queries, "query_id")), 50))
    found = kept(docs.join(F.broadcast(candidates.select("doc_id").distinct()), "doc_id", "left_semi"))  # features ask for no other texts
    rows = kept(positions.features(retrieval.build_index(found), positions.positional(found), queries, candidates))
    taught = F.pmod(F.xxhash64("query_id"), F.lit(2)) == 1
    return positions.ranked(rows, positions.learn(rows.filter(taught), _qrels(spark, folder).filter(taught)), 10)


@query(f"""WITH {BM25}, s AS (SELECT query_id, doc_id AS id, score / sum(score) OVER (PARTITION BY query_id) AS share FROM ranked WHERE rank <= 10),
w AS (SELECT query_id, term, round(sum(share * tf.tf / dl.dl), 9) AS weight FROM s JOIN tf USING (id) JOIN dl USING (id) GROUP BY 1, 2),
best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) <= 20),
parts AS (SELECT query_id, term, 0.5 * weight / sum(weight) OVER (PARTITION BY query_id) AS weight FROM best
  UNION ALL SELECT query_id, term, CAST(0.5 AS DOUBLE) / count(*) OVER (PARTITION BY query_id) FROM q WHERE query_id IN (SELECT query_id FROM best) UNION ALL SELECT query_id, term, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY query_id) FROM q WHERE query_id NOT IN (SELECT query_id FROM best))
SELECT query_id, term, round(sum(weight), 6) AS weight FROM parts GROUP BY 1, 2""")
def rewrite_feedback(spark, folder):
    """The questions' terms and those that weigh most in their ten best documents."""
    index, asked = _index(spark, folder), _asked(spark, folder)
    return rewriting.feedback(index, asked, retrieval.top_k(retrieval.bm25(index, asked), 10))


@query(f"""WITH v AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TERMS}) AS term FROM documents) WHERE regexp_full_match(term, '[a-z]+') GROUP BY 1),
a AS (SELECT DISTINCT unnest({TERMS}) AS word FROM benchmark), w AS (SELECT substr(word, 1, 1) || substr(word, 3) AS word FROM a WHERE regexp_full_match(word, '[a-z]{{5,}}') GROUP BY 1)
SELECT word, term, df, CAST(levenshtein(word, term) AS INT) AS edits FROM w JOIN v ON abs(length(word) - length(term)) <= 2 AND levenshtein(word, term) <= 2""")
def spelling_candidates(spark, folder):
    """For each question's words, with the second letter left out, all words of the documents within two edits."""
    plain = lambda c: F.col(c).rlike("^[a-z]+$")
    words = _index(spark, folder).df.filter(plain("term"))
    asked = _asked(spark, folder).select("term").distinct().filter(plain("term") & (F.length("term") >= 5))
    missed = asked.select(F.concat(F.substring("term", 1, 1), F.expr("substring(term, 3)")).alias("word"))
    return rewriting.within(rewriting.spelling_index(words), missed)


GRID = {"1-short": (0.9, 0.4), "2-usual": (1.2, 0.75), "3-flat": (2.0, 0.0)}
LIMITS = " + ".join(f"CAST(u >= {limit} AS BIGINT)" for limit in significance.poisson_limits())


@query(f"""WITH {BM25}, {QRELS}, g(run_id, k1, b) AS (VALUES ('1-short', 0.9, 0.4), ('2-usual', 1.2, 0.75), ('3-flat', 2.0, 0.0)),
s AS (SELECT run_id, q.query_id, tf.id AS doc_id, round(sum(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * tf.tf * (k1 + 1) / (tf.tf + k1 * (1 - b + b * dl.dl / avg_dl))), 6) AS score FROM g CROSS JOIN q JOIN dfr USING (term) JOIN tf USING (term) JOIN dl ON dl.id = tf.id CROSS JOIN st GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
f AS (SELECT run_id, query_id, round(1 / min(rank), 6) AS rr FROM r JOIN qrels USING (query_id, doc_id) GROUP BY 1, 2),
v AS (SELECT g.run_id, j.query_id AS item_id, CAST(round(coalesce(rr, 0) * 1000000) AS BIGINT) AS value FROM g CROSS JOIN (SELECT DISTINCT query_id FROM qrels) j LEFT JOIN f ON f.run_id = g.run_id AND f.query_id = j.query_id),
d AS (SELECT a.item_id, a.run_id AS run_a, b.run_id AS run_b, b.value - a.value AS difference FROM v a JOIN v b ON a.item_id = b.item_id AND a.run_id < b.run_id),
h AS (SELECT item_id, replicate, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS u, CASE WHEN contains('13579bdf', substr(digest, 9, 1)) THEN -1 ELSE 1 END AS s FROM (SELECT item_id, replicate, md5('7:' || replicate || ':' || item_id) AS digest FROM (SELECT DISTINCT item_id FROM d) CROSS JOIN range(400) t(replicate))),
b AS (SELECT run_a, run_b, replicate, sum(({LIMITS}) * difference) AS weighted, sum({LIMITS}) AS weights, sum(s * difference) AS flipped FROM d JOIN h USING (item_id) GROUP BY 1, 2, 3),
o AS (SELECT run_a, run_b, count(*) AS items, sum(difference) AS total FROM d GROUP BY 1, 2),
t AS (SELECT run_a, run_b, round(quantile_cont(CASE WHEN weights > 0 THEN CAST(weighted AS DOUBLE) / CAST(weights AS DOUBLE) / 1000000 END, 0.025), 6) AS low, round(quantile_cont(CASE WHEN weights > 0 THEN CAST(weighted AS DOUBLE) / CAST(weights AS DOUBLE) / 1000000 END, 0.975), 6) AS high,
  round((1 + count(*) FILTER (WHERE abs(flipped) >= abs(total))) / 401, 6) AS p FROM b JOIN o USING (run_a, run_b) GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (ORDER BY p, run_a, run_b) AS nth, count(*) OVER () AS m FROM t),
e AS (SELECT *, round(max(least(1.0, (m - nth + 1) * p)) OVER (ORDER BY p, run_a, run_b ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM c)
SELECT 'rr' AS metric, run_a, run_b, items, round(CAST(total AS DOUBLE) / items / 1000000, 6) AS difference, low, high, p, CAST(p_holm AS DOUBLE) AS p_holm, p_holm < 0.05 AS significant FROM e JOIN o USING (run_a, run_b)""")
def run_significance(spark, folder):
    """Three runs against each other by reciprocal rank: bootstrap intervals, randomisation tests, Holm's correction."""
    scores = selfplay.grid_scores(_index(spark, folder), _asked(spark, folder), GRID)
    return significance.compare(selfplay.records(scores, _qrels(spark, folder), metric="rr", strategies=list(GRID)), n=400)


@query()
def self_play(spark, folder):
    """Eight strategies play against each other on more and more questions, the better half staying each time."""
    grid = {f"{k1}/{b}": (k1, b) for k1 in (0.6, 1.2, 1.8, 2.4) for b in (0.25, 0.75)}
    return selfplay.halving(_index(spark, folder), _asked(spark, folder), _qrels(spark, folder), grid)


@query("""SELECT conv_id, turn, role, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said,
  coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS recent, lag(text) OVER w AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_state(spark, folder):
    """What was said before each turn, from state that a stream keeps for each conversation."""
    at = shared_folder(spark)
    schema = table(spark, folder, "conversations").schema
    # a turn a minute, conversations one after the other: the table has no times
    stream = incremental.landed(spark, f"{folder}/conversations.parquet*", schema).withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("conv_id") + 60 * F.col("turn")))
    conversations.run(stream, f"{at}/target", f"{at}/progress")
    return spark.read.schema(conversations.OUT).parquet(f"{at}/target").filter("not closed").drop("closed")


HELD = f"""held AS (SELECT doc_id, quality, list_sort(list_distinct({TERMS})) AS held FROM documents JOIN labels USING (doc_id)), need AS (SELECT (count(*) * 3) // 5 AS least FROM labels),
one AS (SELECT term FROM (SELECT unnest(held) AS term FROM held) GROUP BY 1 HAVING count(*) >= (SELECT least FROM need))"""


@query(f"""WITH {HELD}, sets AS (SELECT list_sort([t.term]) AS items FROM one t UNION ALL SELECT [a.term, b.term] FROM one a JOIN one b ON a.term < b.term UNION ALL SELECT [a.term, b.term, c.term] FROM one a JOIN one b ON a.term < b.term JOIN one c ON b.term < c.term),
f AS (SELECT items, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good FROM sets JOIN held ON list_has_all(held, items) GROUP BY 1 HAVING count(*) >= (SELECT least FROM need))
SELECT array_to_string(items, ' ') AS items, n AS support, round(good / n, 6) AS success, round(ln((good + 1.0) / (n - good + 1.0)), 6) AS weight,
  NOT EXISTS (SELECT 1 FROM f g WHERE len(g.items) = len(f.items) + 1 AND g.n = f.n AND list_has_all(g.items, f.items)) AS closed FROM f""")
def rule_sets(spark, folder):
    """Sets of up to three terms that three fifths of the labelled documents hold, as rules for quality."""
    labels = table(spark, folder, "labels")
    found = rules.mine(_docs(spark, folder), labels, labels.count() * 3 // 5)
    return found.withColumn("items", F.array_join("items", " "))


@query()
def trained_gate(spark, folder):
    """The language of what users say, by a gate learned from the documents, which refuses what it isn't sure of."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    said = table(spark, folder, "conversations").filter("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text")
    return gate.judge(gate.fit(docs, row_id="doc_id", label="lang"), said)


@query(f"WITH q AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) SELECT 'terms' AS run_id, item_id, 'distinct' AS metric, CAST(count(DISTINCT term) AS DOUBLE) AS value FROM q GROUP BY item_id")
def experiment_log(spark, folder):
    """Records of an experiment, written as a log of JSON lines and read again: how many terms each question has."""
    at = f"{shared_folder(spark)}/log"
    counts = _asked(spark, folder).groupBy(F.col("query_id").alias("item_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    files.write_log(counts.select(F.lit("terms").alias("run_id"), "item_id", F.lit("distinct").alias("metric"), "value"), at)
    return spark.read.schema(files.schema("table_eval_record")).json(at)
