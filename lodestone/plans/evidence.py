"""Queries of documents, retrieval, the agent's stages, evolution, safety, evaluation and service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import strip_tags
from lodestone.operators import agent, embedding, evaluation, evolution, retrieval, safety
from lodestone.plans.catalog import query
from lodestone.session import dealt, kept, shared_folder, spread, table
from lodestone.sources import files
from lodestone.streaming import incremental

TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"""
BM25 = f"""
tok AS (SELECT doc_id AS id, unnest({TERMS}) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT doc_id AS id, len({TERMS}) AS dl FROM documents),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl),
dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark),
bm AS (SELECT q.query_id, tf.id AS doc_id, round(sum(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / avg_dl))), 6) AS score
  FROM q JOIN dfr USING (term) JOIN tf USING (term) JOIN dl ON dl.id = tf.id CROSS JOIN st GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""
COLL = "(['coll_cn_guide', 'coll_rct_meta', 'coll_common_study'])[CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 + 1]"
WEIGHTED = f""", wt AS (SELECT query_id, doc_id, {COLL} AS collection, score * CAST(([1.5, 1.0, 0.5])[CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 + 1] AS DOUBLE) AS score FROM bm JOIN documents USING (doc_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM wt QUALIFY rank <= 10)"""
QRELS = "qrels AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
DOT = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
KNN = f"""sims AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.label AS query_label, b.label AS label, {DOT} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"""


def _put(sql: str, **parts: str) -> str:
    """The SQL with its named parts; regular expressions keep their braces."""
    for name, part in parts.items():
        sql = sql.replace("{" + name + "}", part)
    return sql


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of documents that searches read."""
    return dealt(table(spark, folder, "documents").select("doc_id", "text", "source"), "doc_id")


def _index(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> retrieval.Index:
    return retrieval.build_index(_docs(spark, folder) if docs is None else docs)


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.query_terms(table(spark, folder, "benchmark"), "item_id")


def _bm25(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> DataFrame:
    return retrieval.bm25(_index(spark, folder, docs), _asked(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _neighbours(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others; one more is asked for, which is the vector itself."""
    rows = _vectors(spark, folder)
    found = retrieval.knn(rows, rows.filter(F.col("id") % 20 == 0), k + 1).filter("query_id <> doc_id").drop("rank")
    return retrieval.top_k(found, k, "sim")


@query(f"SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY 1, 2")
def tokenize_tf(spark, folder):
    return _index(spark, folder).tf.select("id", "term", "tf")


@query(f"WITH {BM25} SELECT term, df, round(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfr CROSS JOIN st")
def doc_freq_idf(spark, folder):
    index = _index(spark, folder)
    return index.df.crossJoin(F.broadcast(index.stats)).select("term", "df", F.round(retrieval.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, folder, scored=None):
    return retrieval.top_k(_bm25(spark, folder) if scored is None else scored, 10)


CHUNKS = "SELECT doc_id, CAST(i AS INT) AS chunk_no, substr(text, CAST(i * {step} + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - {overlap}) / {step}.0)) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)"


@query(CHUNKS.format(step=500, overlap=0))
def chunk_fixed(spark, folder):
    return retrieval.chunk(_docs(spark, folder), 500)


@query(CHUNKS.format(step=400, overlap=100))
def chunk_overlap(spark, folder):
    return retrieval.chunk(_docs(spark, folder), 500, 100)


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, folder):
    return table(spark, folder, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"SELECT page_id, {PLAIN} AS text FROM pages")
def html_to_text(spark, folder):
    return spread(table(spark, folder, "pages").select("page_id", "html")).select("page_id", strip_tags(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages")
def page_metadata(spark, folder):
    pages = table(spark, folder, "pages")
    take = lambda c, p: F.regexp_extract(c, p, 1)
    return pages.select("page_id", take("html", "<title>([^<]*)</title>").alias("title"), take("html", '<html lang="([a-z]+)"').alias("lang"), take("url", "://([^/?#]*)").alias("host"))


@query(f"WITH {KNN} SELECT query_id, doc_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM sims QUALIFY rank <= 10")
def knn_exact(spark, folder):
    return _neighbours(spark, folder, 10)


@query(f"WITH {KNN}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM sims QUALIFY rank <= 10) SELECT query_id, round(avg(CAST(label = query_label AS INT)), 6) AS same_label FROM top GROUP BY 1")
def knn_label_recall(spark, folder):
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    one, other = (labels.select(F.col("vec_id").alias(n), F.col("label").alias(f"label_{n}")) for n in ("query_id", "doc_id"))
    rows = _neighbours(spark, folder, 10).join(one, "query_id").join(other, "doc_id")
    return rows.groupBy("query_id").agg(F.round(F.avg((F.col("label_query_id") == F.col("label_doc_id")).cast("int")), 6).alias("same_label"))


@query()
def knn_cells(spark, folder):
    """Approximate search: the 10 nearest within the 10 nearest of 16 cells; every row is indexed."""
    rows = _vectors(spark, folder)
    found = retrieval.search(rows, rows.filter(F.col("id") % 20 == 0), 11, "cells").filter("query_id <> doc_id").drop("rank")
    return retrieval.top_k(found, 10, "sim")


@query(f"WITH {BM25}{WEIGHTED} SELECT query_id, doc_id, collection, score, rank FROM top")
def collection_weighted(spark, folder, scored=None):
    docs = table(spark, folder, "documents").withColumn("collection", retrieval.collection_of(F.col("source")))
    return retrieval.top_k(retrieval.weight_collections(_bm25(spark, folder) if scored is None else scored, docs), 10)


#: Queries and vectors have unrelated ids; a query's vector is the one of its number, which only exercises the mechanics.
SIDES = f"""WITH {BM25}, t AS (SELECT * FROM ranked WHERE rank <= 50),
vs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {DOT} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id IN (SELECT item_id FROM benchmark)),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM vs QUALIFY rank <= 50)"""


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _vectors(spark, folder)
    asked = rows.join(table(spark, folder, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi")
    return retrieval.top_k(_bm25(spark, folder), 50), retrieval.knn(rows, asked, 50)


PARTS = """s AS (
  SELECT query_id, doc_id, 0.5 * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS part FROM t WINDOW w AS (PARTITION BY query_id)
  UNION ALL SELECT query_id, doc_id, 0.5 * CASE WHEN max(sim) OVER w = min(sim) OVER w THEN 1.0 ELSE (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) END FROM v WINDOW w AS (PARTITION BY query_id))"""


@query(f"""{SIDES}, {PARTS}
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM s GROUP BY 1, 2) QUALIFY rank <= 10""")
def fusion_minmax(spark, folder):
    return retrieval.top_k(retrieval.fuse(*_sides(spark, folder)), 10)


@query(f"""{SIDES}, s AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS part FROM t UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM v)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(CAST(part AS DOUBLE)), 6) AS score FROM s GROUP BY 1, 2) QUALIFY rank <= 10""")
def fusion_rrf(spark, folder):
    return retrieval.top_k(retrieval.fuse(*_sides(spark, folder), mode="rrf"), 10)


@query(f"""WITH {BM25}, dt AS (SELECT doc_id, list_distinct({TERMS}) AS held FROM documents), qt AS (SELECT item_id AS query_id, list_distinct({TERMS}) AS asked FROM benchmark),
s AS (SELECT query_id, doc_id, round(len(list_intersect(asked, held)) / greatest(1, len(asked) + len(held) - len(list_intersect(asked, held))), 6) AS score FROM ranked JOIN dt USING (doc_id) JOIN qt USING (query_id) WHERE rank <= 20)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def rerank_lexical(spark, folder):
    queries = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    return retrieval.rerank(retrieval.top_k(_bm25(spark, folder), 20), queries, table(spark, folder, "documents"), 5)


@query(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark), syn(term, synonym) AS (VALUES ('the', 'this'), ('and', 'with'), ('und', 'mit'), ('la', 'le'))
SELECT query_id, term FROM q UNION SELECT query_id, synonym FROM q JOIN syn USING (term)""")
def rewrite_expand(spark, folder):
    return retrieval.expand(_asked(spark, folder), agent.synonyms(spark))


@query(f"WITH {KNN} SELECT query_id, max(sim) AS top_sim FROM sims GROUP BY 1 HAVING max(sim) < 0.7")
def knowledge_gaps(spark, folder):
    return retrieval.gaps(_neighbours(spark, folder, 1))


PAGES_BM25 = f"""
ptext AS (SELECT page_id AS id, {PLAIN} AS text FROM pages), ptok AS (SELECT id, unnest({TERMS}) AS term FROM ptext), ptf AS (SELECT id, term, count(*) AS tf FROM ptok GROUP BY 1, 2),
pdl AS (SELECT id, len({TERMS}) AS dl FROM ptext), pst AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM pdl), pdf AS (SELECT term, count(*) AS df FROM ptf GROUP BY 1),
pbm AS (SELECT q.query_id, ptf.id AS doc_id, round(sum(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * ptf.tf * 2.2 / (ptf.tf + 1.2 * (0.25 + 0.75 * pdl.dl / avg_dl))), 6) AS score
  FROM {{asked}} q JOIN pdf USING (term) JOIN ptf USING (term) JOIN pdl ON pdl.id = ptf.id CROSS JOIN pst GROUP BY 1, 2)"""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "pages").select("page_id", "html"), "page_id").select(F.col("page_id").alias("doc_id"), strip_tags(F.col("html")).alias("text"))


def _outside(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    return retrieval.bm25(retrieval.build_index(_pages(spark, folder)), asked)


COVER = f"""asked AS (SELECT query_id, list(term) AS asked FROM q GROUP BY 1), held AS (SELECT doc_id, list_distinct({TERMS}) AS held FROM documents),
cover AS (SELECT query_id, round(max(len(list_intersect(asked, held)) / len(asked)), 6) AS top_sim FROM {{ranked}} JOIN held USING (doc_id) JOIN asked USING (query_id) GROUP BY 1)"""


@query(f"""WITH {BM25}, r10 AS (SELECT * FROM ranked WHERE rank <= 10), {_put(COVER, ranked="r10")}, gap AS (SELECT * FROM cover WHERE top_sim < 0.95), thin AS (SELECT q.* FROM q JOIN gap USING (query_id)), {_put(PAGES_BM25, asked="thin")},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pbm QUALIFY rank = 1)
SELECT query_id, top_sim, doc_id, score, CASE WHEN doc_id IS NULL THEN 'open' ELSE 'filled' END AS status FROM gap LEFT JOIN best USING (query_id)""")
def gap_fill(spark, folder):
    asked = _asked(spark, folder)
    ranked = retrieval.top_k(retrieval.bm25(_index(spark, folder), asked), 10)
    found = agent.coverage(asked, ranked, table(spark, folder, "documents")).filter("top_sim < 0.95")
    return evolution.fill_gaps(found, _outside(spark, folder, asked.join(found.select("query_id"), "query_id", "left_semi")))


@query(f"""WITH {BM25}, {_put(PAGES_BM25, asked="q")}, l AS (SELECT query_id, md5(text) AS doc_key, score, 'local' AS origin FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5),
e AS (SELECT query_id, md5(text) AS doc_key, score, 'external' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pbm QUALIFY rank <= 5) JOIN ptext ON ptext.id = doc_id)
SELECT query_id, doc_key, score, origin FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_key ORDER BY origin = 'local' DESC, score DESC) AS n FROM (FROM l UNION ALL FROM e)) WHERE n = 1""")
def external_merge(spark, folder):
    asked = _asked(spark, folder)
    keyed = lambda hits, docs: docs.select("doc_id", F.md5("text").alias("doc_key")).join(F.broadcast(retrieval.top_k(hits, 5)), "doc_id").select("query_id", "doc_key", "score")
    local = keyed(retrieval.bm25(_index(spark, folder), asked), table(spark, folder, "documents"))
    return retrieval.merge_sources(local, keyed(_outside(spark, folder, asked), _pages(spark, folder)))


@query(f"SELECT id, text, digest FROM (SELECT page_id AS id, {PLAIN} AS text, md5({PLAIN}) AS digest FROM pages) WHERE digest NOT IN (SELECT md5(text) FROM documents) QUALIFY row_number() OVER (PARTITION BY digest ORDER BY id) = 1")
def auto_save_anti(spark, folder):
    return retrieval.not_stored(_pages(spark, folder).withColumnRenamed("doc_id", "id"), table(spark, folder, "documents"))


HITS = f"""m AS (SELECT {{id}} AS query_id, list_distinct({TERMS}) AS found FROM {{rows}}),
h AS (SELECT query_id, d, CAST(list_contains(found, w) AS INT) AS hits FROM m CROSS JOIN (VALUES ('hypertension', 'the'), ('hyperlipidaemia', 'la'), ('type-2 diabetes', 'und'), ('comorbidity', 'une')) k(d, w)),
known AS (SELECT query_id, sum(hits) = 0 AS refused, min(d) FILTER (WHERE hits > 0) AS disease, max(hits) AS hits FROM h GROUP BY 1)"""
USERS = "(SELECT conv_id || ':' || turn AS qid, text FROM conversations WHERE role = 'user')"


def _said(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").filter("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text")


@query(f"WITH {_put(HITS, id='qid', rows=USERS)} SELECT query_id, refused FROM known")
def domain_gate(spark, folder):
    return agent.gate(_said(spark, folder))


@query(f"WITH {_put(HITS, id='qid', rows=USERS)} SELECT query_id, disease, hits FROM known")
def classify_query(spark, folder):
    return agent.classify(_said(spark, folder))


EVIDENCE = """ev AS (SELECT query_id, count(*) FILTER (WHERE score >= 10.0) AS n_good, count(DISTINCT collection) FILTER (WHERE score >= 10.0) AS n_collections,
  round(least(1.0, coalesce(sum(CASE collection WHEN 'coll_cn_guide' THEN 1.5 WHEN 'coll_rct_meta' THEN 1.0 ELSE 0.5 END) FILTER (WHERE score >= 10.0), 0) / 15.0), 6) AS confidence FROM {ranked} GROUP BY 1)"""


def _weighted(spark: SparkSession, folder: str) -> DataFrame:
    return collection_weighted(spark, folder)


@query(f"WITH {BM25}{WEIGHTED}, {_put(EVIDENCE, ranked='top')} SELECT query_id, n_good, n_collections, CAST(confidence AS DOUBLE) AS confidence, n_good >= 3 AND n_collections >= 2 AS sufficient FROM ev")
def evidence_sufficiency(spark, folder):
    return agent.evidence(_weighted(spark, folder))


@query(f"WITH {BM25}{WEIGHTED} SELECT query_id, string_agg(rank || ':' || doc_id, ' ' ORDER BY rank) AS \"references\" FROM top GROUP BY 1")
def evidence_bundle(spark, folder):
    return agent.bundle(_weighted(spark, folder)).select("query_id", agent.reference_text().alias("references"))


PLACE = "CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64"
SIGN = "(1 - 2 * (CAST('0x' || substr(md5(term), 9, 1) AS BIGINT) % 2))"


def _embedded(name: str, counts: str, ids: str) -> str:
    """SQL of `name` (id, v): hashing embeddings of 64 numbers. counts: id, term, tf; ids: a row for each id."""
    return f"""{name}_p AS (SELECT id, {PLACE} AS place, sum({SIGN} * tf) AS x FROM {counts} GROUP BY 1, 2),
{name}_m AS (SELECT id, map(list(place), list(x)) AS m, sqrt(sum(x * x)) AS norm FROM {name}_p GROUP BY 1),
{name} AS (SELECT i.id, list_transform(range(64), lambda k: CASE WHEN norm > 0 THEN coalesce(CAST(m[k] AS DOUBLE), 0) / norm ELSE CAST(0 AS DOUBLE) END) AS v FROM {ids} i LEFT JOIN {name}_m USING (id))"""


QUESTIONS = f"qtf AS (SELECT item_id AS id, term, count(*) AS tf FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY 1, 2)"


@query(f"WITH {BM25}, {_embedded('e', 'tf', '(SELECT doc_id AS id FROM documents)')} SELECT id AS doc_id, CAST(k AS INT) AS place, round(v[k + 1], 6) AS value FROM (SELECT id, v, unnest(range(64)) AS k FROM e) WHERE v[k + 1] <> 0")
def embed_hashing(spark, folder):
    rows = embedding.embed(_docs(spark, folder), "doc_id").select("id", F.posexplode("vector").alias("place", "value"))
    return rows.filter("value <> 0").select(F.col("id").alias("doc_id"), "place", F.round("value", 6).alias("value"))


@query(f"""WITH c AS ({CHUNKS.format(step=500, overlap=0)}), ctf AS (SELECT doc_id || ':' || chunk_no AS id, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest({TERMS}) AS term FROM c) GROUP BY 1, 2),
{_embedded('e', 'ctf', "(SELECT doc_id || ':' || chunk_no AS id FROM c)")}
SELECT d.source AS collection, count(*) AS chunks, round(sum(list_max(v)), 4) AS peaks FROM (SELECT {COLL} AS source, doc_id FROM documents) d JOIN (SELECT CAST(split_part(id, ':', 1) AS BIGINT) AS doc_id, v FROM e) USING (doc_id) GROUP BY 1""")
def vector_rebuild(spark, folder):
    """The vector store anew, chunk by chunk, and what it then holds."""
    at = shared_folder(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", retrieval.collection_of(F.col("source")).alias("collection"))
    files.rebuild_vectors(docs, at)
    rows = spark.read.parquet(at)
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.sum(F.array_max("vector")), 4).alias("peaks"))


@query(f"""WITH {_put(HITS, id='item_id', rows='benchmark')}, {BM25.replace('FROM benchmark)', 'FROM benchmark WHERE item_id IN (SELECT query_id FROM known WHERE NOT refused))')}, {QUESTIONS},
{_embedded('de', 'tf', '(SELECT doc_id AS id FROM documents)')}, {_embedded('qe', 'qtf', '(SELECT query_id AS id FROM known WHERE NOT refused)')},
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM (SELECT q.id AS query_id, d.id AS doc_id, round(list_dot_product(q.v, d.v), 6) AS sim FROM qe q CROSS JOIN de d) QUALIFY rank <= 50),
t AS (SELECT * FROM ranked WHERE rank <= 50), {PARTS},
fused AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM s GROUP BY 1, 2),
cand AS (SELECT query_id, doc_id, {COLL} AS collection, score * CAST(([1.5, 1.0, 0.5])[CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 + 1] AS DOUBLE) AS w FROM fused JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, doc_id) <= 20),
asked AS (SELECT query_id, list(term) AS asked FROM q GROUP BY 1), held AS (SELECT doc_id, list_distinct({TERMS}) AS held FROM documents),
local AS (SELECT query_id, doc_id, collection, round(len(list_intersect(asked, held)) / len(asked), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(len(list_intersect(asked, held)) / len(asked), 6) DESC, doc_id) AS rank FROM cand JOIN held USING (doc_id) JOIN asked USING (query_id)),
sims AS (SELECT k.query_id, coalesce(max(score), 0) AS top_sim FROM known k LEFT JOIN local USING (query_id) WHERE NOT refused GROUP BY 1),
lev AS (SELECT query_id FROM local WHERE rank <= 10 GROUP BY 1 HAVING count(*) FILTER (WHERE score >= 0.3) >= 3 AND count(DISTINCT collection) FILTER (WHERE score >= 0.3) >= 2),
searched AS (SELECT query_id FROM sims WHERE top_sim < 0.7 OR query_id NOT IN (FROM lev)), thin AS (SELECT q.* FROM q JOIN searched USING (query_id)), {_put(PAGES_BM25, asked='thin')},
ph AS (SELECT id AS doc_id, list_distinct({TERMS}) AS held FROM ptext), pc AS (SELECT query_id, doc_id FROM pbm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20),
allhits AS (SELECT query_id, doc_id, collection, score FROM local UNION ALL SELECT query_id, -1 - doc_id, 'coll_common_study', round(len(list_intersect(asked, held)) / len(asked), 6) FROM pc JOIN ph USING (doc_id) JOIN asked USING (query_id)),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id < 0, abs(doc_id)) AS r FROM allhits WHERE score > 0 QUALIFY r <= 10), {_put(EVIDENCE.replace('10.0', '0.3'), ranked='final')},
texts AS (SELECT doc_id, substr(text, 1, 200) AS begins FROM documents UNION ALL SELECT -1 - id, substr(text, 1, 200) FROM ptext),
cited AS (SELECT query_id, string_agg(r || ':' || doc_id, ' ' ORDER BY r) AS refs, max(begins) FILTER (WHERE r = 1) AS answer FROM final JOIN texts USING (doc_id) GROUP BY 1)
SELECT query_id, 'u' || (query_id % 7) AS user_id, query_id % 3 AS conversation_id, CASE WHEN refused THEN 'refused' WHEN n_good >= 3 AND n_collections >= 2 THEN 'success' ELSE 'insufficient' END AS status, disease, top_sim,
  CASE WHEN refused THEN 1 WHEN query_id IN (FROM searched) THEN 5 ELSE 4 END AS rounds_used, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence, coalesce(answer, '') AS answer, coalesce(refs, '') AS "references"
FROM known LEFT JOIN sims USING (query_id) LEFT JOIN ev USING (query_id) LEFT JOIN cited USING (query_id)""")
def agent_pipeline(spark, folder):
    asked = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    asked = asked.withColumns({"user_id": F.concat(F.lit("u"), F.col("query_id") % 7), "conversation_id": F.col("query_id") % 3})
    return agent.answer(asked, _docs(spark, folder), _pages(spark, folder)).withColumn("references", agent.reference_text())


@query("SELECT conv_id, turn, role, coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def conversation_context(spark, folder):
    return agent.context(table(spark, folder, "conversations"))


@query("""WITH p AS (SELECT conv_id, role, text AS question, lead(role) OVER w AS nxt, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT question, answer, count(*) AS n, min(conv_id) AS first_conv FROM p WHERE role = 'user' AND nxt = 'assistant' GROUP BY 1, 2)
SELECT question, answer, CAST(sum(n) OVER (PARTITION BY question) AS BIGINT) AS hits, min(first_conv) OVER (PARTITION BY question) AS first_conv FROM a QUALIFY row_number() OVER (PARTITION BY question ORDER BY n DESC, answer) = 1""")
def memory_lookup(spark, folder):
    return evolution.memory(table(spark, folder, "conversations"))


MEMORY = """p AS (SELECT conv_id, role, text AS question, lead(role) OVER w AS nxt, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT question, answer, count(*) AS n FROM p WHERE role = 'user' AND nxt = 'assistant' GROUP BY 1, 2),
bank AS (SELECT md5(question) AS id, question, answer FROM a QUALIFY row_number() OVER (PARTITION BY question ORDER BY n DESC, answer) = 1)"""


@query(f"""WITH {MEMORY}, {QUESTIONS}, btf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TERMS.replace('text', 'question')}) AS term FROM bank) GROUP BY 1, 2),
{_embedded('be', 'btf', 'bank')}, {_embedded('qe', 'qtf', '(SELECT item_id AS id FROM benchmark)')},
n AS (SELECT q.id AS query_id, b.id AS key, round(list_dot_product(q.v, b.v), 6) AS sim FROM qe q CROSS JOIN be b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, key) AS rank FROM n QUALIFY rank <= 3)
SELECT query_id, question, answer, sim, rank FROM r JOIN bank ON bank.id = key WHERE sim >= 0""")
def memory_similar(spark, folder):
    asked = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    return evolution.recall_memory(evolution.memory(table(spark, folder, "conversations")), asked)


def _qrels(spark: SparkSession, folder: str) -> DataFrame:
    """Few rows, as plans read them several times: kept."""
    return kept(evaluation.passages_in(_docs(spark, folder), table(spark, folder, "benchmark")))


GRID = [(0.9, 0.4), (1.2, 0.75), (2.0, 0.75)]


@query(f"""WITH {BM25}, {QRELS}, g(k1, b) AS (VALUES (0.9, 0.4), (1.2, 0.75), (2.0, 0.75)),
s AS (SELECT k1, b, q.query_id, tf.id AS doc_id, round(sum(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * tf.tf * (k1 + 1) / (tf.tf + k1 * (1 - b + b * dl.dl / avg_dl))), 6) AS score FROM g CROSS JOIN q JOIN dfr USING (term) JOIN tf USING (term) JOIN dl ON dl.id = tf.id CROSS JOIN st GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
m AS (SELECT k1, b, query_id, 1.0 / min(rank) AS rr FROM r JOIN qrels USING (query_id, doc_id) GROUP BY 1, 2, 3),
t AS (SELECT g.k1, g.b, round(coalesce(sum(CAST(rr AS DOUBLE)), 0) / (SELECT greatest(1, count(DISTINCT query_id)) FROM qrels), 6) AS mrr FROM g LEFT JOIN m ON m.k1 = g.k1 AND m.b = g.b GROUP BY 1, 2)
SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b, mrr, row_number() OVER (ORDER BY mrr DESC, k1, b) = 1 AS champion FROM t""")
def strategy_grid(spark, folder):
    return evolution.strategy_grid(_index(spark, folder), _asked(spark, folder), _qrels(spark, folder), GRID)


@query(f"""WITH f AS (SELECT doc_id, unnest(list_distinct({TERMS})) AS rule FROM documents), r AS (SELECT rule, count(*) AS support, CAST(sum(quality) AS BIGINT) AS good FROM f JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 5)
SELECT md5(rule) AS rule_id, rule AS text, support, round(good / support, 6) AS success, round(ln((good + 1.0) / (support - good + 1.0)), 6) AS weight FROM r""")
def rule_support(spark, folder):
    return evolution.rule_support(_docs(spark, folder), table(spark, folder, "labels"), 5)


PERSONAL = r"(regexp_matches(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+[.][A-Za-z]{2,}') OR regexp_matches(text, '\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b'))"
RISK = f"risk AS (SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 1 AND {PERSONAL} THEN 4 WHEN coalesce(toxic, 0) = 1 THEN 3 WHEN {PERSONAL} OR coalesce(quality, 1) = 0 THEN 2 ELSE 1 END AS risk FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {RISK} SELECT doc_id, risk FROM risk")
def risk_levels(spark, folder):
    return safety.risk(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(f"WITH {RISK} SELECT doc_id, risk FROM risk WHERE risk >= 3 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def review_queue(spark, folder):
    return safety.review_queue(risk_levels(spark, folder), table(spark, folder, "labels").filter("quality = 0"))


@query("""WITH s AS (SELECT CAST(lang = 'en' AS INT) AS g, quality FROM labels JOIN documents USING (doc_id)), a AS (SELECT count(*) FILTER (WHERE g = 0) AS n_0, count(*) FILTER (WHERE g = 1) AS n_1, sum(quality) FILTER (WHERE g = 0) AS x_0, sum(quality) FILTER (WHERE g = 1) AS x_1 FROM s),
z AS (SELECT n_0, n_1, round((x_1 / n_1 - x_0 / n_0) / sqrt(((x_0 + x_1) / (n_0 + n_1)) * (1 - (x_0 + x_1) / (n_0 + n_1)) * (1 / n_0 + 1 / n_1)), 6) AS z FROM a) SELECT *, abs(z) > 1.959964 AS significant FROM z""")
def ztest(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.two_proportion_z(rows.withColumn("g", (F.col("lang") == "en").cast("int")), "g", "quality")


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS action, count(*) AS n, count(DISTINCT user_id) AS users, CAST(round(sum(CAST(value AS DECIMAL(18, 6))), 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def audit_hourly(spark, folder):
    return safety.audit_hourly(table(spark, folder, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM n GROUP BY user_id, k""")
def audit_sessions(spark, folder):
    return safety.audit_sessions(table(spark, folder, "events"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+[.][A-Za-z]{2,}')) + len(regexp_extract_all(text, '\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b')) AS n FROM documents")
def pii_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", safety.personal(F.col("text")).cast("long").alias("n"))


METRICS = f"""WITH {BM25}, {QRELS}, w AS (SELECT query_id, count(*) AS n_relevant FROM qrels GROUP BY 1),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN qrels USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1),
m AS (SELECT query_id, n_relevant, round(coalesce(hits, 0) / n_relevant, 6) AS recall, round(coalesce(hits, 0) / 10, 6) AS precision, CAST(coalesce(hits, 0) > 0 AS INT) AS hit, round(coalesce(1 / first, 0), 6) AS rr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(10, n_relevant) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM w LEFT JOIN h USING (query_id))"""


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.metrics(bm25_topk(spark, folder), _qrels(spark, folder), 10)


@query(f"{METRICS} SELECT query_id, n_relevant, recall, precision, hit FROM m")
def eval_recall_at_k(spark, folder):
    return _metrics(spark, folder).select("query_id", "n_relevant", "recall", "precision", "hit")


@query(f"{METRICS} SELECT query_id, rr FROM m")
def eval_mrr(spark, folder):
    return _metrics(spark, folder).select("query_id", "rr")


@query(f"{METRICS} SELECT query_id, ndcg FROM m")
def eval_ndcg(spark, folder):
    return _metrics(spark, folder).select("query_id", "ndcg")


@query(f"""{METRICS}, wt AS (SELECT query_id, doc_id, score * CAST(([1.5, 1.0, 0.5])[CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 + 1] AS DOUBLE) AS score FROM bm JOIN documents USING (doc_id)),
wr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM wt QUALIFY rank <= 10), rec AS (SELECT '1-plain' AS run_id, rr FROM m
  UNION ALL SELECT '2-weighted', round(coalesce(1 / first, 0), 6) FROM w LEFT JOIN (SELECT query_id, min(rank) AS first FROM wr JOIN qrels USING (query_id, doc_id) GROUP BY 1) USING (query_id)),
a AS (SELECT run_id, 'rr' AS metric, round(avg(rr), 6) AS value FROM rec GROUP BY 1) SELECT *, round(value - lag(value) OVER (ORDER BY run_id), 6) AS change FROM a""")
def eval_compare_runs(spark, folder):
    qrels, docs = _qrels(spark, folder), _docs(spark, folder)
    known = docs.select("doc_id", retrieval.collection_of(F.col("source")).alias("collection"))
    scored = kept(retrieval.contenders(_bm25(spark, folder, docs), known, 10))  # one search, of which both runs rank a few rows
    runs = [("1-plain", bm25_topk(spark, folder, scored)), ("2-weighted", collection_weighted(spark, folder, scored))]
    records = [evaluation.metrics(r, qrels, 10).select(F.lit(n).alias("run_id"), F.lit("rr").alias("metric"), F.col("rr").alias("value")) for n, r in runs]
    return evaluation.compare_runs(records[0].unionAll(records[1]))


@query(f"""{METRICS.replace("FROM benchmark)", "FROM sampled)").replace("FROM benchmark b", "FROM sampled b").replace("WITH ", "WITH sampled AS (SELECT item_id, text FROM benchmark ORDER BY md5(CAST(item_id AS VARCHAR)), item_id LIMIT 20), ", 1)}
SELECT 'first' AS run_id, query_id AS item_id, metric, value FROM (UNPIVOT (SELECT query_id, recall, CAST(precision AS DOUBLE) AS precision, CAST(hit AS DOUBLE) AS hit, rr, ndcg FROM m) ON recall, precision, hit, rr, ndcg INTO NAME metric VALUE value)""")
def eval_run(spark, folder):
    """From a test file to stored records: 20 samples of a JSON test set."""
    at = shared_folder(spark)
    table(spark, folder, "benchmark").write.json(f"{at}/test_set")
    files.append(evaluation.run(files.test_set(spark, f"{at}/test_set", lines=True), 20, table(spark, folder, "documents"), "first"), at, "table_eval_record")
    return spark.read.schema(files.schema("table_eval_record")).parquet(f"{at}/table_eval_record")


@query("SELECT item_id, text FROM benchmark ORDER BY md5(CAST(item_id AS VARCHAR)), item_id LIMIT 20")
def eval_sample(spark, folder):
    return evaluation.sample(table(spark, folder, "benchmark"), 20, "item_id")


@query(f"SELECT {COLL} AS collection, count(*) AS n, round(avg(n_chars), 4) AS avg_chars, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY 1")
def admin_stats(spark, folder):
    docs = table(spark, folder, "documents").withColumn("collection", retrieval.collection_of(F.col("source")))
    return docs.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.countDistinct(F.md5("text")).alias("texts"))


@query("SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def admin_page(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source", "lang").orderBy("doc_id").offset(40).limit(20)


FRAMES = f"""WITH {BM25}{WEIGHTED}, a AS (SELECT query_id, string_agg(rank || ':' || doc_id, ' ' ORDER BY rank) AS refs FROM top GROUP BY 1), b AS (SELECT item_id AS query_id, text, greatest(1, CAST(ceil(length(text) / 200.0) AS BIGINT)) AS n, refs FROM benchmark JOIN a ON query_id = item_id)
SELECT query_id, 0 AS seq, 'thinking' AS type, '' AS content FROM b UNION ALL SELECT query_id, 1, 'searching', '' FROM b
UNION ALL SELECT query_id, CAST(2 + i AS INT), 'chunk', substr(text, CAST(i * 200 + 1 AS BIGINT), 200) FROM (SELECT *, unnest(range(n)) AS i FROM b) UNION ALL SELECT query_id, CAST(2 + n AS INT), 'done', refs FROM b"""


@query(FRAMES)
def answer_frames(spark, folder):
    cited = evidence_bundle(spark, folder)
    answers = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer")).join(cited, "query_id")
    return incremental.frames(answers)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    return incremental.windowed(table(spark, folder, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(FRAMES)
def answer_frames_stream(spark, folder):
    """The frames of questions as they arrive: each batch of a stream is answered by the batch plan."""
    asked, at = table(spark, folder, "benchmark"), shared_folder(spark)

    def made(batch: DataFrame) -> DataFrame:
        found = retrieval.bm25(_index(spark, folder), retrieval.query_terms(batch, "item_id"))
        docs = table(spark, folder, "documents").withColumn("collection", retrieval.collection_of(F.col("source")))
        cited = agent.bundle(retrieval.top_k(retrieval.weight_collections(found, docs), 10)).select("query_id", agent.reference_text().alias("references"))
        return incremental.frames(batch.select(F.col("item_id").alias("query_id"), F.col("text").alias("answer")).join(cited, "query_id"))

    incremental.each_batch(incremental.landed(spark, f"{folder}/benchmark.parquet*", asked.schema), made, f"{at}/target", f"{at}/progress")
    return spark.read.parquet(f"{at}/target").select("query_id", "seq", "type", "content")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.landed(spark, f"{folder}/events.parquet*", table(spark, folder, "events").schema)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_once(spark, folder):
    """Events that are delivered twice, each kept once within the watermark."""
    at, both = shared_folder(spark), _events(spark, folder).unionByName(_events(spark, folder))
    incremental.run(incremental.once(both).select("event_id", "user_id", "event_type"), f"{at}/target", f"{at}/progress")
    return spark.read.parquet(f"{at}/target")


@query("""WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events)
SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_windows(spark, folder):
    return incremental.sliding(table(spark, folder, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), d AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM n GROUP BY user_id, k)
SELECT * FROM d WHERE ended + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark, folder):
    """Sessions of a stream that its watermark has closed."""
    at = shared_folder(spark)
    incremental.run(incremental.sessions(_events(spark, folder)), f"{at}/target", f"{at}/progress")
    plain = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")]
    return spark.read.parquet(f"{at}/target").select("user_id", *plain, "n")


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, event_type, island, count(*) AS n FROM o GROUP BY 1, 2, 3) SELECT user_id, CAST(sum(n) AS BIGINT) AS seen, max(n) AS longest FROM r GROUP BY 1""")
def stream_runs(spark, folder):
    """State for each user: the longest run of one type of event; what the last batch said of each."""
    at = shared_folder(spark)
    stream = incremental.longest_runs(_events(spark, folder))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/target/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/target").groupBy("user_id").agg(F.max("seen").alias("seen"), F.max("longest").alias("longest"))


@query("SELECT doc_id, source, n_chars FROM documents")
def stream_incremental(spark, folder):
    """Documents as they land, each id once, through two runs of the same stream."""
    docs, at = table(spark, folder, "documents"), shared_folder(spark)
    stream = incremental.landed(spark, f"{folder}/documents.parquet*", docs.schema)
    for _ in range(2):
        incremental.load_new(stream.select("doc_id", "source", "n_chars"), f"{at}/target", f"{at}/progress", "doc_id")
    return spark.read.parquet(f"{at}/target")
