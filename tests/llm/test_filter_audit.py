import glob
import os
import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, registry
from tests.llm.tables import documents

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute_force(docs, labels):
    """The rows of the audit, filter by filter, of docs (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    fails, marks = [], []
    for doc_id, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        e = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
        fails.append({"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": e})
        own = [(q, t) for d, q, t in labels if d is not None and d == doc_id]
        marks.append((any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out, total = [], {}
    for part in {s or "" for _, _, s in docs}:
        rows = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                failing = [i for i in rows if fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                unique = sum(1 for i in failing if sum(fails[i].values()) == 1)
                out.append([part, order, step, len(left), len(gone), len(failing) - len(gone), unique, sum(marks[i][0] for i in gone), sum(marks[i][1] for i in gone), f])
    return sorted((*r[:9], total[r[0], r[9]]) for r in out)


def plain(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_query_equals_its_twin_and_brute_force(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = plain(registry.op11_filter_audit(spark, SF))
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({registry.oracle_sql()['op11_filter_audit']})").fetchall())
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert got == brute_force(docs, marks)


def test_nulls_repeats_and_hot_texts(spark):
    base = documents(spark).select("doc_id", "text", "source")
    more = spark.createDataFrame([(i % 3 or None, "SAME Words #1", "hot") for i in range(400)] + [(20 + i, "SAME Words #1", None) for i in range(300)] + [(50, "a a a " * 40, "b"), (51, "x" * 100_000, "b")], "doc_id long, text string, source string")
    rows = base.unionByName(more).withColumns({"n": F.lit("clash"), "mask": F.lit(1), "word": F.lit("x"), "d1": F.lit(0)})
    marks = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (20, 0, 1), (None, 1, 1), (99, 1, 1)]
    want = brute_force([(r.doc_id, r.text, r.source) for r in rows.collect()], marks)
    assert plain(filter_audit.audit(rows.repartition(5), labels(spark, marks))) == want


def test_empty_tables(spark):
    assert plain(filter_audit.audit(documents(spark, empty=True), labels(spark, []))) == []
    got = filter_audit.audit(documents(spark).limit(3), labels(spark, [])).filter("good_lost + toxic_lost > 0")
    assert got.count() == 0


@pytest.mark.parametrize("tasks", [1, 6])
def test_words_of_copies_are_counted_once(spark, tasks):
    text = F.concat_ws(" ", F.lit("to be or not to be"), (F.col("id") % 3).cast("string"))
    texts = spark.range(50).repartition(tasks).select((F.col("id") % 3).alias("d1"), F.lit(0).cast("long").alias("d2"), text.alias("text"))
    assert sorted(tuple(r) for r in filter_audit.word_counts(texts).select("d1", "n_words", "n_distinct").collect()) == [(0, 7, 5), (1, 7, 5), (2, 7, 5)]
