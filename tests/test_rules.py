import math
import os
import re
from itertools import combinations

import pytest

from lodestone.operators import rules

FOLDER = "/root/testdata/sf0.001"


def brute_force(docs, labels, least, most):
    """{items: (support, good)} of docs (id, text) and labels {id: quality}."""
    held = [(set(re.findall(r"[^\W_]+", (text or "").lower())), labels[i]) for i, text in docs if i in labels]
    frequent = sorted(t for t in set().union(*(s for s, _ in held)) if sum(t in s for s, _ in held) >= least)
    found, level = {}, [(t,) for t in frequent]
    for size in range(1, most + 1):
        kept = []
        for items in level:
            goods = [q for s, q in held if s.issuperset(items)]
            if len(goods) >= least:
                found[items] = (len(goods), sum(q == 1 for q in goods))
                kept.append(items)
        level = [(*a, b[-1]) for a, b in combinations(sorted(kept), 2) if a[:-1] == b[:-1]]
    return found


def same(got, want):
    got = {tuple(r["items"]): r for r in got.collect()}
    assert got.keys() == want.keys()
    for items, (n, good) in want.items():
        r = got[items]
        closed = not any(len(o) == len(items) + 1 and set(items) < set(o) and m == n for o, (m, _) in want.items())
        assert (r.support, r.success, r.weight, r.closed) == (n, round(good / n, 6), round(math.log((good + 1) / (n - good + 1)), 6), closed), items


@pytest.mark.parametrize(("least", "most", "settings"), [(1, 4, {}), (2, 3, {"block_docs": 2}), (9, 2, {})])
def test_small_tables(spark, least, most, settings):
    docs = [(1, "a b c"), (2, "a b"), (3, "B a a d"), (4, None), (5, ""), (6, "c d"), (7, "a b c d"), (8, "a x")]
    labels = {1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: None}
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    same(rules.mine(rows, marks, least, most, **settings), brute_force(docs, labels, least, most))


def test_documents_equal_brute_force(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    n = labels.count()
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r.quality for r in labels.collect()}, n // 2, 3)
    assert len(want) > 20 and max(map(len, want)) == 3
    same(rules.mine(docs, labels, n // 2, 3, block_docs=20), want)


def test_too_many_documents_in_a_block(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'a' AS text")
    with pytest.raises(Exception, match="bitmap"):
        rules.mine(docs, docs.selectExpr("doc_id", "1 AS quality"), 1, 1, block_docs=10**6).count()


def test_outcomes_move_weights(spark):
    given = spark.createDataFrame([(["a"], 0.0), (["a", "b"], 2.0), (["z"], 1.0)], "items array<string>, weight double")
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "b"), (4, "a z")], "doc_id long, text string")
    outcomes = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, outcome int")
    got = {tuple(r["items"]): r.weight for r in rules.reinforced(given, docs, outcomes, 0.5).collect()}
    sure = 1 / (1 + math.exp(-2.0))
    assert got == {("a",): 0.0, ("a", "b"): round(2 - 0.5 * sure, 6), ("z",): 1.0}
