import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import registry, resampling
from tests.llm.tables import documents

SF = "/root/testdata/sf0.001"


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(docs, target, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank) of each row of docs (id, text), by the definition."""
    n = 10_000
    bucket = lambda f: zlib.crc32(f.encode()) % n
    s, t = [0] * n, [0] * n
    held = []
    for _, text in docs:
        n_words, found = plain_features(text)
        held.append((n_words, [bucket(f) for f in found]))
        for b in held[-1][1]:
            s[b] += 1
    for text in target:
        for f in plain_features(text)[1]:
            t[bucket(f)] += 1
    s_all, t_all = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + n) / ((s[b] + 1) * (t_all + n)))) for b in range(n)]
    rows = []
    for (doc_id, _), (n_words, buckets) in zip(docs, held):
        weight = math.floor(sum(gain[b] for b in buckets) / len(buckets)) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((n_words >= least, doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    ranked = {id(r): i for i, r in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted(((*r[1:], ranked.get(id(r))) for r in rows), key=repr)


def plain(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = registry.op12_importance_resampling(spark, SF)
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint>"
    assert plain(got) == brute_force(docs, target)


def test_nulls_repeats_and_empty_tables(spark):
    rows = documents(spark).withColumns({"part": F.lit("clash"), "score": F.lit("clash"), "rank": F.lit(0)})
    target = spark.createDataFrame([("alpha1 Bravo2",), (None,), ("",)], "text string")
    found = [(r.doc_id, r.text) for r in rows.collect()]
    assert plain(resampling.resampled(rows, target, percent=60)) == brute_force(found, ["alpha1 Bravo2"], 60)
    assert resampling.resampled(documents(spark, empty=True), target).count() == 0
    assert plain(resampling.resampled(rows, target.limit(0), percent=100)) == brute_force(found, [], 100)
    assert {r.rank for r in resampling.resampled(rows, target, percent=0).collect()} == {None}


def test_blocks_of_a_long_text_make_no_difference():
    text = " ".join(f"Ab{i}-é{i % 7}" for i in range(3000))
    for size in (1, 10, 1000, 1 << 20):
        for longest in (1, 2, 3):
            words = 0
            for old, block in resampling.word_blocks(text, longest - 1, size):
                words += len(block) - old
            assert words == 6000
    whole = np.sort(np.concatenate([f for _, f in resampling.features(text, 3)]))
    words = re.findall("[a-z0-9é]+", text.lower())
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    assert whole.tolist() == sorted(zlib.crc32(r.encode()) for r in runs)


def test_features_across_blocks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    blocks = resampling.word_blocks
    want = sorted(x for _, f in resampling.features(text, 3) for x in f.tolist())
    monkeypatch.setattr(resampling, "word_blocks", lambda t, carried: blocks(t, carried, 7))
    assert sorted(x for _, f in resampling.features(text, 3) for x in f.tolist()) == want


@pytest.mark.parametrize("seed", range(4))
def test_merge_of_runs(seed):
    r = random.Random(seed)
    rows = [{"doc_id": r.choice([None, *range(40)]), "n_features": 1, "weight": 0, "score": r.randrange(8)} for _ in range(500)]
    pieces = []
    for _ in range(r.randrange(1, 30)):
        run = sorted(r.sample(rows, r.randrange(1, 60)), key=lambda d: resampling._keys([d]))
        cut = r.randrange(len(run) + 1)
        pieces += [p for p in (run[:cut], run[cut:]) if p]
    pieces.sort(key=lambda p: resampling._keys(p[:1])[0][:3])
    every = sorted(k for p in pieces for k in resampling._keys(p))
    for wanted in (0, 1, len(every) // 2, len(every), len(every) + 5):
        got = list(resampling.merged(iter(pieces), wanted))
        first = [d for d, place in got if place is not None]
        assert resampling._keys(first) == every[:wanted] and [p for _, p in got if p is not None] == list(range(min(wanted, len(every))))
        assert sorted(resampling._keys([d for d, _ in got])) == every


@pytest.mark.parametrize(("parts", "settings"), [(1, {}), (7, {"least_range": 10, "block": 3, "run_rows": 40}), (4, {"range_rows": 25, "least_range": 1, "block": 1})])
def test_draw_is_the_same_however_it_is_cut(spark, parts, settings):
    rows = spark.range(600).select(F.when(F.col("id") % 50 != 0, F.col("id") % 400).alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.col("id") % 9).alias("score"), (F.col("id") % 6 != 0).alias("eligible"))
    able = sorted(((-r.score, r.doc_id is None, r.doc_id or 0) for r in rows.filter("eligible").collect()))
    got = resampling.drawn(rows.repartition(parts), 30, **settings).collect()
    assert len(got) == 600
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, 30 * len(able) // 100 + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == able[: len(ranked)]
