import gzip
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.sources import literature

XML = """<?xml version="1.0" encoding="UTF-8"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>On <i>salt</i> &amp; pressure</ArticleTitle><Abstract><AbstractText Label="AIM">Why.</AbstractText><AbstractText>How.</AbstractText></Abstract>
<AuthorList><Author><LastName>Li</LastName><ForeName>An</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2018 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""
JSON = '{"resultList": {"result": [{"id": "E1", "title": "高血压", "authorString": "Wu B, Xu C", "pubYear": "2020", "abstractText": "text"}, {"id": "E2"}]}}'


@pytest.fixture(autouse=True)
def registered(spark):
    literature.register(spark)


def land(folder, name, text):
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())


def plain(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


ROWS = [
    ("11", "pubmed", "On salt & pressure", "Li An, The Group", 2019, "Why.\nHow."),
    ("12", "pubmed", None, None, 2018, None),
    ("E1", "europepmc", "高血压", "Wu B, Xu C", 2020, "text"),
    ("E2", "europepmc", None, None, None, None),
]


def test_both_kinds_of_dumps(spark, tmp_path):
    land(tmp_path, "pubmed/2019/a.xml.gz", XML)
    land(tmp_path, "europepmc/2020/b.json", JSON)
    land(tmp_path, "europepmc/2020/_half.json", "{")
    land(tmp_path, "notes.txt", "no dump")
    assert plain(spark.read.format("literature").load(str(tmp_path))) == ROWS
    assert spark.read.format("literature").load(str(tmp_path / "nothing")).count() == 0
    assert plain(spark.read.format("literature").load(f"file://{tmp_path}").filter("year = 2019")) == ROWS[:1]


def test_filters_open_fewer_files(spark, tmp_path):
    for year in range(2001, 2009):
        land(tmp_path, f"europepmc/{year}/p.json", JSON.replace("2020", str(year)).replace("E1", f"E{year}"))
    land(tmp_path, "pubmed/2003/q.xml", "broken, so a task that opens it fails")
    rows = spark.read.format("literature").load(str(tmp_path))
    with pytest.raises(Exception, match="ParseError|not well-formed|syntax"):
        rows.count()
    assert [r.id for r in rows.filter("year >= 2007").orderBy("id").collect()] == ["E2007", "E2008"]
    assert [r.id for r in rows.filter("year in (2002, 2004)").orderBy("id").collect()] == ["E2002", "E2004"]
    assert rows.filter("source = 'europepmc' and year < 2004").count() == 3
    reader = literature.Reader(str(tmp_path), 1)
    assert len(reader.partitions()) == 9
    assert list(reader.pushFilters([literature.GreaterThanOrEqual(("year",), 2007)])) and len(reader.partitions()) == 2


def test_files_share_tasks_by_size():
    files = [literature.Dump(i, f"f{i}", s) for i, s in enumerate([5, 5, 5, 100, 1, 1])]
    assert [p.paths for p in literature.parts(files, 10)] == [["f0", "f1"], ["f2"], ["f3"], ["f4", "f5"]]


def test_stream_takes_each_file_once_and_equals_a_batch(spark, tmp_path):
    dumps, out, progress = tmp_path / "dumps", str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream = spark.readStream.format("literature").load(str(dumps))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        return plain(spark.read.schema(literature.SCHEMA).parquet(out))

    land(dumps, "pubmed/2019/a.xml", XML)
    assert run() == ROWS[:2]
    land(dumps, "europepmc/2020/b.json", JSON)
    assert run() == ROWS
    assert run() == ROWS == plain(spark.read.format("literature").load(str(dumps)))
    shutil.copy(dumps / "pubmed/2019/a.xml", dumps / "pubmed/2019/c.xml")
    assert len(run()) == 6


def test_what_is_written_is_read(spark, tmp_path):
    given = spark.createDataFrame([*ROWS, ("13", "pubmed", "a\x01b <c>", "", None, "&")], literature.SCHEMA)
    given.repartition(3).write.format("literature").option("page", 1).mode("append").save(str(tmp_path))
    want = [*ROWS, ("13", "pubmed", "a�b <c>", None, None, "&")]
    assert plain(spark.read.format("literature").load(str(tmp_path))) == sorted(want, key=repr)
    bad = given.withColumn("source", F.when(F.col("id") == "11", "elsewhere").otherwise(F.col("source"))).repartition(3, "id")
    with pytest.raises(Exception, match="elsewhere"):
        bad.write.format("literature").mode("append").save(str(tmp_path))
    assert spark.read.format("literature").load(str(tmp_path)).count() == 5
    assert sorted(os.listdir(tmp_path)) == ["_staged", "europepmc", "pubmed"]
