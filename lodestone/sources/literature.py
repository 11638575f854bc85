"""Saved literature dumps as a data source: PubMed XML and Europe PMC JSON pages, in batches and as a stream.

    <path>/pubmed/<year>/<name>.xml[.gz]       PubmedArticleSet documents
    <path>/europepmc/<year>/<name>.json[.gz]   search results, {"resultList": {"result": [...]}}

Rows are id, source, title, authors, year, abstract. A filter on year or source passes over the files of other folders
without opening them; Spark still applies it to the rows, so an article that was saved under another year is not lost by
a filter that its folder meets, and never shown by one that it does not meet itself. Files outside this layout are always
read. Articles are parsed one by one: a task holds one article of an XML dump, or one page of results.

    register(spark)
    spark.read.format("literature").load(path)
    spark.readStream.format("literature").load(path)
    articles.write.format("literature").mode("append").save(path)

A stream takes files in the order of their times of change and names, so dumps have to be moved to the folder whole, with
the time of the move. The writer puts its files there when all tasks are done, and removes them if one fails.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import sys
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "id string, source string, title string, authors string, year int, abstract string"
LAYOUT = re.compile(r"(?:^|/)(pubmed|europepmc)/([0-9]{1,4})/[^/]+$")
#: What XML 1.0 can't hold.
UNFIT = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass(frozen=True, order=True)
class Dump:
    """A file; in the order in which a stream takes them."""

    changed: int  # nanoseconds
    path: str
    size: int


@dataclass
class Part(InputPartition):
    paths: list[str]


def dumps(path: str) -> list[Dump]:
    """The dumps below a folder; names that begin with a dot or underscore are not theirs yet."""
    system, root = _opened(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    hidden = lambda p: any(part[0] in "._" for part in p[len(root) :].split("/") if part)
    return sorted(Dump(f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and re.search(r"\.(xml|json)(\.gz)?$", f.path) and not hidden(f.path))


def parts(files: Iterable[Dump], size: int) -> list[Part]:
    """Files by turns, about `size` bytes a task."""
    out: list[Part] = []
    room = 0
    for f in files:
        if room < f.size or not out:
            out.append(Part([]))
            room = size
        out[-1].paths.append(f.path)
        room -= f.size
    return out


def _text(article: ET.Element, path: str) -> str | None:
    found = article.find(path)
    return None if found is None else "".join(found.itertext())


def _number(text: str | None) -> int | None:
    found = re.search("[0-9]{4}", text or "")
    return int(found[0]) if found else None


def _pubmed(stream) -> Iterator[tuple]:
    for _, article in ET.iterparse(stream):
        if article.tag != "PubmedArticle":
            continue
        names = [" ".join(filter(None, (a.findtext("LastName"), a.findtext("ForeName")))) or a.findtext("CollectiveName") or "" for a in article.iter("Author")]
        date = _text(article, ".//JournalIssue/PubDate/Year") or _text(article, ".//JournalIssue/PubDate/MedlineDate")
        parts = ["".join(a.itertext()) for a in article.iter("AbstractText")]
        yield _text(article, ".//PMID"), "pubmed", _text(article, ".//ArticleTitle"), ", ".join(n for n in names if n) or None, _number(date), "\n".join(parts) if parts else None
        article.clear()


def _europepmc(stream) -> Iterator[tuple]:
    for r in json.load(stream).get("resultList", {}).get("result", []):
        yield r.get("id"), "europepmc", r.get("title"), r.get("authorString"), _number(str(r.get("pubYear") or "")), r.get("abstractText")


def _articles(root: str, paths: list[str]) -> Iterator[tuple]:
    system, _ = _opened(root)
    for path in paths:
        with system.open_input_stream(path, compression=None) as raw, gzip.open(raw) if path.endswith(".gz") else raw as stream:
            yield from (_pubmed if ".xml" in path else _europepmc)(stream)


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.filters = path, size, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.filters = [f for f in filters if getattr(f, "attribute", None) in (("year",), ("source",))]
        return filters  # Spark applies all of them to the rows

    def wanted(self, path: str) -> bool:
        """Whether the folder of a file meets the filters."""
        found = LAYOUT.search(path)
        if not found:
            return True
        of = {"source": found[1], "year": int(found[2])}
        return all(_meets(of[f.attribute[0]], f) for f in self.filters)

    def partitions(self) -> list[Part]:
        return parts((f for f in dumps(self.path) if self.wanted(f.path)), self.size) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _articles(self.path, partition.paths)


def _meets(value: Any, f: Filter) -> bool:
    match f:
        case EqualTo() | EqualNullSafe():
            return value == f.value
        case In():
            return value in f.value
        case GreaterThan():
            return value > f.value
        case GreaterThanOrEqual():
            return value >= f.value
        case LessThan():
            return value < f.value
        case LessThanOrEqual():
            return value <= f.value
    return True


class StreamReader(DataSourceStreamReader):
    """Offsets are the time of change and the name of the last file."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = dumps(self.path)
        return {"changed": found[-1].changed, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = ((o["changed"], o["path"]) for o in (start, end))
        return parts((f for f in dumps(self.path) if low < (f.changed, f.path) <= high), self.size)

    def read(self, partition: Part) -> Iterator[tuple]:
        return _articles(self.path, partition.paths)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it is, and where it belongs


def _page(rows: list) -> bytes:
    results = [{"id": r.id, "title": r.title, "authorString": r.authors, "pubYear": None if r.year is None else str(r.year), "abstractText": r.abstract} for r in rows]
    return json.dumps({"resultList": {"result": results}}).encode()


def _set(rows: list) -> bytes:
    root = ET.Element("PubmedArticleSet")
    for r in rows:
        citation = ET.SubElement(ET.SubElement(root, "PubmedArticle"), "MedlineCitation")
        article = ET.Element("Article")
        add = lambda parent, name, text: text is not None and setattr(ET.SubElement(parent, name), "text", UNFIT.sub("�", str(text)))
        add(citation, "PMID", r.id)
        citation.append(article)
        date = ET.SubElement(ET.SubElement(ET.SubElement(article, "Journal"), "JournalIssue"), "PubDate")
        add(date, "Year", r.year)
        add(article, "ArticleTitle", r.title)
        if r.abstract is not None:
            add(ET.SubElement(article, "Abstract"), "AbstractText", r.abstract)
        if r.authors:
            people = ET.SubElement(article, "AuthorList")
            for name in r.authors.split(", "):
                add(ET.SubElement(people, "Author"), "LastName", name)
    return ET.tostring(root, "utf-8", xml_declaration=True)


class Writer(DataSourceWriter):
    """Files of up to `most` articles of one source and year. Rows of other sources raise."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def write(self, iterator: Iterator) -> Written:
        system, root = _opened(self.path)
        staged, held, files = f"{root}/_staged", {}, []
        system.create_dir(staged, recursive=True)

        def put(source: str, year: int | None, rows: list) -> None:
            kind, made = {"pubmed": ("xml", _set), "europepmc": ("json", _page)}[source]
            name = f"{uuid.uuid4().hex}.{kind}"
            with system.open_output_stream(f"{staged}/{name}") as f:
                f.write(made(rows))
            files.append((f"{staged}/{name}", f"{root}/{source}/{'unknown' if year is None else year}/{name}"))

        for row in iterator:
            key = row.source, row.year
            held.setdefault(key, []).append(row)
            if len(held[key]) == self.most:
                put(*key, held.pop(key))
        for key, rows in held.items():
            put(*key, rows)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.path)
        for staged, place in sorted(f for m in messages if m for f in m.files):
            system.create_dir(os.path.dirname(place), recursive=True)
            system.move(staged, place)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.path)
        for staged, _ in (f for m in messages if m for f in m.files):
            system.delete_file(staged)


class Literature(DataSource):
    """Options: path, partition_bytes (64 MB a task), page (1,000 articles a file that is written)."""

    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("partition_bytes", 64 << 20))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self._size())

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], self._size())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("dumps are only added")
        return Writer(self.options["path"], int(self.options.get("page", 1000)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down. The processes that plan a source have none of
    the driver's import path, so this module is sent to them by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Literature)
