"""A search index that lasts: segments of a block-max index, tombstones, and a manifest that is swapped at once.

    store/manifests/000000000007.json     what version 7 is made of
    store/postings/segment=<name>/        term, block, docs, peaks
    store/terms/segment=<name>/           term, df, n_blocks
    store/docs/segment=<name>/            id, dl, terms: what a deletion has to take away from the figures
    store/dead/batch=<name>/segment=<s>/  id of documents of a segment that are deleted
    store/dead_terms/batch=<name>/segment=<s>/  term, n: in how many of them a term occurs

Every change writes new folders and then one new manifest, whose number must not be taken: a change that fails leaves the
last version as it was, and of two changes to one version the second raises Conflict. Readers take the latest manifest
that is whole. Segments are merged in tiers, so that there are about `fan` of each order of magnitude; a merge leaves
out dead documents. Searches go by the figures of all live documents, so they equal those of an index built anew.
"""

from __future__ import annotations

import json
import math
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import listed
from lodestone.operators.blockmax import Blocks, blocked
from lodestone.operators.retrieval import build_index


class Conflict(RuntimeError):
    """Another change was made to the version this one began with."""


class Segment(NamedTuple):
    name: str
    docs: int
    length: int  # terms of all its documents


class Dead(NamedTuple):
    batch: str
    segment: str
    docs: int
    length: int


class Manifest(NamedTuple):
    version: int
    segments: tuple[Segment, ...]
    dead: tuple[Dead, ...]

    def live(self, segment: str) -> int:
        """Documents of a segment that are not deleted."""
        gone = sum(d.docs for d in self.dead if d.segment == segment)
        return next(s.docs for s in self.segments if s.name == segment) - gone


class Store:
    """The store in a folder that the driver and all executors share. Ids are distinct within a batch; one that the store
    has already replaces the document of that id."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long", size: int = 128):
        self.spark, self.folder, self.id_type, self.size = spark, folder, id_type, size

    # manifests

    def _file(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, system = self._file("manifests")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in system.listStatus(at)) if system.exists(at) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest version, or an earlier one."""
        for v in [version] if version is not None else self.versions()[::-1]:
            at, system = self._file(f"manifests/{v:012d}.json")
            stream = system.open(at)
            try:
                found = json.loads(bytes(stream.readAllBytes()))
            except ValueError:  # its writer died while writing it
                continue
            finally:
                stream.close()
            return Manifest(v, tuple(Segment(*s) for s in found["segments"]), tuple(Dead(*d) for d in found["dead"]))
        if version is not None:
            raise ValueError(f"no version {version}")
        return Manifest(0, (), ())

    def _swap(self, base: Manifest, segments: list[Segment], dead: list[Dead]) -> Manifest:
        version = max([base.version, *(v for v in self.versions() if v > base.version and not self._whole(v))]) + 1
        at, system = self._file(f"manifests/{version:012d}.json")
        if self.manifest().version != base.version or system.exists(at):
            raise Conflict(f"version {base.version} is not the latest any more")
        try:
            stream = system.create(at, False)
        except Exception as error:
            if "AlreadyExists" in str(error):
                raise Conflict(f"version {version} is taken") from error
            raise
        stream.write(bytearray(json.dumps({"segments": segments, "dead": dead}).encode()))
        stream.close()
        return Manifest(version, tuple(segments), tuple(dead))

    def _whole(self, version: int) -> bool:
        try:
            self.manifest(version)
        except ValueError:
            return False
        return True

    # tables

    def _read(self, table: str, schema: str, paths: list[str], partitions: str) -> DataFrame:
        base = f"{self.folder}/{table}"
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, {partitions}")
        return self.spark.read.schema(f"{schema}, {partitions}").option("basePath", base).parquet(*(f"{base}/{p}" for p in paths))

    def _segments(self, table: str, names: list[str]) -> DataFrame:
        docs = f"array<struct<id: {self.id_type}, tf: int, dl: int>>"
        schema = {"postings": f"term string, block int, docs {docs}, peaks array<struct<tf: int, dl: int>>", "terms": "term string, df long, n_blocks int", "docs": f"id {self.id_type}, dl int, terms array<string>"}[table]
        return self._read(table, schema, [f"segment={n}" for n in names], "segment string")

    def _dead(self, table: str, dead: tuple[Dead, ...]) -> DataFrame:
        schema = {"dead": f"id {self.id_type}", "dead_terms": "term string, n long"}[table]
        return self._read(table, schema, [f"batch={d.batch}/segment={d.segment}" for d in dead], "batch string, segment string").drop("batch")

    def documents(self, manifest: Manifest | None = None) -> DataFrame:
        """segment, id, dl, terms of the live documents."""
        m = manifest or self.manifest()
        rows = self._segments("docs", [s.name for s in m.segments])
        return rows.join(self._dead("dead", m.dead), ["segment", "id"], "left_anti") if m.dead else rows

    def index(self, manifest: Manifest | None = None) -> Blocks:
        """The live documents as an index to search."""
        m = manifest or self.manifest()
        names = [s.name for s in m.segments]
        terms = self._segments("terms", names)
        counts = terms.select("term", F.col("df").alias("n"))
        if m.dead:
            counts = counts.unionAll(self._dead("dead_terms", m.dead).select("term", -F.col("n")))
        df = counts.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
        docs = sum(s.docs for s in m.segments) - sum(d.docs for d in m.dead)
        length = sum(s.length for s in m.segments) - sum(d.length for d in m.dead)
        return Blocks(self._segments("postings", names), terms.select("segment", "term", "n_blocks"), df, self._dead("dead", m.dead) if m.dead else None, docs, length / docs if docs else 0.0)

    # changes

    def _write_segment(self, tf: DataFrame, docs: DataFrame) -> Segment:
        """A segment of tf (id, term, tf, dl) and docs (id, dl, terms)."""
        name = uuid.uuid4().hex
        path = lambda table: f"{self.folder}/{table}/segment={name}"
        postings, terms = blocked(tf, self.size)
        docs.select("id", F.col("dl").cast("int").alias("dl"), "terms").write.parquet(path("docs"))
        terms.sortWithinPartitions("term").write.parquet(path("terms"))
        postings.sortWithinPartitions("term", "block").write.parquet(path("postings"))
        figures = self._segments("docs", [name]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.countDistinct("id").alias("ids")).first()
        if figures["ids"] != figures["n"]:
            raise ValueError("ids have to be given, and distinct within a batch")
        return Segment(name, figures["n"], figures["length"])

    def _bury(self, base: Manifest, ids: DataFrame) -> list[Dead]:
        """Tombstones for the live documents with these ids."""
        if not base.segments:
            return []
        batch = uuid.uuid4().hex
        gone = self.documents(base).join(ids.select(F.col(ids.columns[0]).cast(self.id_type).alias("id")).distinct(), "id", "left_semi")
        gone.select("id", "segment").write.partitionBy("segment").parquet(f"{self.folder}/dead/batch={batch}")
        rows = gone.select("segment", "id", "dl", "terms")
        counts = listed(rows, F.col("terms"), "term", "segment").groupBy("segment", "term").agg(F.count(F.lit(1)).alias("n"))
        counts.write.partitionBy("segment").parquet(f"{self.folder}/dead_terms/batch={batch}")
        figures = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")).collect()  # a row a segment
        for f in figures:  # a document without terms has no counts
            at, system = self._file(f"dead_terms/batch={batch}/segment={f['segment']}")
            system.mkdirs(at)
        return [Dead(batch, f["segment"], f["n"], f["length"]) for f in figures]

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Manifest:
        """A new segment of docs, in place of the documents of the same ids."""
        base = self.manifest()
        index = build_index(docs, doc_id, text)
        known = docs.select(F.col(doc_id).cast(self.id_type).alias("id"))
        rows = index.rows.select(F.col("id").cast(self.id_type).alias("id"), "dl", F.array_distinct("terms").alias("terms"))  # within a row: no posting moves
        segment = self._write_segment(index.tf, rows)
        dead = self._bury(base, known)
        return self._swap(base, [*base.segments, segment], [*base.dead, *dead])

    def delete(self, ids: DataFrame) -> Manifest:
        """Without the documents whose ids the first column of `ids` has; unknown ids don't matter."""
        base = self.manifest()
        return self._swap(base, list(base.segments), [*base.dead, *self._bury(base, ids)])

    def merge(self, fan: int = 4, least: int = 1000) -> Manifest:
        """One merge, if it is due: of the smallest tier that has `fan` segments, all of them. Tier 0 has up to `least`
        live documents, each further one `fan` times as many."""
        base = self.manifest()
        tiers: dict[int, list[Segment]] = {}
        for s in base.segments:
            tiers.setdefault(max(0, math.ceil(math.log(max(1, base.live(s.name)) / least, fan))), []).append(s)
        due = min((t for t, ss in tiers.items() if len(ss) >= fan), default=None)
        return base if due is None else self._merged(base, tiers[due])

    def merge_all(self) -> Manifest:
        """All live documents in one segment."""
        base = self.manifest()
        return self._merged(base, list(base.segments))

    def _merged(self, base: Manifest, old: list[Segment]) -> Manifest:
        names = [s.name for s in old]
        part = Manifest(base.version, tuple(old), tuple(d for d in base.dead if d.segment in names))
        rows = self._segments("postings", names).select("segment", "term", F.explode("docs").alias("d")).select("segment", "d.id", "term", "d.tf", "d.dl")
        if part.dead:
            rows = rows.join(self._dead("dead", part.dead), ["segment", "id"], "left_anti")
        new = self._write_segment(rows.drop("segment"), self.documents(part).drop("segment"))
        return self._swap(base, [s for s in base.segments if s.name not in names] + [new], [d for d in base.dead if d.segment not in names])

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last `keep` versions, and the folders that these don't use. Not while a change is made."""
        versions = [v for v in self.versions() if self._whole(v)]
        last = [self.manifest(v) for v in versions[-keep:]]
        for v in set(self.versions()) - {m.version for m in last}:
            at, system = self._file(f"manifests/{v:012d}.json")
            system.delete(at, False)
        used = {f"segment={s.name}" for m in last for s in m.segments} | {f"batch={d.batch}" for m in last for d in m.dead}
        for table in ("postings", "terms", "docs", "dead", "dead_terms"):
            at, system = self._file(table)
            for folder in system.listStatus(at) if system.exists(at) else []:
                if folder.getPath().getName() not in used:
                    system.delete(folder.getPath(), True)
