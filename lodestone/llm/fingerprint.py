"""Document fingerprints: a canonical exact digest.

A text's canonical form is its NFKC form with case folded and every run of white space one space, none at the ends.
Its fingerprint is the 128-bit xxh3 digest of the canonical UTF-8 bytes in hex. Documents of equal digest are then
grouped by the canonical bytes themselves: should two canonical texts ever share a digest, all but the first in
byte order get a suffix, so equal fingerprints mean equal canonical texts.

A null text counts as empty; empty texts share a fingerprint. Ids may repeat or be null: every row is kept and has
its own result. An empty table gives an empty one, and other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tasks import bounded_batches, checkpointed, per_row, stored


def canonical(text: str | None) -> str:
    """The form that is digested."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(form: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def _digests():
    return lambda *texts: tuple(digest(canonical(t)) for t in texts)


def fingerprints(docs: DataFrame, kept: list[str], texts: dict[str, str]) -> DataFrame:
    """The columns `kept`, and for each item of `texts` the fingerprint of that text column under the given name."""
    return per_row(docs, kept, list(texts.values()), ", ".join(f"`{name}` string" for name in texts), _digests)


def _slot(fingerprint: str, bits: int) -> int:
    return int(fingerprint[:15], 16) & (bits - 1)


def _suspects(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [canonical(t) for t in batch.column(0).to_pylist()]
        found = [(f, d) for f, d in ((f, digest(f)) for f in forms) if bitmap[(s := _slot(d, bits)) >> 3] >> (s & 7) & 1]
        yield pa.RecordBatch.from_arrays([pa.array([d for _, d in found], pa.string()), pa.array([f for f, _ in found], pa.string())], ["fingerprint", "form"])


def grouped(rows: DataFrame, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most_bits: int = 1 << 30) -> DataFrame:
    """Adds group_id (the least id of the rows whose canonical text is the same) and group_size to `rows`, which has
    the id and the `fingerprint` of every row of `docs`.

    Only texts whose fingerprint occurs twice are compared. A bitmap of at most `most_bits` bits, about 64 for each
    such fingerprint, lets the second scan leave out nearly all others before the shuffle; where it is too small for
    the input, more texts are compared and the result is the same."""
    buckets = checkpointed(rows.groupBy("fingerprint").agg(F.min(doc_id).alias("group_id"), F.count(F.lit(1)).alias("group_size")))
    shared = buckets.filter("group_size > 1")
    n = shared.count()
    bits = 1 << int(np.clip(np.ceil(np.log2(64 * max(1, n))), 16, np.log2(most_bits)))
    slot = F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1)) + 1
    bitmap = np.zeros(bits // 8, np.uint8)
    for part in shared.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toLocalIterator():
        at = (part["part"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(part["bits"], np.uint8)[: bits // 8 - at]
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _suspects(batches, sent.value, bits)

    bounded_batches(docs.sparkSession)
    forms = docs.select(text).mapInArrow(suspects, "fingerprint string, form string")
    same = forms.groupBy("fingerprint", "form").agg(F.count(F.lit(1)).alias("n"))  # compares the bytes
    collided = checkpointed(same.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"))
    joined = rows.join(buckets, "fingerprint")
    if collided.isEmpty():
        return joined
    apart = same.join(collided, "fingerprint", "left_semi")
    order = F.row_number().over(Window.partitionBy("fingerprint").orderBy("form")) - 1
    ordinals = apart.select("fingerprint", "form", order.alias("ordinal"))
    texts = per_row(docs, [doc_id], [text], "fingerprint string, form string", _forms).join(collided, "fingerprint", "left_semi")
    found = texts.join(ordinals, ["fingerprint", "form"]).select(doc_id, "fingerprint", "ordinal").distinct()
    new = joined.drop("group_id", "group_size").join(found, [doc_id, "fingerprint"], "left")
    new = new.withColumn("fingerprint", F.when(F.col("ordinal") > 0, F.concat_ws("-", "fingerprint", "ordinal")).otherwise(F.col("fingerprint"))).drop("ordinal")
    return new.join(new.groupBy("fingerprint").agg(F.min(doc_id).alias("group_id"), F.count(F.lit(1)).alias("group_size")), "fingerprint")


def _forms():
    return lambda text: (digest(canonical(text)), canonical(text))


def _longs(values: np.ndarray) -> Column:
    """An array column; one literal in the plan, however many values."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>") if len(values) else F.array().cast("array<bigint>")


def _below(bounds: np.ndarray, value: Column, step: int = 64) -> Column:
    """How many of the ascending bounds are at most the value: first by every step-th bound, then within a step."""
    coarse = F.size(F.filter(_longs(bounds[::step]), lambda b: b <= value))
    fine = F.slice(_longs(bounds), F.greatest(coarse - 1, F.lit(0)) * step + 1, step)
    return F.greatest(coarse - 1, F.lit(0)) * step + F.size(F.filter(fine, lambda b: b <= value))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_docs: int = 512, most_blocks: int = 4096) -> DataFrame:
    """doc_id, text, next_text, block, extra: each row with the text of the next one by descending id, null ids last; the
    first follows the last. Rows of equal id follow each other by the hash of their texts. Ids are whole numbers.

    Rows are cut into blocks at quantiles of the ids, so gaps and outliers don't matter; ids that fill blocks alone, and
    null ids, are cut further by the hash. Each block also gets a copy of the first row of the one after it (`extra` is
    1), so that no window spans more than a block. There are at most 3 * most_blocks + 1 blocks, whatever the input."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, known = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    wanted = int(np.clip(known // block_docs, 1, most_blocks))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted + 1)], 8 * wanted)).first()[0]
    bounds, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    hot = bounds[times > 1]  # ids with the rows of whole blocks
    without = int(np.clip((n - known) // block_docs, 1, most_blocks))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("at", _below(bounds, F.col("doc_id")))
    rows = rows.withColumn("hot_at", F.array_position(_longs(hot), F.col("doc_id")).cast("int"))
    parts = F.when(F.col("doc_id").isNull(), F.lit(without)).when(F.col("hot_at") > 0, F.get(_longs(times[times > 1]), F.col("hot_at") - 1)).otherwise(0)
    part = F.when(parts > 0, 1 + F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * parts), parts - 1)).otherwise(0)
    # blocks are numbered in the order of the rows: descending ids, and of an id that is cut the parts by hash
    block = (F.lit(len(bounds) + 1) - F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("at"))) * F.lit(1 << 20).cast("long") + part
    rows = rows.select("doc_id", "text", "tie", block.alias("block"))
    firsts = rows.groupBy("block").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("turned"))).alias("first"))
    chain = Window.orderBy("block")
    to = F.coalesce(F.lag("block").over(chain), F.max("block").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = F.broadcast(firsts.select(F.col("first.doc_id").alias("first"), F.bitwise_not("first.turned").alias("first_tie"), to.alias("to")))
    copies = rows.join(firsts, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("first_tie")))
    copies = copies.select("doc_id", "text", "tie", F.col("to").alias("block"), F.lit(1).alias("extra"))
    return rows.withColumn("extra", F.lit(0)).unionByName(copies).withColumn("next_text", F.lead("text").over(down()))


def down():
    """Within a block: its own rows by descending id, then the copy of the row that follows them."""
    return Window.partitionBy("block").orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie")


def _compared():
    def one(text: str, edited: str, after: str) -> tuple[str, str, float, float]:
        form, edited_form = canonical(text), canonical(edited)
        return digest(form), digest(edited_form), float(form == edited_form), float(form == canonical(after))

    return one


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text against its
    edited text, whose last third is the beginning of the next document. The fingerprint stands for the canonical bytes,
    so likeness is 1 if these are equal and 0 if not; the bytes themselves are compared."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs).filter("extra = 0").select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    columns = "fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return stored(per_row(rows, ["doc_id", "n_chars", "edited_sha256"], ["text", "edited", "next_text"], columns, _compared))
