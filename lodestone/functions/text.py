"""Column functions on texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term is a run of letters and digits; in Chinese text, which has no spaces, one Han character.
TERM = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def terms(text: Column) -> Column:
    """Lower-case terms in order; none for a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def counted(items: Column) -> Column:
    """Array of (term, tf): the distinct items of an array without nulls, in order, and how often each occurs. Once the
    items are sorted, the ends of their runs tell; all is made within the row, so that nothing has to move."""
    ends = lambda w: F.filter(F.transform(w, lambda x, i: F.when(~x.eqNullSafe(F.get(w, i + 1)), i + 1)), lambda e: e.isNotNull())
    run = lambda w, e, x, j: F.struct(F.get(w, x - 1).alias("term"), (x - F.coalesce(F.get(e, j - 1), F.lit(0))).cast("long").alias("tf"))
    # what is used several times is named by way of an array of one, or it would be made anew for each item
    runs = lambda w: F.get(F.transform(F.array(ends(w)), lambda e: F.transform(e, lambda x, j: run(w, e, x, j))), F.lit(0))
    return F.get(F.transform(F.array(F.sort_array(items)), runs), F.lit(0))


def strip_tags(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags go, white space becomes single spaces."""
    bare = F.regexp_replace(html, r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def chunk_texts(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of (chunk_no from 0, text) with `size` characters each, the last maybe fewer; empty for null and empty
    texts. Each begins `size - overlap` after the one before, and the last is the first to reach the end."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step))).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    pieces = F.transform(at, lambda i: F.struct(i.alias("chunk_no"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))
    return F.when(F.length(text) > 0, pieces)


def listed(rows: DataFrame, items: Column, name: str, *kept: str | Column) -> DataFrame:
    """The columns `kept` and each item of an array, as `name`; null items and rows without any are left out.

    From a plain explode Spark infers a filter on the size of the array and pushes it to the scan, where the array is
    then made a second time; after explode_outer there is only the filter on the item."""
    return rows.select(*kept, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
