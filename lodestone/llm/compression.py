"""Quality rules: word, line and repetition counts, and bands of zstandard compression ratios.

A document's bytes over its compressed bytes, of the whole text and of each fixed chunk, must lie between the
limits of the length's band: above the upper limit a text repeats itself, below the lower limit it is noise.
Lengths decide the limits because a compressor needs some text to find what repeats. A text is judged whole: a
document is kept unless it fails a base rule, its whole ratio leaves the band, or chunks that leave theirs hold
more than a given share of its bytes.

A null or empty text has no words and fails the base rules; its ratio is null. Each row is judged by itself:
repeated rows and ties get equal results, an empty table gives an empty one, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.tasks import bounded_batches, per_row

SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\r\x0b\x0c"


class Band(NamedTuple):
    """Limits of the ratio for texts of at least so many bytes."""

    from_bytes: int
    low: float
    high: float


#: Low limits: the least ratio of the documents of sf0.1 that labels call good and the base rules keep, whole or as a
#: chunk, less 3 per cent. Random letters (1.6 to 1.7) fall below them from 1,600 bytes on, hexadecimal digests (1.9)
#: from 3,200; shorter ones and random digits (2.1) lie among clean ratios. High limits: text that says all twice.
BANDS = (
    Band(0, 0.0, 4.0),
    Band(200, 1.27, 2.8),
    Band(400, 1.36, 2.8),
    Band(800, 1.56, 3.0),
    Band(1600, 1.78, 3.3),
    Band(3200, 1.95, 3.6),
    Band(6400, 2.11, 3.6),
    Band(12800, 2.21, 4.0),
    Band(25600, 2.32, 4.0),
)

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, low_share double, high_share double"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words which occurs twice or more in the text, the first included."""
    if len(words) <= width:
        return 0
    ids = {w: i for i, w in enumerate(set(words))}
    a = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    code, span = a, len(ids)
    for k in range(1, width):
        if code.max() >= (1 << 62) // span:
            code = np.unique(code, return_inverse=True)[1]
        code = code[:-1] * span + a[k:]
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    covered = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(np.isin(code, twice))
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def judge(text: str | None, compressor, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = 2048, most_outside: float = 0.25, least_words: int = 50, most_repeated: int = 50) -> tuple:
    """The columns of SCHEMA for one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at ASCII white space
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    n_repeat = repeated_words(words)
    base_failed = len(words) < least_words or 100 * n_repeat > most_repeated * len(words)
    limits = lambda n: next(b for b in reversed(bands) if n >= b.from_bytes)
    ratio, low, high = None, 0, 0
    kept = not base_failed
    if data:
        ratio = len(data) / len(compressor.compress(data))
        band = limits(len(data))
        for at in range(0, len(data), chunk_bytes):
            chunk = data[at : at + chunk_bytes]
            of, r = limits(len(chunk)), len(chunk) / len(compressor.compress(chunk))
            low += len(chunk) * (r < of.low)
            high += len(chunk) * (r > of.high)
        kept = kept and band.low <= ratio <= band.high and low + high <= most_outside * len(data)
    counts = len(words), len(text) - sum(map(text.count, ASCII_SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat
    return *counts, base_failed, kept, ratio, low / max(1, len(data)), high / max(1, len(data))


def _judging(level: int, options: dict):
    import zstandard

    return partial(judge, compressor=zstandard.ZstdCompressor(level=level), **options)


def rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", level: int = 3, **options) -> DataFrame:
    """The id and the columns of SCHEMA for each row; options are those of judge()."""
    return per_row(docs, [doc_id], [text], SCHEMA, partial(_judging, level, options))


def _passed(batches: Iterator[pa.RecordBatch], text: str, level: int, options: dict) -> Iterator[pa.RecordBatch]:
    made = _judging(level, options)
    for batch in batches:
        yield batch.filter(pa.array([made(t)[6] for t in batch.column(text).to_pylist()], pa.bool_()))


def keep(docs: DataFrame, text: str = "text", level: int = 3, **options) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_passed, text=text, level=level, options=options), docs.schema)
