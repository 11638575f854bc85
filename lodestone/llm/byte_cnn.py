"""Quality classifier: a byte-level convolutional network in numpy.

Bytes have learned vectors; filters of 8 bytes move over the text by 4. A text is cut into chunks of 256 bytes, each
of which also sees the first bytes of the next, so that no window is lost at a cut. In each chunk a filter's answers
are max-pooled and averaged; over the chunks of the whole document the network takes the greatest maximum, the mean
maximum and the greatest average of each filter, and combines them into one probability.

Weights are fitted by Adam on a bounded sample of labelled documents and sent to the tasks, about 20 kB. The sample
holds whole texts, at most `per_class` of each label and `most_bytes` bytes in all, in the order of a hash of the id;
there, and only there, texts of more than `longest` bytes are passed over.

A null text counts as empty; an empty text has no answers and gets the probability that the bias says. Labels other
than 0 and 1, null labels and ids with both labels teach nothing; without any labelled text every score is 0.5. Of
documents that share a labelled id the shortest text is learned from.
Repeated rows get equal scores, and an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tasks import checkpointed, per_row

VECTOR, STEP, CHUNK = 8, 4, 256
PER_CHUNK = CHUNK // STEP
PAD = 256


def _cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte numbers, each text padded to whole chunks; the first chunk of each text, and which windows hold bytes."""
    chunks = np.array([-(-len(t) // CHUNK) or 1 for t in texts])
    first = np.cumsum(chunks) - chunks
    cells = np.full((chunks.sum() + 1) * CHUNK, PAD, np.int16)
    real = np.zeros(chunks.sum() * PER_CHUNK, np.float32)
    for t, at in zip(texts, first, strict=True):
        cells[at * CHUNK : at * CHUNK + len(t)] = np.frombuffer(t, np.uint8)
        real[at * PER_CHUNK : at * PER_CHUNK + -(-len(t) // STEP)] = 1
    return cells, first, real


def _answers(w: dict, cells: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of STEP byte vectors, and the filters' answers in each window by chunk."""
    groups = w["vectors"][cells].reshape(-1, STEP * VECTOR)[: len(real) + 1]
    half = STEP * VECTOR
    z = groups[:-1] @ w["filters"][:half]
    z += groups[1:] @ w["filters"][half:]
    z += w["bias"]
    np.maximum(z, 0, out=z)
    z *= real[:, None]
    return groups, z.reshape(-1, PER_CHUNK, z.shape[1])


def _logit(w: dict, top: np.ndarray, mean: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(np.r_[first, len(top)])[:, None]
    pooled = np.concatenate([np.maximum.reduceat(top, first), np.add.reduceat(top, first) / n, np.maximum.reduceat(mean, first)], axis=1)
    return pooled, pooled @ w["combine"] + w["offset"][0]


def score(w: dict, text: bytes) -> float:
    """The probability of label 1; long texts are read in pieces of whole chunks."""
    cells, _, real = _cells([text])
    tops, means, piece = [], [], 256
    for at in range(0, len(real) // PER_CHUNK, piece):
        part = slice(at * PER_CHUNK, (at + piece) * PER_CHUNK)
        _, a = _answers(w, cells[at * CHUNK : (at + piece + 1) * CHUNK], real[part])
        tops.append(a.max(axis=1))
        means.append(a.mean(axis=1))
    _, logit = _logit(w, np.concatenate(tops), np.concatenate(means), np.zeros(1, np.int64))
    return float(1 / (1 + np.exp(-np.clip(logit[0], -60, 60))))


def fit(texts: list[bytes], labels: list[int], filters: int = 32, epochs: int = 10, least_steps: int = 800, batch: int = 32, batch_bytes: int = 1 << 18, rate: float = 0.004, odds: float = 1.0, seed: int = 5) -> dict:
    """Weights of the network. `odds`: how many times likelier label 1 against 0 is outside than among these texts."""
    rng = np.random.default_rng(seed)
    w = {
        "vectors": rng.normal(0, 0.5, (PAD + 1, VECTOR)),
        "filters": rng.normal(0, 0.2, (2 * STEP * VECTOR, filters)),
        "bias": np.zeros(filters),
        "combine": rng.normal(0, 0.1, 3 * filters),
        "offset": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["vectors"][PAD] = 0
    y = np.array(labels, np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    steps, half = 0, STEP * VECTOR
    batches: list[list[int]] = [[]]
    for i in np.argsort([len(t) for t in texts], kind="stable"):  # of similar length, so batches are even
        if batches[-1] and (len(batches[-1]) == batch or sum(len(texts[k]) for k in batches[-1]) + len(texts[i]) > batch_bytes):
            batches.append([])
        batches[-1].append(i)
    epochs = max(epochs, -(-least_steps // len(batches)))
    for epoch in range(epochs):
        for some in (batches[i] for i in rng.permutation(len(batches))):
            cells, first, real = _cells([texts[i] for i in some])
            groups, a = _answers(w, cells, real)
            top, mean = a.max(axis=1), a.mean(axis=1)
            pooled, logit = _logit(w, top, mean, first)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            d = (p - y[some]) / len(some)
            g = {"combine": pooled.T @ d, "offset": np.array([d.sum()], np.float32)}
            d_pooled = d[:, None] * w["combine"][None, :]
            n = np.diff(np.r_[first, len(top)])
            doc = np.repeat(np.arange(len(some)), n)
            d_top = (d_pooled[:, filters : 2 * filters] / n[:, None])[doc]
            d_top += d_pooled[:, :filters][doc] * (top == pooled[:, :filters][doc])
            d_mean = d_pooled[:, 2 * filters :][doc] * (mean == pooled[:, 2 * filters :][doc])
            d_a = (a == top[:, None, :]) * d_top[:, None, :] + (d_mean / PER_CHUNK)[:, None, :]
            d_z = (d_a * (a > 0)).reshape(-1, filters).astype(np.float32)
            g["bias"] = d_z.sum(axis=0)
            g["filters"] = np.concatenate([groups[:-1].T @ d_z, groups[1:].T @ d_z])
            d_groups = np.zeros_like(groups)
            d_groups[:-1] += d_z @ w["filters"][:half].T
            d_groups[1:] += d_z @ w["filters"][half:].T
            d_vectors, used = d_groups.reshape(-1, VECTOR), cells[: len(d_groups) * STEP]
            g["vectors"] = np.stack([np.bincount(used, d_vectors[:, k], PAD + 1) for k in range(VECTOR)], axis=1)
            g["vectors"][PAD] = 0
            steps += 1
            slow = rate * min(1.0, 2 * (1 - epoch / epochs))
            for k, v in g.items():
                m = moments[k]
                m[0] += 0.1 * (v - m[0])
                m[1] += 0.01 * (v * v - m[1])
                w[k] -= (slow * (m[0] / (1 - 0.9**steps)) / (np.sqrt(m[1] / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)
    w["offset"] += np.float32(np.log(odds))
    return w


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = 2000, most_bytes: int = 16 << 20, longest: int = 1 << 18) -> tuple[list[bytes], list[int], float]:
    """Whole texts and labels to fit on, the bounded sample, and the odds that fit() asks for; `labels` has the ids and
    labels to learn from."""
    one = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id__")).agg(F.min(label).alias("label__"), F.max(label).alias("other__")).filter("label__ = other__").drop("other__")
    counts = dict(one.groupBy("label__").count().collect())
    order = [F.xxhash64("id__"), F.col("id__")]
    chosen = F.broadcast(one.filter("label__ = 0").orderBy(*order).limit(per_class).unionAll(one.filter("label__ = 1").orderBy(*order).limit(per_class)))  # at most 2 * per_class rows
    found = docs.select(F.col(doc_id).alias("id__"), F.coalesce(F.col(text), F.lit("")).alias("text__")).join(chosen, "id__")
    # of rows of equal id the one of the shortest text, then the least: so there is one for each chosen id
    found = found.groupBy("id__", "label__").agg(F.min(F.struct(F.octet_length("text__").alias("size"), "text__")).alias("one__")).select("id__", "label__", "one__.size", "one__.text__")
    found = checkpointed(found)
    sizes = sorted(found.select(F.xxhash64("id__"), "id__", "size").collect(), key=lambda r: (r[0], r[1]))
    taken, total = set(), 0
    for _, i, size in sizes:
        if (size or 0) <= longest and total + (size or 0) <= most_bytes:
            total += size or 0
            taken.add(i)
    rows = [(str(r["id__"]), r["text__"], int(r["label__"])) for r in found.filter(F.col("id__").isin(*taken)).collect()] if taken else []
    rows.sort()
    n = [sum(r[2] == k for r in rows) for k in (0, 1)]
    odds = counts[1] / counts[0] * n[0] / n[1] if all(n) else 1.0
    return [_bytes(t) for _, t, _ in rows], [k for _, _, k in rows], odds


def _scoring(weights):
    w = weights.value

    def run(text: str | None) -> tuple[float]:
        return (score(w, _bytes(text)) if w else 0.5,)

    return run


def scores(docs: DataFrame, weights: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and `score`, the probability of label 1, of every whole text."""
    return per_row(docs, [doc_id], [text], "score double", partial(_scoring, docs.sparkSession.sparkContext.broadcast(weights)))
