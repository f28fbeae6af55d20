"""Quality classifier on supervised subword embeddings.

Every hash bucket of words, of their character n-grams and of word pairs (bigrams) has a learned
vector. A document is the average of its features' vectors; a softmax layer gives the classes'
probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows (``sample_rows``); scoring runs over all rows in Arrow
batches, whole texts always.

Defined cases of fitting: an id that occurs in several rows counts once, with the text of the
smallest hash; null ids, null labels and texts without words are not learned from; of several
labels of an id the largest holds.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm._linear import WordTable, blocks, grams, mean_rows
from cortexloom.llm._text import held_out, pieces, raw, table, to_learn

LOW, HIGH, BUCKETS = 3, 4, 1 << 17  # as many buckets for word pairs again


def _word_ids(word: bytes) -> list[int]:
    return grams(word, LOW, HIGH, BUCKETS)


def _hash(word: bytes) -> int:
    return zlib.crc32(word, 2) & 0xFFFFFF  # exact in float32


def _pairs(h: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from their hashes."""
    h = h.astype(np.uint64)
    mixed = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return BUCKETS + (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of a whole text; the weights of words and of pairs sum to a half each, none for a text without words."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    n = np.bincount(at)
    ids, wts = [], []
    for w, c in zip(place, n):
        g = _word_ids(w)
        ids += g
        wts += [c / len(g)] * len(g)
    pairs = _pairs(np.fromiter(map(_hash, place), np.int64, len(place))[at])
    wts = np.concatenate([np.array(wts) / len(words), np.full(len(pairs), 1 / max(1, len(pairs)))]) / 2
    ids = np.concatenate([ids, pairs]).astype(np.int64)
    used, inv = np.unique(ids, return_inverse=True)
    return used.astype(np.int32), np.bincount(inv, wts).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int = 2, dim: int = 16, epochs: int = 12, rate: float = 4.0, seed: int = 1) -> dict[str, np.ndarray]:
    """Vectors ``E``, layer ``W`` and ``b`` by stochastic gradient descent, one document a step, falling rate."""
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1 / dim, 1 / dim, (2 * BUCKETS, dim)).astype(np.float32)
    W, b = np.zeros((dim, classes), np.float32), np.zeros(classes, np.float32)
    rows = [r for r in rows if len(r[0])]
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x, y = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            part = E[ids]
            h = x @ part
            z = h @ W + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            E[ids] = part - (lr * x)[:, None] * (W @ p)[None, :]
            W -= lr * 0.1 * np.outer(h, p)
            b -= lr * 0.01 * p
    return {"E": E, "W": W, "b": b}


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int, keep: Column | None) -> DataFrame:
    """(doc_id, label): at most ``sample_rows`` labelled ids that occur in ``docs``, by a fixed order of hashes."""
    known = labels.where(F.col(label_col).isNotNull() & (F.lit(True) if keep is None else keep)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    return (
        known.join(docs.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample_rows)
    )


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 5000, keep: Column | None = None, classes: int = 2) -> dict[str, np.ndarray]:
    """A model of ``label_col`` learned from at most ``sample_rows`` labelled rows for which ``keep`` holds.

    Features are made on the executors; the driver gets the sample's feature lists only, whose
    number is bounded by ``sample_rows`` times the number of buckets. No labelled row: a model
    that gives every class the same probability.
    """
    chosen = sampled(docs, labels, label_col, sample_rows, keep)

    def run(batches):
        for b in pieces(batches):
            out = [pickle.dumps(features(t), 5) for t in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["doc_id", "f", "label"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))  # one row for each
    got = rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, f binary, label int").toArrow()
    data = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "f", "label"))))  # a fixed order
    return train([(*pickle.loads(f), min(max(y, 0), classes - 1)) for _, f, y in data], classes)


def score(docs: DataFrame, model: dict[str, np.ndarray], positive: int = 1) -> DataFrame:
    """(doc_id, score): the probability of class ``positive`` for every row, from its whole text.

    Null, empty and blank texts have no features and get the probability of the bare layer.
    Repeated rows and null ids come back as they are; an empty table gives an empty result.
    Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x dim numbers, whatever the input

    def run(batches):
        m = shared.value
        scores = (m["E"] @ m["W"]).astype(np.float32)  # each bucket's share of the classes' logits
        k = scores.shape[1]
        rows_of = lambda ws: np.column_stack([mean_rows(ws, _word_ids, scores), np.fromiter(map(_hash, ws), np.float32, len(ws))])
        words = WordTable(rows_of, k + 1)
        for b in pieces(batches):
            out = np.zeros(b.num_rows)
            for i, t in enumerate(raw(b.column(1))):
                z, zp, n, last = np.zeros(k), np.zeros(k), 0, np.zeros(0, np.float32)
                for part in blocks(t.split() if t else []):
                    at = words.rows_for(part)  # may move the rows
                    got = words.rows[at]
                    h = np.concatenate([last, got[:, k]])
                    z += got[:, :k].sum(axis=0, dtype=np.float64)
                    zp += scores[_pairs(h)].sum(axis=0, dtype=np.float64)
                    n, last = n + len(part), h[-1:]
                z = z / max(1, 2 * n) + zp / max(1, 2 * (n - 1)) + m["b"]
                p = np.exp(z - z.max())
                out[i] = p[positive] / p.sum()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, "quality", keep=to_learn("doc_id", 5))
    return score(docs, model).select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
