"""Language identification by hierarchical discrimination.

First the language family is chosen, then the language within it. Each step holds one-versus-one
linear support vector machines over hashed character n-grams of words: each pair votes, the sum
of margins breaks ties. The machines are trained by stochastic sub-gradient descent (numpy) on a
bounded sample of labelled rows: at most ``per_lang`` for each language, ``sample_rows`` in all.
"""

from __future__ import annotations

import pickle
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cortexloom.llm._linear import WordTable, blocks, grams, mean_rows
from cortexloom.llm._text import held_out, lower_words, pieces, raw, table, to_learn

# Language families by language code.
FAMILIES = {
    "germanic": "af da de en is lb nb nl nn no sv",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "sinitic": "zh yue",
    "hellenic": "el",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "japonic": "ja",
    "koreanic": "ko",
    "tai": "lo th",
    "austroasiatic": "km vi",
    "austronesian": "id jv mg ms tl",
    "bantu": "sw xh zu",
}
LOW, HIGH, BUCKETS = 1, 3, 1 << 16
BROADCAST_LANGS = 100_000
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    """The family of a code; codes that are not listed form one family."""
    base = re.split("[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if base in codes.split()), "other")


def _word_ids(word: bytes) -> list[int]:
    return grams(word, LOW, HIGH, BUCKETS)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of a whole text, of length 1."""
    counts: dict[bytes, int] = {}
    for w in lower_words(text):
        counts[w] = counts.get(w, 0) + 1
    ids, wts = [], []
    for w, c in counts.items():
        g = _word_ids(w)
        ids += g
        wts += [c / len(g)] * len(g)
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    used, inv = np.unique(ids, return_inverse=True)
    x = np.bincount(inv, wts)
    return used.astype(np.int32), (x / np.linalg.norm(x)).astype(np.float32)


def machine(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, c: float = 1e-4, seed: int = 1) -> np.ndarray:
    """Weights of a linear SVM for targets of +1 and -1: hinge loss, sub-gradient steps, averaged over the last epochs."""
    rng = np.random.default_rng(seed)
    w, mean, n = np.zeros(BUCKETS), np.zeros(BUCKETS), 0
    share = {y: len(rows) / (2 * max(1, sum(r[2] == y for r in rows))) for y in (1, -1)}  # both sides weigh the same
    step = 0
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x, y = rows[i]
            step += 1
            lr = 1 / (1 + c * step) * 0.5
            if y * (x @ w[ids]) < 1:
                w[ids] += lr * y * share[y] * x
        w *= 1 - min(0.5, c * len(rows))
        if 2 * epoch >= epochs:
            mean, n = mean + w, n + 1
    return mean / max(1, n)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> dict:
    """Machines for each pair of families and for each pair of languages of a family."""
    rows = [r for r in rows if len(r[0])]
    langs = sorted({r[2] for r in rows})
    families = sorted({family(x) for x in langs})
    pairs, columns = [], []
    groups = [("family", families, family)] + [(f, [x for x in langs if family(x) == f], lambda x: x) for f in families]
    for kind, members, of in groups:
        for a, b in combinations(members, 2):
            some = [(i, x, 1 if of(y) == a else -1) for i, x, y in rows if of(y) in (a, b)]
            pairs.append((kind, a, b))
            columns.append(machine(some))
    return {
        "langs": langs,
        "groups": [(kind, members) for kind, members, _ in groups],
        "pairs": pairs,
        "W": np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((BUCKETS, 0), np.float32),
    }


def fit(docs: DataFrame, keep: Column | None = None, per_lang: int = 600, sample_rows: int = 4000) -> dict:
    """A model learned from rows with text, id and language for which ``keep`` holds; the sample is bounded as documented above.

    Every language is learned: with more than ``sample_rows`` languages, from one row each. Rows equal
    in id and language count once, with the text of the smallest hash.
    """
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep)).select("doc_id", F.col("lang").cast("string").alias("lang"))
    common = some.groupBy("lang").count()
    n = common.count()
    common = F.broadcast(common) if n <= BROADCAST_LANGS else common
    each = max(1, min(per_lang, sample_rows // max(1, n)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    near = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < 2_000_000 * each / F.col("count")  # about twice the rows to rank, in every language
    chosen = some.join(common, "lang").where(near).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each)
    chosen = chosen.select("doc_id", "lang").distinct()  # at most sample_rows rows, or one for each language

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pickle.dumps(features(t), 5) for t in raw(b.column(1))], pa.binary()), b.column(2)], ["doc_id", "f", "lang"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, f binary, lang string").toArrow()
    data = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "f", "lang"))))  # a fixed order
    return train([(*pickle.loads(f), y) for _, f, y in data])


def decide(model: dict, margins: np.ndarray) -> tuple[str, float]:
    """(language, score) from a document's mean margin under each machine."""
    weakest, kind = np.inf, "family"
    while True:
        members = next((m for k, m in model["groups"] if k == kind), [])
        votes = {m: [0, 0.0] for m in members}
        for (k, a, b), z in zip(model["pairs"], margins):
            if k == kind:
                votes[a if z >= 0 else b][0] += 1
                votes[a][1] += z
                votes[b][1] -= z
        won = max(members, key=lambda m: (*votes[m], m))
        for (k, a, b), z in zip(model["pairs"], margins):
            if k == kind and won in (a, b):
                weakest = min(weakest, z if won == a else -z)
        if kind != "family":
            return won, float(1 / (1 + np.exp(-np.clip(4 * weakest, -50, 50)))) if np.isfinite(weakest) else 1.0
        kind = won


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from its whole text.

    ``und`` with score 0 for a null text, a text without letters, or where no language was
    learned. The score is the logistic of the winner's weakest margin (1 if only one language
    was learned). Repeated rows and null ids come back as they are. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each pair of families and of languages of a family

    def run(batches):
        m = shared.value
        w = m["W"]
        words = WordTable(lambda ws: mean_rows(ws, _word_ids, w), w.shape[1])
        for b in pieces(batches):
            lang, score = [], np.zeros(b.num_rows)
            for i, t in enumerate(raw(b.column(1))):
                z, n = np.zeros(w.shape[1]), 0
                for part in blocks(lower_words(t)):
                    at = words.rows_for(part)  # may move the rows
                    z += words.rows[at].sum(axis=0, dtype=np.float64)
                    n += len(part)
                if not n or not m["langs"] or not _LETTER.search(t.decode("utf-8", "replace")):
                    lang.append("und")
                else:
                    best, score[i] = decide(m, z / n * np.sqrt(200))
                    lang.append(best)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, keep=to_learn("doc_id", 5))
    return predict(docs, model).select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score")
