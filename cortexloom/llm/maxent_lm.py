"""Language-model scoring with a hashed maximum-entropy model and class-factored softmax.

P(token | history) = P(class | history) * P(token | class). The class is predicted by a softmax
over hashed features of the history (the word before, the two words before, and, skipping one,
the word before last); within a class tokens follow smoothed counts. Frequent tokens form
classes of about equal weight, all others (unknown ones too) belong to the class that their
last two bytes hash to, so every string has a probability and each history's sum to 1.

1. Documents are packed into blocks: a local vocabulary, and each document as local numbers.
2. Blocks send their vocabularies, dealt by token hash, to where each token is counted over the
   whole corpus; the counts go back to the blocks. No task and no machine holds the corpus'
   vocabulary, and a frequent token costs one entry a block, however often it occurs.
3. Distributed gradient updates: in each round every task runs through its share of the blocks
   with mini-batch gradient steps from the current weights; the weighted mean of the tasks'
   changes becomes the next weights. Every training document is used once.
4. Blocks meet their counts again and are scored in sparse numpy batches.

The driver holds the weights (FEATURES x CLASSES), the HEAD frequent tokens and a sum for each
class; their sizes do not depend on the input.
"""

from __future__ import annotations

import contextlib
import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm._text import held_out, lower_words, pieces, raw, table, to_learn
from cortexloom.plans.scratch import Scratch

FEATURES, HEAD_CLASSES, TAIL_CLASSES, HEAD = 1 << 14, 15, 16, 512
CLASSES = 1 + HEAD_CLASSES + TAIL_CLASSES  # class 0: the end of a text
BLOCK_TOKENS, BATCH, CHUNKS, ADD = 1 << 18, 4096, 16, 0.1
BATCH_BYTES = 4 << 20
END = b""  # no word is empty

_BLOCK = "block bigint, doc_ids array<bigint>, learn array<boolean>, lens array<int>, ids binary, vocab array<binary>, n array<bigint>"
_COUNTED = "block bigint, at array<int>, c array<bigint>, tokens array<binary>, counts array<bigint>, sums array<bigint>"


def tail_class(token: bytes) -> int:
    return 1 + HEAD_CLASSES + zlib.crc32(token[-2:]) % TAIL_CLASSES


@functools.cache
def _tails() -> np.ndarray:
    """Tail classes: of no byte, of one byte b at 1 + b, of bytes a, b at 257 + 256 * a + b."""
    ends = [b""] + [bytes([b]) for b in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    return np.array([tail_class(e) for e in ends], np.int64)


def _layout(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of an array of tokens."""
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2], np.uint8) if tokens.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets[:-1] - offsets[0]).astype(np.int64), np.diff(offsets).astype(np.int64)


def token_hashes(tokens: pa.Array) -> np.ndarray:
    """A 64-bit hash of every token, a polynomial in its bytes."""
    data, starts, lens = _layout(tokens)
    out = np.zeros(len(lens), np.uint64)
    some = np.flatnonzero(lens)
    if len(some):
        powers = np.cumprod(np.full(int(lens.max()), 0x9E3779B97F4A7C15, np.uint64))
        at = np.arange(len(data)) - np.repeat(starts[some], lens[some])
        out[some] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[at], starts[some])
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def tail_classes(tokens: pa.Array) -> np.ndarray:
    data, starts, lens = _layout(tokens)
    padded, end = np.append(data, 0).astype(np.int64), starts + lens
    last, before = padded[np.maximum(end - 1, 0)], padded[np.maximum(end - 2, 0)]
    return _tails()[np.where(lens == 0, 0, np.where(lens == 1, 1 + last, 257 + 256 * before + last))]


def _pack(batches):
    """Documents (doc_id, learn, text) to blocks of about BLOCK_TOKENS tokens; a longer text is a block of its own."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32())), ("ids", pa.binary()), ("vocab", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])
    part, seq = TaskContext.get().partitionId(), 0
    docs, vocab, size = [], {END: 0}, 0

    def row():
        ids = np.concatenate([d[2] for d in docs])
        kind = np.repeat([d[1] for d in docs], [len(d[2]) for d in docs])
        n = np.bincount(ids[kind], minlength=len(vocab))
        wide = np.uint16 if len(vocab) <= 1 << 16 else np.uint32
        one = {"block": part << 32 | seq, "doc_ids": [d[0] for d in docs], "learn": [d[1] for d in docs], "lens": [len(d[2]) for d in docs], "ids": ids.astype(wide).tobytes(), "vocab": list(vocab), "n": n.tolist()}
        return pa.RecordBatch.from_pylist([one], schema)

    for b in pieces(batches):
        for doc_id, learn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2))):
            put = vocab.setdefault
            ids = [put(w, len(vocab)) for w in lower_words(text)]
            ids.append(0)
            docs.append((doc_id, learn, np.array(ids, np.int64)))
            size += len(ids)
            if size >= BLOCK_TOKENS:
                yield row()
                docs, vocab, size, seq = [], {END: 0}, 0, seq + 1
    if docs:
        yield row()


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of about BATCH_BYTES inside: rows are texts or blocks of some MB, and by default 64 MB of them are held at once on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _deal(buckets: int):
    """Blocks to (bucket, block, at, tokens, n): the local vocabulary by token hash."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                vocab, n = b.column(1)[i].values, b.column(2)[i].values
                bucket = (token_hashes(vocab) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                found, starts = np.unique(bucket[order], return_index=True)
                offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
                take = pa.array(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.astype(np.int32)), pa.array(np.full(len(found), b.column(0)[i].as_py())), pa.ListArray.from_arrays(offsets, pa.array(order.astype(np.int32))), pa.ListArray.from_arrays(offsets, vocab.take(take)), pa.ListArray.from_arrays(offsets, n.take(take))],
                    ["bucket", "block", "at", "tokens", "n"],
                )

    return run


def _count(rows: pa.Table) -> pa.Table:
    """One bucket: each token's count over all blocks, back to the blocks; and the bucket's own figures in a last row."""
    rows = rows.combine_chunks()
    at, tokens, n = (rows[c].chunk(0) if rows.num_rows else None for c in ("at", "tokens", "n"))
    coded = tokens.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary
    c = np.bincount(codes, n.flatten().to_numpy(), len(names)).astype(np.int64)
    known = np.flatnonzero(c)
    cls = tail_classes(names)[known]
    sums = np.concatenate([np.bincount(cls, c[known], CLASSES), np.bincount(cls, minlength=CLASSES)]).astype(np.int64)  # tokens and distinct tokens by class
    least = np.partition(c[known], -HEAD)[-HEAD] if len(known) > HEAD else 0
    top = [(names[int(i)].as_py(), int(c[i])) for i in known[c[known] >= least]]
    best = sorted(top, key=lambda x: (-x[1], x[0]))[:HEAD]
    offsets = np.concatenate([tokens.offsets.to_numpy() - tokens.offsets.to_numpy()[0], [len(codes)]]).astype(np.int32)
    none = lambda kind, last: pa.array([None] * rows.num_rows + [last], pa.list_(kind))
    return pa.table({
        "block": pa.concat_arrays([rows["block"].chunk(0), pa.array([-1], pa.int64())]),
        "at": pa.ListArray.from_arrays(pa.array(offsets), at.flatten()),
        "c": pa.ListArray.from_arrays(pa.array(offsets), pa.array(c[codes])),
        "tokens": none(pa.binary(), [t for t, _ in best]),
        "counts": none(pa.int64(), [k for _, k in best]),
        "sums": none(pa.int64(), sums.tolist()),
    })


class Classes:
    """The class of every token, and the weight of each class."""

    def __init__(self, best: list[tuple[bytes, int]], tokens: np.ndarray, distinct: np.ndarray):
        """``best``: frequent tokens with counts; ``tokens``, ``distinct``: sums by tail class over all tokens."""
        self.n, self.v = int(tokens.sum()), int(distinct.sum())
        head = [(t, c) for t, c in sorted(best, key=lambda x: (-x[1], x[0])) if t != END][:HEAD]
        whole, seen = max(1, sum(c for _, c in head)), 0
        self.of, self.mass, self.kinds = {END: 0}, tokens.astype(np.float64), distinct.astype(np.float64)
        ends = dict(best).get(END, 0)
        for t, c in [(END, ends), *head]:
            if c:
                self.mass[tail_class(t)] -= c
                self.kinds[tail_class(t)] -= 1
            if t != END:
                self.of[t] = 1 + min(HEAD_CLASSES - 1, seen * HEAD_CLASSES // whole)
                seen += c
            self.mass[self.of[t]] += c
            self.kinds[self.of[t]] += 1
        self.kinds[1 + HEAD_CLASSES :] += 1  # the unknown tokens of a tail class, together
        used = self.kinds > 0
        self.prior = np.where(used, np.log((self.mass + ADD) / (self.mass + ADD).sum()), -60.0)
        self.below = np.where(used, self.mass + ADD * self.kinds, 1.0)
        self.own = np.sort(token_hashes(pa.array(list(self.of), pa.binary())))

    def local(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(class, hash) of a block's tokens."""
        cls, h = tail_classes(vocab), token_hashes(vocab)
        at = np.searchsorted(self.own, h)
        for i in np.flatnonzero(self.own[np.minimum(at, len(self.own) - 1)] == h).tolist():  # at most about HEAD
            cls[i] = self.of.get(vocab[i].as_py(), cls[i])
        return cls, h


def history(ids: np.ndarray, lens: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The three features (1 .. FEATURES - 1) of every token's history; row 0 of the weights is the bias."""
    w = h[ids]
    start = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    one, two = np.roll(w, 1), np.roll(w, 2)
    one[start] = 7
    two[start] = 7
    second = start[np.asarray(lens) > 1] + 1
    two[second] = 7
    m = np.uint64(FEATURES - 1)
    a, b = one * np.uint64(0x9E3779B1), two * np.uint64(0x85EBCA77) + np.uint64(12345)
    mix = lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)
    return np.stack([1 + mix(a) % m, 1 + mix(b) % m, 1 + mix(a * np.uint64(3) ^ b) % m], axis=1).astype(np.uint16)


def _logits(W: np.ndarray, f: np.ndarray) -> np.ndarray:
    return W[f[:, 0]] + W[f[:, 1]] + W[f[:, 2]] + W[0]


def steps(W: np.ndarray, power: np.ndarray, f: np.ndarray, y: np.ndarray, rate: float = 0.4) -> None:
    """Mini-batch gradient steps of the class softmax, in place; ``power`` holds each row's squared gradients so far."""
    for at in range(0, len(y), BATCH):
        g, t = f[at : at + BATCH], y[at : at + BATCH]
        z = _logits(W, g)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(t)), t] -= 1
        rows = g.T.ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        grad = np.add.reduceat(z[order % len(t)], first, axis=0)
        at_ = rows[first]
        power[at_] += np.square(grad).mean(axis=1)
        W[at_] -= rate * grad / np.sqrt(power[at_] + 1.0)[:, None]


def _unpacked(ids: bytes, lens: np.ndarray) -> np.ndarray:
    wide = np.uint16 if len(ids) == 2 * int(lens.sum()) else np.uint32
    return np.frombuffer(ids, wide).astype(np.int64)


def _train_task(shared):
    def run(batches):
        classes, start = shared.value
        W, power, seen = start.copy(), np.zeros(FEATURES, np.float32), 0
        for b in batches:
            for i in range(b.num_rows):
                learn = np.array(b.column(0)[i].as_py(), bool)
                lens = np.array(b.column(1)[i].as_py(), np.int64)
                ids = _unpacked(b.column(2)[i].as_py(), lens)
                cls, h = classes.local(b.column(3)[i].values)
                keep = np.repeat(learn, lens)
                if keep.any():
                    f, y = history(ids, lens, h)[keep], cls[ids[keep]]
                    steps(W, power, f, y)
                    seen += len(y)
        if seen:
            delta = ((W - start) * np.float32(seen)).reshape(CHUNKS, -1)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([part % 64] * CHUNKS, pa.int32()), pa.array([seen] * CHUNKS, pa.int64()), pa.array([d.astype(np.float32).tobytes() for d in delta], pa.binary())], ["chunk", "part", "seen", "delta"])

    return run


def _sum(rows: pa.Table) -> pa.Table:
    total = np.zeros(FEATURES * CLASSES // CHUNKS, np.float64)
    for d in rows["delta"].to_pylist():
        total += np.frombuffer(d, np.float32)
    return pa.table({"chunk": rows["chunk"].slice(0, 1), "part": rows["part"].slice(0, 1), "seen": pa.array([sum(rows["seen"].to_pylist())], pa.int64()), "delta": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def train(blocks: DataFrame, classes: Classes, rounds: int = 2) -> np.ndarray:
    """Weights after ``rounds`` rounds, each over its own share of the blocks."""
    sc, kind = blocks.sparkSession.sparkContext, "chunk int, part int, seen bigint, delta binary"
    W = np.zeros((FEATURES, CLASSES), np.float32)
    W[0] = classes.prior
    for r in range(rounds):
        shared = sc.broadcast((classes, W))
        mine = blocks.where(F.pmod(F.xxhash64("block", F.lit(3)), F.lit(rounds)) == r).select("learn", "lens", "ids", "vocab")
        some = mine.mapInArrow(_train_task(shared), kind).groupBy("chunk", "part").applyInArrow(_sum, kind)
        got = some.groupBy("chunk").applyInArrow(_sum, kind).collect()  # CHUNKS rows, the size of the weights
        for row in got:
            flat = W.reshape(CHUNKS, -1)
            flat[row["chunk"]] += np.frombuffer(row["delta"], np.float32) / row["seen"]
        shared.unpersist()
    return W


def _score(shared):
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        classes, W = shared.value
        if not block.num_rows:
            return out.empty_table()
        lens = np.array(block["lens"][0].as_py(), np.int64)
        ids, vocab = _unpacked(block["ids"][0].as_py(), lens), block["vocab"][0].values
        c = np.zeros(len(vocab), np.int64)
        at, n = (counts[x].combine_chunks().flatten().to_numpy() for x in ("at", "c"))  # a row a bucket, so many
        c[at] = n
        cls, h = classes.local(vocab)
        base = np.log10((c + ADD) / (classes.n + ADD * (classes.v + 1)))
        inside = np.log10((c + ADD) / classes.below[cls])
        f, y, own = history(ids, lens, h), cls[ids], inside[ids]
        for at in range(0, len(ids), BATCH):
            z = _logits(W, f[at : at + BATCH]).astype(np.float64)
            top = z.max(axis=1)
            t = y[at : at + BATCH]
            own[at : at + BATCH] += (z[np.arange(len(t)), t] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))) / math.log(10)
        start = np.concatenate([[0], np.cumsum(lens)[:-1]])
        return pa.table([block["doc_ids"].chunk(0).flatten(), pa.array(lens), pa.array(np.add.reduceat((c > 0).astype(np.int64)[ids], start)), pa.array(np.add.reduceat(base[ids], start)), pa.array(np.add.reduceat(own, start))], schema=out)

    return run


def score(docs: DataFrame, learn: Column, rounds: int = 2) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row, learned from the rows where ``learn`` holds.

    Null and empty texts have one token, the end. Repeated rows each come back; null ids too. With
    nothing to learn from all tokens are unknown and the model is uniform over what is left. An
    empty table gives an empty result. Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), learn.alias("learn"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        blocks = scratch.save(rows.mapInArrow(_pack, _BLOCK), "blocks", compression="zstd")
    buckets = max(256, blocks.count())
    dealt = blocks.select("block", "vocab", "n").mapInArrow(_deal(buckets), "bucket int, block bigint, at array<int>, tokens array<binary>, n array<bigint>")
    with small_batches(docs.sparkSession):
        counted = scratch.save(dealt.groupBy("bucket").applyInArrow(_count, _COUNTED), "counted", compression="zstd")
    own = counted.where("block = -1")
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 * CLASSES)]
    total = np.array([x or 0 for x in own.agg(*sums).first()], np.int64)
    best = own.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select("x.*")
    ends = best.where(F.length("tokens") == 0)
    best = best.where(F.length("tokens") > 0).orderBy(F.desc("counts"), "tokens").limit(HEAD).unionAll(ends)
    classes = Classes([(bytes(t), c) for t, c in best.collect()], total[:CLASSES], total[CLASSES:])  # HEAD + 1 rows
    with small_batches(docs.sparkSession):
        W = train(blocks, classes, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((classes, W))
    scored = (
        blocks.select("block", "doc_ids", "lens", "ids", "vocab").groupBy("block")
        .cogroup(counted.where("block >= 0").select("block", "at", "c").groupBy("block"))
        .applyInArrow(_score(shared), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    )
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(classes.n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), to_learn("doc_id", 10))
    return scored.withColumn("held_out", held_out("doc_id", 10))
