"""Null populations: shuffled brains that keep every barcode's and every sample's number of present cells.

A shuffle is a fixed number of supersteps. In each, all barcodes of a brain are put in a hashed order, neighbours form
pairs, and all pairs trade at once: two barcodes keep the samples that they share and deal the others anew, in their
numbers. Order and deals are arithmetic on hashes of (seed, mouse, replicate, superstep), barcode and sample, so a shuffle
is one function of its input, whatever the size of the brain and wherever it runs. A brain of
up to ``bucket`` barcodes takes all supersteps in one task; of a larger one every superstep deals
all barcodes to buckets by their new place in the order, so nothing that was together stays together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cortexloom.operators import stats
from cortexloom.plans.scratch import Scratch

#: The prime below which hashes lie, and what each mixing step adds.
PRIME, PLUS = 2**31 - 1, 12345
#: Supersteps of a shuffle: every barcode trades about so many times.
STEPS = 10
#: Barcodes that are ordered together, and barcodes of a mouse that one task holds.
CELL, BUCKET = 64, 100_000
#: Replicates of a mouse that a task shuffles one after the other.
TASK_REPLICATES = 8


def mixed(x):
    """x ** 5 + PLUS modulo the prime, on integers, arrays and columns: a permutation of the numbers below it."""
    x = x % PRIME
    return (x * x % PRIME * (x * x % PRIME) % PRIME * x + PLUS) % PRIME


def step_key(seed: int, mouse, replicate: int, step: int) -> int:
    return int(hashlib.md5(f"{seed}|{mouse}|{replicate}|{step}".encode()).hexdigest()[:13], 16) % PRIME


def _hashed(text: Column) -> Column:
    """The same hash of a text column."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 13), 16, 10).cast("bigint") % F.lit(PRIME)


def traded(present: np.ndarray, code: np.ndarray, key: int, n: int) -> np.ndarray:
    """A superstep: ``present`` (barcodes x samples) after all pairs have traded. ``code``: the barcodes' hashes; ``n``: barcodes of the brain."""
    place = mixed(mixed(code + key))
    cell = place // (PRIME // max(1, n // CELL) + 1)
    order = np.lexsort((code, place, cell))
    cell = cell[order]
    start = np.flatnonzero(np.diff(cell, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    first = np.flatnonzero((rank % 2 == 0) & (np.append(cell[1:], -1) == cell))
    i, j = order[first], order[first + 1]
    a, b = present[i], present[j]
    loose = a != b
    deal = np.where(loose, mixed(mixed(mixed(place[i])[:, None] + np.arange(1, 1 + present.shape[1]))), PRIME)
    turn = np.argsort(np.argsort(deal, axis=1, kind="stable"), axis=1, kind="stable")  # the loose samples come first
    mine = loose & (turn < (a & ~b).sum(axis=1)[:, None])
    out = present.copy()
    out[i], out[j] = (a & b) | mine, (a & b) | (loose & ~mine)
    return out


def presence(bc: DataFrame) -> tuple[DataFrame, dict, dict]:
    """((mouse, barcode, code, bits), samples of each mouse, barcodes of each mouse): a barcode's present samples as packed bits.

    ``bc``: mouse, barcode, sample, value. The samples of a mouse are those of its plates, and come to the driver with one number a mouse.
    """
    cells = bc.where("value <> 0").select("mouse", "barcode", F.col("sample").cast("int").alias("sample"))
    samples = {r["mouse"]: r["s"] for r in cells.groupBy("mouse").agg(F.sort_array(F.collect_set("sample")).alias("s")).collect()}
    rows = cells.groupBy("mouse", "barcode").agg(F.collect_set("sample").alias("s"))
    kind = dict(bc.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for m, mine in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                bits.append(np.packbits(np.isin(samples[m], mine)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bits, pa.binary())], ["mouse", "barcode", "code", "bits"])

    rows = rows.select("mouse", "barcode", _hashed(F.col("barcode")).alias("code"), "s").mapInArrow(run, f"mouse {kind['mouse']}, barcode {kind['barcode']}, code bigint, bits binary")
    rows = Scratch(bc.sparkSession, "null").save(rows, "presence")
    return rows, samples, {r["mouse"]: r["count"] for r in rows.groupBy("mouse").count().collect()}


def _matrix(bits: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -1), axis=1, count=width).astype(bool)


def _packed(present: np.ndarray) -> pa.Array:
    rows = np.packbits(present, axis=1)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _populations(bc: DataFrame, replicates: tuple[int, int], seed: int, steps: int, bucket: int, out: Callable, schema: str) -> DataFrame:
    """``out(mouse, replicate, barcodes, samples, present)`` of every replicate from ``replicates[0]`` up to ``replicates[1]``; of a large brain, of each of its buckets."""
    rows, samples, sizes = presence(bc)
    low, high = replicates
    kind = dict(rows.dtypes)
    names, empty = [f.split()[0] for f in schema.split(", ")], None

    def finished(mouse, replicate: int, barcodes: pa.ChunkedArray, present: np.ndarray) -> pa.Table:
        return pa.table(dict(zip(names, out(mouse, replicate, barcodes, samples[mouse], present))))

    def whole(t: pa.Table) -> pa.Table:
        mouse, part = t["mouse"][0].as_py(), t["part"][0].as_py()
        t = t.sort_by([("code", "ascending"), ("barcode", "ascending")])
        begin, code = _matrix(t["bits"], len(samples[mouse])), t["code"].to_numpy()
        done = []
        for r in range(low + part * TASK_REPLICATES, min(high, low + (part + 1) * TASK_REPLICATES)):
            now = begin
            for s in range(steps):
                now = traded(now, code, step_key(seed, mouse, r, s), sizes[mouse])
            done.append(finished(mouse, r, t["barcode"], now))
        return pa.concat_tables(done)

    def step(s: int):
        def run(t: pa.Table) -> pa.Table:
            mouse, r = t["mouse"][0].as_py(), t["replicate"][0].as_py()
            t = t.sort_by([("code", "ascending"), ("barcode", "ascending")])
            now = traded(_matrix(t["bits"], len(samples[mouse])), t["code"].to_numpy(), step_key(seed, mouse, r, s), sizes[mouse])
            return t.drop_columns(["bucket", "bits"]).append_column("bits", _packed(now)).select(["mouse", "replicate", "barcode", "code", "bits"])

        return run

    def last(t: pa.Table) -> pa.Table:
        mouse = t["mouse"][0].as_py()
        return finished(mouse, t["replicate"][0].as_py(), t["barcode"], _matrix(t["bits"], len(samples[mouse])))

    large = [m for m, n in sizes.items() if n > bucket]
    parts = -(-(high - low) // TASK_REPLICATES)
    small = rows.where(~F.col("mouse").isin(large)) if large else rows
    small = small.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 0 else small.withColumn("part", F.lit(0)).limit(0)
    result = small.groupBy("mouse", "part").applyInArrow(whole, schema)
    if large and high > low:
        scratch = Scratch(bc.sparkSession, "trades")
        cells = F.create_map(*[F.lit(x) for m in large for x in (m, max(1, sizes[m] // CELL))])[F.col("mouse")]
        buckets = F.create_map(*[F.lit(x) for m in large for x in (m, -(-max(1, sizes[m] // CELL) // max(1, bucket // CELL)))])[F.col("mouse")]

        def dealt(df: DataFrame, s: int) -> DataFrame:
            key = _hashed(F.concat_ws("|", F.lit(str(seed)), F.col("mouse").cast("string"), F.col("replicate").cast("string"), F.lit(str(s))))
            cell = F.expr(f"mixed div (CAST({PRIME} AS bigint) div cells + 1)")
            df = df.withColumn("mixed", mixed(mixed(F.col("code") + key))).withColumn("cells", cells.cast("bigint"))
            return df.withColumn("bucket", F.floor(cell * buckets / F.col("cells")).cast("int")).drop("mixed", "cells")

        now = rows.where(F.col("mouse").isin(large)).select("mouse", F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint"))).alias("replicate"), "barcode", "code", "bits")
        state = f"mouse {kind['mouse']}, replicate bigint, barcode {kind['barcode']}, code bigint, bits binary"
        for s in range(steps):
            after = scratch.save(dealt(now, s).groupBy("mouse", "replicate", "bucket").applyInArrow(step(s), state), f"step{s}")
            scratch.drop(now)
            now = after
        result = result.unionAll(dealt(now, steps).groupBy("mouse", "replicate", "bucket").applyInArrow(last, schema))
    return result


def curveball_shuffle(bc: DataFrame, replicates: int, seed: int = 1, steps: int = STEPS, bucket: int = BUCKET) -> DataFrame:
    """(mouse, replicate, barcode, sample) of ``replicates`` shuffled matrices a mouse. ``bc``: mouse, barcode, sample, value."""
    kind, of_mouse = dict(bc.dtypes), to_arrow_type(bc.schema["mouse"].dataType)

    def out(mouse, replicate, barcodes, samples, present):
        r, c = np.nonzero(present)
        return pa.array([mouse] * len(r), of_mouse), pa.array(np.full(len(r), replicate)), barcodes.take(pa.array(r)), pa.array(np.array(samples, np.int32)[c])

    return _populations(bc, (0, replicates), seed, steps, bucket, out, f"mouse {kind['mouse']}, replicate bigint, barcode {kind['barcode']}, sample int")


def shuffled_counts(bc: DataFrame, area_samples: DataFrame, replicates: int | tuple[int, int], seed: int = 1, steps: int = STEPS, bucket: int = BUCKET) -> DataFrame:
    """(mouse, replicate, area_a, area_b, n): co-occurrence counts of shuffled brains, of all replicates or of a range of them.

    ``area_samples``: (mouse, sample, area) with a weight. A binary projection has an area exactly
    if the barcode is present in one of its samples, so counts are made where the shuffle ends and
    no shuffled matrix is moved; the counts of a large brain's buckets are added up.
    """
    links: dict = {}
    for r in area_samples.select("mouse", F.col("sample").cast("int").alias("sample"), "area").distinct().collect():  # samples and areas of the brains
        links.setdefault(r["mouse"], []).append((r["sample"], r["area"]))
    kind, of_mouse = dict(bc.dtypes)["mouse"], to_arrow_type(bc.schema["mouse"].dataType)

    def out(mouse, replicate, barcodes, samples, present):
        mine = links.get(mouse, [])
        areas, at = sorted({a for _, a in mine}), {s: i for i, s in enumerate(samples)}
        to = np.zeros((len(samples), len(areas)), np.int64)
        for s, a in mine:
            if s in at:
                to[at[s], areas.index(a)] = 1
        has = (present.astype(np.int64) @ to > 0).astype(np.int64)
        c = has.T @ has
        i, j = np.nonzero(c)
        names = pa.array(areas, pa.string())
        return pa.array([mouse] * len(i), of_mouse), pa.array(np.full(len(i), replicate)), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(c[i, j])

    span = replicates if isinstance(replicates, tuple) else (0, replicates)
    got = _populations(bc, span, seed, steps, bucket, out, f"mouse {kind}, replicate bigint, area_a string, area_b string, n bigint")
    return got.groupBy("mouse", "replicate", "area_a", "area_b").agg(F.sum("n").alias("n"))


def null_statistics(counts: DataFrame, areas: DataFrame, by_mouse: bool = False) -> DataFrame:
    """(mouse, replicate, stat, area_a, area_b, value): co-projection, P(b|a), cosine and neurons of every replicate.

    ``counts``: (mouse, replicate, area_a, area_b, n); ``areas``: (area), common to all mice.
    Counts of mice add up, so the mice together are one more sum.
    """
    some = counts.join(F.broadcast(areas.select(F.col("area").alias("area_a"))), "area_a").join(F.broadcast(areas.select(F.col("area").alias("area_b"))), "area_b")  # a brain's areas
    mouse = F.col("mouse").cast("string") if by_mouse else F.lit("all")
    by = ["mouse", "replicate"]
    c = some.groupBy(mouse.alias("mouse"), "replicate", "area_a", "area_b").agg(F.sum("n").alias("n"))
    probs = stats.conditional_probability(c, by)
    out = lambda df, stat, value: df.select(*by, F.lit(stat).alias("stat"), "area_a", "area_b", F.col(value).cast("double").alias("value"))
    return (
        out(stats.co_projection(c, by), "co_projection", "n")
        .unionByName(out(probs.where("area_a <> area_b"), "conditional_probability", "p"))
        .unionByName(out(stats.cosine_similarity(probs, by), "cosine", "cosine"))
        .unionByName(out(c.where("area_a = area_b"), "neurons", "n"))
    )


class Ledger:
    """Ranges of replicates in a folder: each is written once and counts when its commit marker is there.

    A range is a table of its own below ``range=<first>-<end>``. One that was cut off has no marker: it is deleted and
    written anew. Ranges of another seed, or of other data, belong in another folder.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, low: int, high: int) -> bool:
        return self._fs.exists(self._path(f"{self._folder(low, high)}/_SUCCESS"))

    def _folder(self, low: int, high: int) -> str:
        return f"{self.path}/range={low:09d}-{high:09d}"

    def add(self, low: int, high: int, make: Callable[[], DataFrame]) -> None:
        """Write a range, unless it is there."""
        if not self.done(low, high):
            make().coalesce(max(1, self.spark.sparkContext.defaultParallelism // 4)).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._folder(low, high))

    def read(self, ranges: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[self._folder(*r) for r in ranges])


def generate_null(bc: DataFrame, area_samples: DataFrame, areas: DataFrame, replicates: int = 100_000, by_mouse: bool = False, seed: int = 1, ledger: str | None = None, range_size: int = 1000, bucket: int = BUCKET) -> DataFrame:
    """Statistics of ``replicates`` shuffled populations.

    With ``ledger``, a folder that all executors share, the counts of every ``range_size`` replicates are committed there as soon
    as they are made, and a call that was cut off goes on with the ranges that are absent.
    """
    if ledger is None:
        return null_statistics(shuffled_counts(bc, area_samples, replicates, seed, bucket=bucket), areas, by_mouse)
    book = Ledger(bc.sparkSession, ledger)
    ranges = [(low, min(replicates, low + range_size)) for low in range(0, replicates, range_size)]
    for low, high in ranges:
        book.add(low, high, lambda: shuffled_counts(bc, area_samples, (low, high), seed, bucket=bucket))  # noqa: B023
    return null_statistics(book.read(ranges), areas, by_mouse)
