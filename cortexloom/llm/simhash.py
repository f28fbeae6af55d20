"""SimHash near-duplicates, linked exactly through distributed vantage-point trees.

1. One pass over the whole texts gives each document its 64-bit fingerprint (word shingles,
   XXH64, majority bit). Equal fingerprints are one point from then on.
2. Two fingerprints that differ in at most ``radius`` bits differ in at most ``radius // 2`` bits
   in one of their halves. So there is one vantage-point tree for each half: a node holds a
   vantage point and a radius, and parts the halves by Hamming distance from that point. The
   upper levels are grown from a bounded sample; they only decide where points meet, never
   whether they are compared.
3. Every point has one home leaf. By the triangle bound a point whose distance lies within the
   search radius of a node's boundary can have partners across it; it visits those leaves too.
   A pair parted at a node is found by the side inside, so only insiders cross, and a visitor
   goes on both ways wherever its ball meets a boundary.
4. A leaf is a shard. Crowded leaves (groups of thousands of near copies) are cut into tiles
   of bounded rows. A tile compares all 64 bits of visitors with residents, links within the
   task, and emits at most one link for each point, never all pairs of a group.
5. The links of all tiles meet in ``connected_components``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm._text import lower_words, pieces, raw, table
from cortexloom.operators.components import connected_components
from cortexloom.plans.scratch import Scratch

_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    a, b = starts[:n].tolist(), ends[-n:].tolist()
    digest, over = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[x:y], seed) for x, y in zip(a[at : at + _CHUNK], b[at : at + _CHUNK])], "<u8")
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, row: Column | None = None) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a long; with ``row``, also that long of each row."""
    extra = [] if row is None else [row.alias("row")]
    names = ["doc_id", "fp", *["row" for _ in extra]]

    def run(batches):
        for b in pieces(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in raw(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    return (u >> np.uint64(32)).astype(np.uint32), (u & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def grow(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a tree of ``depth`` levels, nodes numbered as in a heap from 1.

    A node takes, of a few candidates, the point whose median distance has the least weight on
    the boundary, and that median as its radius.
    """
    rng = np.random.default_rng(seed)
    vp, radius = np.zeros(1 << depth, np.uint32), np.zeros(1 << depth, np.int64)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        rows = parts.pop(node, np.zeros(0, np.uint32))
        near = rng.choice(rows, min(8, len(rows)), replace=False) if len(rows) else np.zeros(0, np.uint32)
        tried = np.concatenate([near, rng.integers(0, 1 << 32, 8, dtype=np.uint32)])
        d = np.bitwise_count(rows[None, :] ^ tried[:, None]).astype(np.int64)
        r = np.maximum(0, np.floor(np.median(d, axis=1)).astype(np.int64) if len(rows) else np.full(len(tried), 16))
        if len(rows):  # the boundary's weight, plus a penalty for uneven parts
            inside = (d <= r[:, None]).mean(axis=1)
            best = int(np.argmin((d == r[:, None]).mean(axis=1) + 2 * np.abs(inside - 0.5)))
        else:
            best = len(tried) - 1
        vp[node], radius[node] = tried[best], r[best]
        if 2 * node < 1 << depth:
            into = d[best] <= r[best]
            parts[2 * node], parts[2 * node + 1] = rows[into], rows[~into]
    return vp, radius


def route(points: np.ndarray, vp: np.ndarray, radius: np.ndarray, depth: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): each point once in its home leaf, and in every other leaf where it must look."""
    row, node, home = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
    for _ in range(depth):
        d = np.bitwise_count(points[row] ^ vp[node]).astype(np.int64)
        r = radius[node]
        inside = d <= r
        to_in = np.where(home, inside, d - reach <= r)
        to_out = np.where(home, ~inside, d + reach > r)
        cross = home & inside & (d + reach > r)
        row, node, home = (
            np.concatenate([row[to_in], row[to_out], row[cross]]),
            np.concatenate([2 * node[to_in], 2 * node[to_out] + 1, 2 * node[cross] + 1]),
            np.concatenate([home[to_in], home[to_out], np.zeros(int(cross.sum()), bool)]),
        )
    return row, node - (1 << depth), home


def linked(residents: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, smaller point of its group) for the groups that residents and others form here."""
    points = np.unique(np.concatenate([residents, others]))
    r, o = np.unique(residents), np.unique(np.concatenate([residents, others]))
    lab = np.arange(len(points))
    at, where = np.searchsorted(points, r), np.searchsorted(points, o)
    bits = o.view(np.uint64)
    step = max(1, (4 << 20) // max(1, len(o)))
    for i in range(0, len(r), step):
        near = np.bitwise_count(r[i : i + step].view(np.uint64)[:, None] ^ bits[None, :]) <= radius
        for j in np.flatnonzero(near.sum(axis=1) > 1):
            roots = np.unique(np.append(lab[where[near[j]]], lab[at[i + j]]))
            if len(roots) > 1:
                lab[np.isin(lab, roots)] = roots[0]
    moved = lab != np.arange(len(points))
    return points[moved], points[lab[moved]]


def links(fps: DataFrame, n: int, scratch: Scratch, radius: int = 3, leaf_rows: int = 2048, sample_per_leaf: int = 32, max_depth: int = 16) -> DataFrame:
    """(src, dst): links between distinct fingerprints ``fps(fp)`` that span every group within ``radius`` bits."""
    spark = fps.sparkSession
    depth = min(max_depth, max(0, math.ceil(math.log2(max(1, n) / leaf_rows))))
    want = sample_per_leaf << depth  # at most 2 ** 21 fingerprints of 8 bytes
    taken = fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1.0, want / max(1, n)))).limit(2 * want).toPandas()
    trees = [grow(h, depth, 11 + i) for i, h in enumerate(_halves(np.sort(taken["fp"].to_numpy(np.int64))))]
    tree_b = spark.sparkContext.broadcast(trees)  # bounded by max_depth: 2 trees of 2**16 nodes
    reach = radius // 2

    def visit(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            for t, (vp, rad) in enumerate(tree_b.value):
                row, leaf, home = route(_halves(fp)[t], vp, rad, depth, reach)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(home), pa.array(fp[row])], ["tree", "leaf", "home", "fp"])

    routed = scratch.save(fps.mapInArrow(visit, "tree int, leaf int, home boolean, fp bigint"), "routed")
    full = (
        routed.groupBy("tree", "leaf").agg(F.count_if("home").alias("residents"), F.count("*").alias("all"))
        .select("tree", "leaf", F.ceil(F.col("residents") / (2 * leaf_rows)).cast("int").alias("g"), F.ceil(F.col("all") / (4 * leaf_rows)).cast("int").alias("c"))
        .where("g > 0")
    )
    full = scratch.save(full, "leaves")
    dealt = routed.join(full, ["tree", "leaf"])
    deal = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["tree", "leaf", "j", "q", "resident", "fp"]
    as_resident = dealt.where("home").withColumn("j", deal("g", 3)).withColumn("q", each("c")).withColumn("resident", F.lit(True)).select(cols)
    as_visitor = dealt.where("not home or g > 1 or c > 1").withColumn("q", deal("c", 5)).withColumn("j", each("g")).withColumn("resident", F.lit(False)).select(cols)

    def tile(rows: pa.Table) -> pa.Table:
        fp, res = rows["fp"].to_numpy(), rows["resident"].to_numpy(zero_copy_only=False)
        src, dst = linked(fp[res], fp[~res], radius)
        return pa.table({"src": src, "dst": dst})

    return as_resident.unionAll(as_visitor).groupBy("tree", "leaf", "j", "q").applyInArrow(tile, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, leaf_rows: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated
    rows each come back, with one component. A null doc_id keeps its row; components take their
    smallest non-null id, null if there is none. An empty table gives an empty result. Only
    doc_id and text are read, so further columns cannot clash.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, shingle, seed), "fingerprints")
    named = _groups(rows, scratch, radius, leaf_rows).select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped_rows(docs: DataFrame, row: Column, radius: int = 3, shingle: int = 3, seed: int = 42, leaf_rows: int = 2048) -> DataFrame:
    """(doc_id, row, root) for every row of ``docs``: ``row`` as given, a long, and the group's own number, also where ids are null or shared."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, shingle, seed, row), "fingerprints")
    return rows.join(_groups(rows, scratch, radius, leaf_rows).select("fp", "root"), "fp").select("doc_id", "row", "root")


def _groups(rows: DataFrame, scratch: Scratch, radius: int, leaf_rows: int) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of ``rows``."""
    fps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = links(fps.select("fp"), fps.count(), scratch, radius, leaf_rows)
    comps = scratch.save(connected_components(found), "components")
    rooted = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    rooted = scratch.save(rooted.select("fp", "root", "first_id"), "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    return scratch.save(rooted.join(least, "root").select("fp", "root", "component_id"), "named")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
