"""Vector code compression: product codes from integer codebooks, searched through Walsh-Hadamard coefficients.

Vectors are quantised to integers (``floor(scale * x)``) and cut into equal consecutive parts. Every
part position has a codebook, which starts from the vectors of the smallest ids and is refined by a
fixed number of rounds of assignment and floored averaging; then every part becomes the index of
its nearest entry.

The nearest entry is found without floating point. Parts and entries are padded with zeros to a
power of two ``L`` and multiplied by the integer Walsh-Hadamard matrix with its rows in sequency
order, which multiplies squared distances by exactly ``L``. Squared differences are added up one
coefficient at a time, smooth ones first. The entry that is best after the first coefficient is
measured in full, and an entry goes as soon as its partial sum passes that bound: partial sums only
grow, so no nearest entry is lost, and equal distances stay until the smaller index wins.

All rows pass through Arrow batches where they are read. Between rounds only sums and counts by (part,
entry) are shuffled, 64 x dimension numbers a task; codebooks of that size are all that the driver holds.

Defined cases: a vector that is null or holds null, NaN or an infinity is dropped. Vectors whose
length ``parts`` does not divide, or that are shorter than the longest, count as filled with zeros at
the end. The codebook starts from the smallest distinct ids; a repeated id gives its smallest vector,
and null ids come last, as one id. Fewer ids than ``entries`` give a smaller codebook. Repeated rows
stay; an empty table gives an empty result. Other columns are not read, whatever their names.
Components too large for 64-bit sums are worked on as Python integers; an error that does not fit in a
long is an OverflowError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cortexloom.llm._text import table
from cortexloom.plans.scratch import Scratch

#: Rows that are compared with a codebook at a time.
BLOCK = 2048
#: A label is common from one row in so many on; at most so many labels are, and their sums are broadcast.
COMMON = 1000


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``: integers, as int64 or, where those are too short, Python's."""

    entries: np.ndarray
    scale: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def walsh(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def _fits(largest: int, size: int) -> bool:
    """Whether ``size`` times a squared distance of vectors of ``size`` components stays in 64 bits."""
    return 4 * size * size * largest * largest < 1 << 62


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of every row of ``x``; ties go to the smaller index."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    largest = max([0] + [int(abs(a).max()) for a in (x, entries) if a.size])
    h = walsh(size)[:, : x.shape[1]].T  # the columns that meet padding zeros are not needed
    if not _fits(largest, size):
        x, entries, h = x.astype(object), entries.astype(object), h.astype(object)
    tx, te = x @ h, entries @ h
    best, dist = np.zeros(len(x), np.int64), np.zeros(len(x), tx.dtype)
    for at in range(0, len(x), BLOCK):
        q = tx[at : at + BLOCK]
        part = (q[:, :1] - te[:, 0]) ** 2
        first = part.argmin(axis=1)
        bound = ((q - te[first]) ** 2).sum(axis=1)
        row, entry = np.nonzero(part <= bound[:, None])
        part = part[row, entry]
        for k in range(1, size):
            part = part + (q[row, k] - te[entry, k]) ** 2
            left = part <= bound[row]
            row, entry, part = row[left], entry[left], part[left]
        start = np.flatnonzero(np.diff(row, prepend=-1))  # row by row, entries in order
        low = np.minimum.reduceat(part, start)
        hit = np.flatnonzero(part == low[row])
        best[at : at + BLOCK] = entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]]
        dist[at : at + BLOCK] = low // size
    return best, dist


def _integers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """The vectors of a column as a matrix of ``width`` integers, filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(column.value_lengths())
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if len(flat) and np.abs(scaled).max() >= 2.0**62:
        scaled = np.array([math.floor(f * scale) if abs(f) < 2.0**53 else int(f) * scale for f in flat.tolist()], object)
    else:
        scaled = scaled.astype(np.int64)
    out = np.zeros((len(column), width), scaled.dtype)
    out[np.arange(width) < sizes[:, None]] = scaled
    return out


def _vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """(id, v, label) of the vectors that take part."""
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    cols = [F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")]
    return vectors.select(*cols, *([F.col(f"`{label_col}`").alias("label")] if label_col else [])).where("v is not null").where(~bad)


def _seeds(entries: int, scale: int):
    """Of each task, the smallest vector of each of its smallest ids, and its longest vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bool, int], list[int]] = {}
        longest = 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column(0), b.column(1)
            longest = max(longest, int(np.asarray(v.value_lengths()).max()))
            known = ids.drop_null().unique().sort()[:entries]
            last = known[-1].as_py() if len(known) == entries else None
            for i, key in enumerate(ids.to_pylist()):
                if (key is None or last is not None and key > last) and (key is not None or last is not None):
                    continue
                row = v.slice(i, 1)
                own = _integers(row, scale, len(row.flatten()))[0].tolist()
                at = (key is None, key or 0)
                if at not in found or own < found[at]:
                    found[at] = own
            found = {k: found[k] for k in sorted(found)[:entries]}
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if none else i for none, i in keys], pa.int64()), pa.array([",".join(map(str, found[k])) for k in keys], pa.string()), pa.array([longest] * len(keys), pa.int32())],
            ["id", "v", "longest"],
        )

    return run


def _sums(books: Codebooks):
    """Of each task, count and sums by (part, entry)."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), object)
        for b in batches:
            m = _integers(b.column(1), books.scale, parts * width)
            safe = m.dtype != object and (not m.size or int(np.abs(m).max()) * len(m) < 1 << 62)
            for p in range(parts):
                x = m[:, p * width : (p + 1) * width]
                code, _ = nearest(x, books.entries[p])
                n[p] += np.bincount(code, minlength=entries)
                order = np.argsort(code, kind="stable")
                start = np.flatnonzero(np.diff(code[order], prepend=-1))
                if len(start) and width:
                    total[p, code[order][start]] += np.add.reduceat((x if safe else x.astype(object))[order], start, axis=0).astype(object)
        for p in range(parts):
            used = np.flatnonzero(n[p])
            rows = [[Decimal(int(s)) for s in total[p, e]] for e in used]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(n[p, used]), *[pa.array([r[i] for r in rows], pa.decimal128(28, 0)) for i in range(width)]],
                ["part", "entry", "n", *[f"s{i}" for i in range(width)]],
            )

    return run, "part int, entry int, n bigint" + "".join(f", s{i} decimal(28,0)" for i in range(width))


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> Codebooks:
    """The codebooks after ``rounds`` passes over all vectors."""
    rows = _vectors(vectors, id_col, vec_col)
    found = Scratch(rows.sparkSession, "codes").save(rows.mapInArrow(_seeds(entries, scale), "id bigint, v string, longest int"), "seeds")
    width = math.ceil((found.agg(F.max("longest")).first()[0] or 0) / parts)
    split = F.transform(F.split("v", ","), lambda e: e.try_cast("decimal(38,0)"))  # compared as numbers
    first = found.withColumn("k", split).groupBy("id").agg(F.min_by("v", "k").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    start = [[int(x) for x in r["v"].split(",") if x] for r in first]
    start = [v + [0] * (parts * width - len(v)) for v in start]
    kind = np.int64 if all(abs(x) < 1 << 62 for v in start for x in v) else object
    books = np.array(start, kind).reshape(len(start), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if start else 0):
        run, schema = _sums(Codebooks(books, scale))
        sums = rows.mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
        books = books.copy()
        for r in sums.collect():  # a row of each (part, entry)
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Codebooks(np.ascontiguousarray(books), scale)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error): the entry of each part as an array of ints, and the squared distances summed."""
    parts, entries, width = books.entries.shape
    rows = _vectors(vectors, id_col, vec_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _integers(b.column(1), books.scale, parts * width)
            found = [nearest(m[:, p * width : (p + 1) * width], books.entries[p]) for p in range(parts)] if entries and b.num_rows else []
            code = np.stack([c for c, _ in found], axis=1) if found else np.zeros((b.num_rows, parts), np.int64)
            error = sum([d.astype(object) for _, d in found], np.zeros(b.num_rows, object))
            ends = pa.array(np.arange(b.num_rows + 1) * parts, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(ends, pa.array(code.ravel(), pa.int32())), pa.array(error.tolist(), pa.int64())], ["id", "label", "code", "error"])

    schema = rows.select("id", "label").schema.add("code", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    return rows.mapInArrow(run, schema)


def with_group_sum(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same ``key`` (null is a key). ``rows`` should be a written table: it is read thrice.

    Keys that hold at least one row in ``COMMON`` are fewer than that, so their sums are broadcast; the
    others, none of which can fill a partition, are joined by a shuffle.
    """
    sums = rows.groupBy(key).agg(F.sum(value).alias(out), F.count("*").alias("_n")).withColumnRenamed(key, "_k")
    sums = Scratch(rows.sparkSession, "sums").save(sums)
    least = (sums.agg(F.sum("_n")).first()[0] or 0) / COMMON
    common, rare = F.broadcast(sums.where(F.col("_n") >= least)), sums.where(F.col("_n") < least)
    same = F.col(key).eqNullSafe(F.col("_k"))
    return rows.join(common, same).unionAll(rows.join(common, same, "left_anti").join(rare, same)).drop("_k", "_n")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = train(vectors)
    rows = Scratch(spark, "codes").save(encode(vectors, books), "codes")
    out = with_group_sum(rows, "label", "error", "label_error")
    digits = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return out.select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _assigned(k: int) -> str:
    """a{k}: of every part, the nearest entry of c{k} and its distance."""
    return f"""
d{k} AS MATERIALIZED (SELECT rn, part, entry, CAST(coalesce(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS BIGINT) AS d FROM p JOIN c{k} c USING (part)),
a{k} AS MATERIALIZED (SELECT rn, part, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d FROM d{k} GROUP BY rn, part)"""


def _averaged(k: int) -> str:
    """c{k + 1}: the floored means of what a{k} assigned; unused entries as they were."""
    return f"""
u{k} AS (SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN p USING (rn, part), range(1, 1 + (SELECT width FROM w)) t(i) GROUP BY part, entry, i),
m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM u{k} GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (SELECT CAST(ceil(max(len(e)) / 16.0) AS BIGINT) AS width FROM v),
p AS MATERIALIZED (SELECT rn, vec_id, part, list_slice(e, part * width + 1, part * width + width) AS x FROM v, w, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_assigned(0)},{_averaged(0)},{_assigned(1)},{_averaged(1)},{_assigned(2)},
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM c2),
r AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 JOIN v USING (rn) GROUP BY rn, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM r, b
"""
