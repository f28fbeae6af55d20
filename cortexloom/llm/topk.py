"""Exact top-k search: tiles of query block x shard, partial selection, tree merging.

Vectors are quantised to integers (``floor(256 * x)``), so scores are exact integer inner
products and every ranking is reproducible. The stated query set meets all rows in blocks:
the rows are dealt into shards, the queries into blocks, and one task multiplies one block by
one shard as a matrix product and keeps each query's k best. The partial lists are then merged
in a tree of fixed fan-in, so no task ever sees more than ``fan_in * k`` entries of a query.

Defined cases: a vector that is null or holds null, NaN or an infinity takes no part, neither
as query nor as candidate; an empty vector is a vector of length 0. Vectors of different length
have no score together. Rows that share the query's id count as its own and are left out. A
query id that occurs more than once is asked once, with its smallest vector; repeated candidate
rows each take a rank. Null ids take no part. Equal scores go to the smaller id. Fewer than k
candidates give shorter lists, none gives no row; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cortexloom.llm._text import table

_PART = "query_id bigint, shard int, cand_id bigint, score bigint"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact q @ c.T: in float64 where no sum can pass 2**53, else in int64."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _tile(k: int):
    def run(queries: pa.Table, cands: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "shard": [], "cand_id": [], "score": []}
        if queries.num_rows and cands.num_rows:
            cands = cands.sort_by("id")  # then the first of equal scores is the smaller id
            ids, c = cands["id"].to_numpy(), _matrix(cands["v"].combine_chunks())
            shard = cands["shard"][0].as_py()
            for at in range(0, queries.num_rows, 256):
                part = queries.slice(at, 256)
                qid = part["id"].to_numpy()
                s = _products(_matrix(part["v"].combine_chunks()), c)
                for row, own in zip(s, qid):
                    allowed = np.flatnonzero(ids != own)
                    if len(allowed) > k:
                        scores = row[allowed]
                        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                        above, ties = allowed[scores > cut], allowed[scores == cut]
                        allowed = np.concatenate([above, ties[: k - len(above)]])
                    out["query_id"] += [own] * len(allowed)
                    out["shard"] += [shard] * len(allowed)
                    out["cand_id"] += ids[allowed].tolist()
                    out["score"] += row[allowed].tolist()
        types = {"query_id": pa.int64(), "shard": pa.int32(), "cand_id": pa.int64(), "score": pa.int64()}
        return pa.table({n: pa.array(v, types[n]) for n, v in out.items()})

    return run


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component as long, for the vectors that take part."""
    x = F.col("v")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null").where(~bad).select("id", F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 256,
    shard_rows: int = 8192,
    block_queries: int = 2048,
    fan_in: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row where ``is_query`` holds.

    ``is_query`` is a condition on ``vectors``. ``shard_rows`` and ``block_queries`` bound a tile;
    every row meets every query block, which is the work that exact search has to do.
    """
    rows = quantised(vectors, id_col, vec_col, scale).withColumn("dim", F.size("v"))
    asked = (
        quantised(vectors.where(is_query), id_col, vec_col, scale)
        .groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    )
    n_rows = vectors.count()
    n_asked = vectors.where(is_query).count()
    shards, blocks = max(1, math.ceil(n_rows / shard_rows)), max(1, math.ceil(n_asked / block_queries))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cands = rows.withColumn("shard", deal(shards, 1)).withColumn("block", each(blocks))
    queries = asked.withColumn("block", deal(blocks, 2)).withColumn("shard", each(shards))
    key = ["dim", "block", "shard"]
    lists = (
        queries.select(*key, "id", "v").groupBy(*key).cogroup(cands.select(*key, "id", "v").groupBy(*key)).applyInArrow(_tile(k), _PART)
    )
    while True:  # merge the lists of fan_in neighbouring shards until one list is left
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
        shards = math.ceil(shards / fan_in)
        best = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "cand_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if shards <= 1:
            break
    return lists.select("query_id", "rank", F.col("cand_id").alias("vec_id"), "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) t
WHERE rank <= 5
"""
