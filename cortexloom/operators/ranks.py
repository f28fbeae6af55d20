"""Exact ranks of tables of any size, without a window over a whole group."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cortexloom.plans.scratch import Scratch

#: Rows that one split, so one window partition, should hold.
SPLIT_ROWS = 500_000


def ranked(df: DataFrame, by: list[str], order: list[Column | str], out: str = "rank", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``df`` with each row's place (from 1) among the rows of the same ``by``, in an order that should leave no ties.

    Rows are range-partitioned by (by, order) at sampled bounds and written with their split. A split's
    first rank is the number of rows of its group in earlier splits: a table of one row a split and one a
    group. Inside a split rows are numbered by a window. A group of any size is so many splits; ``by`` may be empty.
    """
    rows = df.count()
    scratch = Scratch(df.sparkSession, "ranks")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parted = scratch.save(df.repartitionByRange(max(1, math.ceil(rows / split_rows)), *[F.col(c) for c in by], *keys).withColumn("_split", F.spark_partition_id()), "splits")
    sizes = parted.groupBy(*by, "_split").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    on = [*by, "_split"]
    starts = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in on], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*on).orderBy(*keys))
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on])
    found = parted.withColumn("_own", own).join(F.broadcast(starts), same)  # a row a split, and one a group
    return found.select(*df.columns, (F.col("_own") + F.col("_start")).alias(out))
