"""Projection statistics: all follow from the co-occurrence counts of areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_occurrence(p: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, area_a, area_b, n): barcodes with both areas, the diagonal included.

    Each barcode's areas become one array, so pairs are made inside a row; the number of areas of
    a brain bounds them.
    """
    by = by or []
    sets = p.where("strength <> 0").groupBy(*by, "barcode").agg(F.collect_set("area").alias("s"))
    pairs = sets.select(*by, F.explode("s").alias("area_a"), "s").select(*by, "area_a", F.explode("s").alias("area_b"))
    return pairs.groupBy(*by, "area_a", "area_b").agg(F.count("*").alias("n"))


def conditional_probability(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, area_a, area_b, p): P(b | a)."""
    by = by or []
    own = c.where("area_a = area_b").select(*by, "area_a", F.col("n").alias("n_a"))
    return c.join(own, [*by, "area_a"]).select(*by, "area_a", "area_b", (F.col("n") / F.col("n_a")).alias("p"))


def co_projection(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, area_a, area_b, n) of the unordered pairs, a < b."""
    return c.where("area_a < area_b")


def cosine_similarity(probs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, area_a, area_b, cosine) of P(. | a) and P(. | b) without the entries a and b; 0 for a zero vector."""
    by = by or []
    names = probs.select(*by, F.col("area_a").alias("a")).distinct()
    pairs = names.join(names.withColumnRenamed("a", "b"), by).where("a < b") if by else names.crossJoin(names.withColumnRenamed("a", "b")).where("a < b")
    vec = probs.groupBy(*by, "area_a").agg(F.map_from_entries(F.collect_list(F.struct("area_b", "p"))).alias("v"))
    left, right = vec.select(*by, F.col("area_a").alias("a"), F.col("v").alias("va")), vec.select(*by, F.col("area_a").alias("b"), F.col("v").alias("vb"))
    both = pairs.join(left, [*by, "a"]).join(right, [*by, "b"])
    keys = lambda m: F.sort_array(F.filter(F.map_keys(m), lambda k: (k != F.col("a")) & (k != F.col("b"))))
    total = lambda ks, f: F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + f(k))
    va, vb = F.col("va"), F.col("vb")
    dot = total(keys(va), lambda k: va[k] * F.coalesce(F.try_element_at(vb, k), F.lit(0.0)))
    norm = lambda v: F.sqrt(total(keys(v), lambda k: v[k] * v[k]))
    cosine = F.coalesce(dot / F.nullif(norm(va) * norm(vb), F.lit(0.0)), F.lit(0.0))
    return both.select(*by, F.col("a").alias("area_a"), F.col("b").alias("area_b"), cosine.alias("cosine"))


def neurons_per_area(c: DataFrame) -> DataFrame:
    return c.where("area_a = area_b").drop("area_b").withColumnRenamed("area_a", "area")


def projection_summary(p: DataFrame, totals: DataFrame) -> DataFrame:
    """(mouse, area, frequency, mean_strength): share of all the mouse's barcodes, mean of the positive strengths. ``totals``: mouse, n_all."""
    some = p.groupBy("mouse", "area").agg(F.count_if(F.col("strength") > 0).alias("n"), F.avg(F.when(F.col("strength") > 0, F.col("strength"))).alias("mean_strength"))
    return some.join(totals, "mouse").select("mouse", "area", (F.col("n") / F.col("n_all")).alias("frequency"), "mean_strength")
