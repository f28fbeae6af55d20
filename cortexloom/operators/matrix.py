"""The barcode matrix in long form: (barcode, sample, value), absent cells are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cortexloom.operators.ranks import SPLIT_ROWS, ranked

def _by() -> object:
    return Window.partitionBy("barcode")


def filter_total_counts(bc: DataFrame, min_total: float = 100) -> DataFrame:
    """Barcodes whose row total is at least ``min_total``."""
    return bc.withColumn("_t", F.sum("value").over(_by())).where(F.col("_t") >= min_total).drop("_t")


def zero_low_counts(bc: DataFrame, min_value: int = 2) -> DataFrame:
    """Without the cells equal to 1 .. min_value - 1; run it after ``filter_total_counts``, totals are not redone."""
    return bc.where(~F.col("value").isin([float(v) for v in range(1, min_value)])) if min_value > 1 else bc


def filter_min_samples(bc: DataFrame, more_than: int = 2) -> DataFrame:
    """Barcodes seen in more than ``more_than`` samples."""
    return bc.withColumn("_n", F.count_if(F.col("value") != 0).over(_by())).where(F.col("_n") > more_than).drop("_n")


def highest_second(bc: DataFrame) -> DataFrame:
    """(barcode, highest, second): repeats count, absent cells are 0; one aggregation, no sort."""
    top = F.max("value").alias("highest")
    at = F.count_if(F.col("value") == F.col("m"))
    wide = bc.withColumn("m", F.max("value").over(_by()))
    below = F.max(F.when(F.col("value") < F.col("m"), F.col("value")))
    return wide.groupBy("barcode").agg(top, F.when(at > 1, F.max("value")).otherwise(F.coalesce(below, F.lit(0.0))).alias("second"))


def filter_soma(bc: DataFrame, ratio: float = 5, min_second: float = 10) -> DataFrame:
    """Barcodes with one dominant sample: highest / second above ``ratio`` and second at least ``min_second``."""
    keep = highest_second(bc).where((F.col("second") >= min_second) & (F.log10(F.col("highest") / F.nullif("second", F.lit(0.0))) > F.log10(F.lit(float(ratio)))))
    return bc.join(keep.select("barcode"), "barcode", "left_semi")


def argmax_sample(bc: DataFrame) -> DataFrame:
    """(barcode, sample) of the highest value; the smaller sample wins a tie."""
    return bc.groupBy("barcode").agg(F.max_by("sample", F.struct("value", (-F.col("sample")).alias("s"))).alias("sample"))


def filter_source_region(bc: DataFrame, sources: list[int]) -> DataFrame:
    """Barcodes whose highest sample is one of ``sources``."""
    return bc.join(argmax_sample(bc).where(F.col("sample").isin(sources)).select("barcode"), "barcode", "left_semi")


def failed_samples(bc: DataFrame, samples: list[int]) -> list[int]:
    """Samples of the list without any value left; one row a sample reaches the driver."""
    seen = {r[0] for r in bc.where("value <> 0").select("sample").where(F.col("sample").isin(samples)).distinct().collect()}
    return [s for s in samples if s not in seen]


def keep_samples(bc: DataFrame, samples: list[int]) -> DataFrame:
    return bc.where(F.col("sample").isin(samples))


def drop_samples(bc: DataFrame, samples: list[int]) -> DataFrame:
    return bc.where(~F.col("sample").isin(samples))


def drop_empty_barcodes(bc: DataFrame) -> DataFrame:
    """Without zero cells, and so without barcodes that have nothing else."""
    return bc.where("value <> 0")


def spike_factor(spikes: DataFrame, cutoff: float = 10) -> DataFrame:
    """(sample, total, factor) of the samples with at least ``cutoff`` spike counts; the median is over those above it."""
    total = spikes.groupBy("sample").agg(F.sum("value").alias("total")).where(F.col("total") >= cutoff)
    median = total.where(F.col("total") > cutoff).agg(F.median("total").alias("m"))
    return total.crossJoin(F.broadcast(median)).select("sample", "total", (F.col("total") / F.col("m")).alias("factor"))  # one row


def spike_normalise(bc: DataFrame, spikes: DataFrame, cutoff: float = 10) -> DataFrame:
    """Values over their sample's factor; samples with too few spikes are dropped."""
    return bc.join(spike_factor(spikes, cutoff).select("sample", "factor"), "sample").select("barcode", "sample", (F.col("value") / F.col("factor")).alias("value"))


def negative_control(bc: DataFrame, controls: list[int]) -> DataFrame:
    """(value, n): how often each value occurs in the control samples."""
    return bc.where(F.col("sample").isin(controls) & (F.col("value") > 0)).groupBy("value").agg(F.count("*").alias("n"))


def rank_abundance(bc: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(barcode, total, rank) by descending total, ties by barcode."""
    return ranked(bc.groupBy("barcode").agg(F.sum("value").alias("total")), [], [F.desc("total"), "barcode"], split_rows=split_rows)


def rename_tubes(bc: DataFrame, tube_map: DataFrame, combine: dict[int, list[int]] | None = None, dropped: list[int] | None = None) -> DataFrame:
    """Samples as tubes: unmapped samples and tube 0 go, tubes of a group are summed into its head, ``dropped`` tubes go."""
    head = {t: h for h, ts in (combine or {}).items() for t in ts}
    tube = F.col("tube")
    if head:
        tube = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in head.items() for x in kv]), tube), tube)
    named = bc.join(F.broadcast(tube_map), "sample").where("tube <> 0").select("barcode", tube.alias("sample"), "value")  # a row a tube
    out = named.groupBy("barcode", "sample").agg(F.sum("value").alias("value"))
    return drop_samples(out, dropped) if dropped else out


def zero_adjacent_to_soma(bc: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Without the cells in samples next to the barcode's highest sample; ``adjacent``: (label, neighbour)."""
    near = argmax_sample(bc).join(adjacent, F.col("sample") == F.col("label")).select("barcode", F.col("neighbour").alias("sample"))
    return bc.join(near, ["barcode", "sample"], "left_anti")


def prefix_barcodes(bc: DataFrame, mouse: Column | str) -> DataFrame:
    return bc.withColumn("barcode", F.concat_ws("_", F.lit(mouse) if isinstance(mouse, str) else mouse, F.col("barcode").cast("string")))


def barcode_max(bc: DataFrame) -> DataFrame:
    return bc.groupBy("mouse", "barcode").agg(F.max("value").alias("max"))


def scale_rows(p: DataFrame, n_columns: int, how: str = "range", value: str = "value", by: str = "barcode") -> DataFrame:
    """Values over (row max - row min), absent cells counting as 0; ``minmax`` also subtracts the min.

    ``n_columns``: columns of the dense table. Rows of equal values become 0. Under ``minmax`` the
    absent cells of a row stay absent, since their minimum is 0 then.
    """
    if how not in ("range", "minmax"):
        raise ValueError(f"how is {how!r}; it can be range or minmax")
    w = Window.partitionBy(by)
    least = F.when(F.count("*").over(w) < n_columns, F.least(F.min(value).over(w), F.lit(0.0))).otherwise(F.min(value).over(w))
    span = F.nullif(F.max(value).over(w) - least, F.lit(0.0))
    top = F.col(value) - least if how == "minmax" else F.col(value)
    return p.withColumn(value, F.coalesce(top / span, F.lit(0.0)))


def scale_by_second_unique(bc: DataFrame) -> DataFrame:
    """Values over the row's second largest distinct value (0 of absent cells counts); null without one, or if it is 0."""
    distinct = F.sort_array(F.array_distinct(F.array_append(F.collect_set("value").over(_by()), F.lit(0.0))), asc=False)
    return bc.withColumn("value", F.col("value") / F.nullif(F.get(distinct, F.lit(1)), F.lit(0.0)))


def binarise(bc: DataFrame) -> DataFrame:
    return bc.withColumn("value", (F.col("value") != 0).cast("int"))


def column_shuffle(bc: DataFrame, samples: list[int], seed: int, replicate: int = 0, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Each sample's values dealt anew over all barcodes, zeros included; a function of seed and replicate only.

    The barcode at place i by name gets, in each sample, the value of the barcode at place i of a hashed order. The order by
    name is ranked once, the hashed ones once a sample; only cells that are not zero are joined.
    """
    barcodes = bc.select("barcode").distinct()
    grid = barcodes.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    grid = grid.withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit(replicate), "sample", "barcode")))
    hashed = ranked(grid, ["sample"], ["_key", "barcode"], "_at", split_rows)
    values = hashed.join(bc.where("value <> 0"), ["barcode", "sample"]).select("sample", "value", "_at")
    names = ranked(barcodes, [], ["barcode"], "_at", split_rows)
    return values.join(names, "_at").select("barcode", "sample", "value")
