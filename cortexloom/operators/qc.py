"""Quality-control tables behind the cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexloom.functions.sequences import at_content, relative_abundance, shannon_entropy


def umi_histogram(summary: DataFrame, col: str, bins: int = 20, low: float = 0.0, high: float = 5.0) -> DataFrame:
    """(bin, n): log10 of a count column in equal bins; bin 0 below, bins + 1 above."""
    b = F.width_bucket(F.log10(F.col(col).cast("double")), F.lit(low), F.lit(high), F.lit(bins))
    return summary.where(F.col(col) > 0).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def neurons_per_umi(summary: DataFrame) -> DataFrame:
    """(different_neurons, n, share) over all UMIs."""
    n = summary.groupBy("different_neurons").agg(F.count("*").alias("n"))
    whole = summary.agg(F.count("*").alias("whole"))
    return n.crossJoin(F.broadcast(whole)).select("different_neurons", "n", (F.col("n") / F.col("whole")).alias("share"))  # one row


def umi_composition(summary: DataFrame) -> DataFrame:
    """Ratio, entropy and AT content of the UMIs that have a second neuron."""
    ratio = relative_abundance(F.col("first_abundant"), F.col("second_abundant"))
    return summary.where("second_abundant > 0").select("umi", ratio.alias("ratio"), shannon_entropy(F.col("umi")).alias("entropy"), at_content(F.col("umi")).alias("at_share"))


def umi_2d_histogram(summary: DataFrame, col: str, bins: int, high: float, step: float = 10.0, ratio_bins: int = 20) -> DataFrame:
    """(bin, ratio_bin, n): entropy or AT content against the ratio."""
    x = F.width_bucket(F.col(col), F.lit(0.0), F.lit(high), F.lit(bins)).cast("int")
    r = F.width_bucket(F.col("ratio"), F.lit(0.0), F.lit(step * ratio_bins), F.lit(ratio_bins)).cast("int")
    return umi_composition(summary).groupBy(x.alias("bin"), r.alias("ratio_bin")).agg(F.count("*").alias("n"))


def expected_duplicates(summary: DataFrame, umi_length: int = 14) -> DataFrame:
    """UMIs, and their share of all possible ones."""
    return summary.agg(F.count("*").alias("n_umis"), (F.count("*") / F.lit(float(4**umi_length))).alias("expected_duplicates"))
