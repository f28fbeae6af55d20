"""Template switching, molecule counts and barcode counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexloom.functions.sequences import relative_abundance
from cortexloom.operators.params import MoleculeParams
from cortexloom.operators.reads import classify


def umi_switch_summary(corrected: DataFrame, salts: int = 1024) -> DataFrame:
    """Per corrected UMI over all samples: reads, distinct neurons, the two most abundant and where the first one is.

    Reads are summed by (umi, neuron, sample) first, so a common UMI costs one row a neuron. Its two best neurons
    are found in two levels, of ``salts`` shares of its neurons and then of their twos, so one with any number of neurons is
    many tasks' work. Ties go to the smaller sequence, then to the smaller sample.
    """
    by_sample = corrected.groupBy(F.col("corrected_umi").alias("umi"), F.col("corrected_neuron").alias("neuron"), "sample").agg(F.count("*").alias("n"))
    best = F.max_by("sample", F.struct("n", (-F.col("sample")).alias("s")))
    by_neuron = by_sample.groupBy("umi", "neuron").agg(F.sum("n").alias("n"), best.alias("sample"))
    two = lambda rows: F.slice(F.sort_array(rows), 1, 2)
    row = F.struct((-F.col("n")).alias("less"), "neuron", "sample")
    share = F.pmod(F.xxhash64("neuron"), F.lit(salts)).alias("share")
    shares = by_neuron.groupBy("umi", share).agg(F.sum("n").alias("total"), F.count("*").alias("neurons"), two(F.collect_list(row)).alias("top"))
    summed = shares.groupBy("umi").agg(F.sum("total").alias("total"), F.sum("neurons").alias("different_neurons"), two(F.flatten(F.collect_list("top"))).alias("top"))
    first, second = F.col("top")[0], F.get("top", F.lit(1))
    return summed.select(
        "umi",
        "total",
        "different_neurons",
        (-first["less"]).alias("first_abundant"),
        F.coalesce(-second["less"], F.lit(0)).alias("second_abundant"),
        F.concat(first["neuron"], "umi").alias("sequence_of_1st"),
        first["sample"].alias("sample_of_1st"),
    )


def shared_umis(summary: DataFrame) -> DataFrame:
    """UMIs of more than one neuron: putative template switches, with their ratio."""
    return summary.where("different_neurons > 1").withColumn("ratio", relative_abundance(F.col("first_abundant"), F.col("second_abundant")))


def resolve_template_switch(corrected: DataFrame, summary: DataFrame, threshold: float = 8.0) -> DataFrame:
    """Reads without junk: a shared UMI keeps only its dominant sequence in its sample, if the ratio passes ``threshold``."""
    sw = shared_umis(summary).select(F.col("umi").alias("corrected_umi"), "ratio", "sequence_of_1st", "sample_of_1st")
    own = F.concat("corrected_neuron", "corrected_umi")
    joined = corrected.join(sw, "corrected_umi", "left")
    keep = F.col("ratio").isNull() | ((F.col("ratio") > threshold) & (own == F.col("sequence_of_1st")) & (F.col("sample") == F.col("sample_of_1st")))
    return joined.where(keep).drop("ratio", "sequence_of_1st", "sample_of_1st")


def molecule_counts(reads: DataFrame, p: MoleculeParams = MoleculeParams()) -> DataFrame:
    """(sample, kind, neuron, umi, n): reads of each molecule."""
    n = reads.groupBy("sample", F.col("corrected_neuron").alias("neuron"), F.col("corrected_umi").alias("umi")).agg(F.count("*").alias("n"))
    return classify(n, p.spike_pattern, p.neuron_pattern)


def barcode_umi_counts(molecules: DataFrame, p: MoleculeParams = MoleculeParams()) -> DataFrame:
    """(sample, kind, barcode, counts): molecules of at least ``umi_cutoff`` reads."""
    return molecules.where(F.col("n") >= p.umi_cutoff).groupBy("sample", "kind", F.col("neuron").alias("barcode")).agg(F.count("*").alias("counts"))


def barcode_matrix(counts: DataFrame, samples: list[int], kind: str = "neuron") -> DataFrame:
    """Wide: a row a barcode, a column a sample of ``samples``, 0 where absent; samples outside the list are left out."""
    some = counts.where((F.col("kind") == kind) & F.col("sample").isin(samples))
    wide = some.groupBy("barcode").pivot("sample", samples).agg(F.first("counts"))
    return wide.fillna(0).withColumnsRenamed({str(s): f"s{s}" for s in samples})


def match_barcodes(counts: DataFrame, kind: str = "neuron") -> DataFrame:
    """(barcode, n_samples, total, samples): a barcode's samples by exact equality of its sequence; the counts are long already, so no join."""
    some = counts.where(F.col("kind") == kind).groupBy("barcode")
    return some.agg(F.count("*").alias("n_samples"), F.sum("counts").alias("total"), F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("samples"))


def long_matrix(counts: DataFrame, kind: str = "neuron") -> DataFrame:
    return counts.where(F.col("kind") == kind).select("barcode", "sample", F.col("counts").cast("double").alias("value"))
