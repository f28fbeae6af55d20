"""From read pairs to demultiplexed reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortexloom.functions.sequences import hamming, segment
from cortexloom.operators.params import ReadParams
from cortexloom.plans.scratch import Scratch

#: Distinct inexact tags (two short strings each) up to which their samples are broadcast.
BROADCAST_TAGS = 500_000


def pair_mates(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Mates by (acq_id, read_no); reads without a mate are dropped."""
    return r1.join(r2, ["acq_id", "read_no"])


def filter_consensus(reads: DataFrame, p: ReadParams = ReadParams()) -> DataFrame:
    """Pairs whose uncropped R1 holds the consensus at its place."""
    return reads.where(segment("r1", *p.consensus_pos) == p.consensus_seq)


def crop_concat(reads: DataFrame, p: ReadParams = ReadParams()) -> DataFrame:
    """``full_read``: the cropped mates in a row; a crop of None keeps a whole mate."""
    part = lambda c, crop: F.col(c) if crop is None else segment(c, *crop)
    return reads.withColumn("full_read", F.concat(F.trim(part("r1", p.r1_crop)), F.trim(part("r2", p.r2_crop))))


def drop_n_reads(reads: DataFrame) -> DataFrame:
    return reads.where(~F.contains("full_read", F.lit("N")))


def split_segments(reads: DataFrame, p: ReadParams = ReadParams()) -> DataFrame:
    """neuron, umi and tag of ``full_read``; the tag is at its end."""
    tag = F.substring("full_read", -p.tag_length, p.tag_length)
    return reads.withColumns({"neuron": segment("full_read", *p.neuron), "umi": segment("full_read", *p.umi), "tag": tag})


def prepare_reads(reads: DataFrame, p: ReadParams = ReadParams()) -> DataFrame:
    """Consensus, crop, N filter and segments: one narrow stage."""
    return split_segments(drop_n_reads(crop_concat(filter_consensus(reads, p), p)), p).drop("r1", "r2")


def best_tag(tag: Column, whitelist: list[tuple[str, str]], n_mismatch: int) -> Column:
    """The whitelisted sample with the fewest mismatches (the first of equals), null beyond ``n_mismatch``."""
    length = len(whitelist[0][1])
    known = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, (s, t) in enumerate(whitelist)])
    scored = F.transform(known, lambda k: F.struct(hamming(tag, k["t"], length).alias("mm"), k["i"].alias("i"), k["s"].alias("s")))
    best = F.array_min(scored)
    return F.when((best["mm"] <= n_mismatch) & (F.length(tag) == length), best["s"])


def tag_samples(tags: DataFrame, whitelist: list[tuple[str, str]], n_mismatch: int) -> DataFrame:
    """(tag, sample) of the distinct tags that come within ``n_mismatch`` of a whitelisted one, worked out once for each."""
    scratch = Scratch(tags.sparkSession, "tags")
    distinct = scratch.save(tags.distinct(), "distinct")
    return scratch.save(distinct.select("tag", best_tag(F.col("tag"), whitelist, n_mismatch).alias("sample")).where("sample is not null"), "samples")


def demultiplex(reads: DataFrame, whitelist: list[tuple[str, str]], n_mismatch: int = 2, keep_unmatched: bool = False) -> DataFrame:
    """``sample`` of every read by its tag.

    Exact tags are looked up in the row. Other tags are few: their samples are worked out once per
    distinct tag and written, and come back by one join, a broadcast where their number allows it.
    ``reads`` is read twice, so hand in a written table.
    """
    exact = F.create_map(*[x for s, t in whitelist for x in (F.lit(t), F.lit(s))])
    direct = reads.withColumn("_exact", F.try_element_at(exact, F.col("tag")))
    known = tag_samples(direct.where(F.col("_exact").isNull()).select("tag"), whitelist, n_mismatch)
    known = F.broadcast(known) if known.count() <= BROADCAST_TAGS else known
    key = F.when(F.col("_exact").isNull(), F.col("tag"))  # the few exact tags, which most reads have, are no join keys
    found = direct.withColumn("_key", key).join(known.withColumnRenamed("tag", "_key"), "_key", "left")
    out = found.withColumn("sample", F.coalesce("_exact", "sample")).drop("_exact", "_key")
    return out.withColumn("sample", F.coalesce("sample", F.lit("unmatched"))) if keep_unmatched else out.where(F.col("sample").isNotNull())


def classify(molecules: DataFrame, spike_pattern: str, neuron_pattern: str, col: str = "neuron") -> DataFrame:
    """``kind`` spike or neuron by pattern; a row that fits both comes twice, one that fits none is dropped."""
    kinds = F.array_compact(F.array(F.when(F.col(col).rlike(spike_pattern), F.lit("spike")), F.when(F.col(col).rlike(neuron_pattern), F.lit("neuron"))))
    return molecules.withColumn("kind", F.explode(kinds))
