"""Directional one-mismatch clustering of sequences inside scopes.

With rank = (count descending, sequence ascending), a sequence's head is the lowest-ranked
sequence that reaches it along edges a -> b, where a and b differ in one position and
n_a >= 2 n_b - 1. Edges into counts above 1 at least halve the count, so labels settle in about
log2(largest count) rounds; sequences of count 1 reach each other both ways, so they form
connected components, which take the lowest label of their members and parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortexloom.functions.sequences import masked_keys
from cortexloom.operators.components import connected_components
from cortexloom.plans.scratch import Scratch


def sequence_counts(reads: DataFrame, scope: list[str], seq: str) -> DataFrame:
    """(scope, seq, n): reads by distinct sequence; everything after works on these."""
    return reads.groupBy(*scope, F.col(seq).alias("seq")).agg(F.count("*").alias("n"))


def hamming1_edges(nodes: DataFrame, length: int) -> DataFrame:
    """(src, dst) node ids at distance 1 in one scope with n_src >= 2 n_dst - 1, by equi-join on masked keys.

    ``nodes``: id, scope_key, seq, n. Two sequences share a masked key exactly if they differ at
    most there, so no verification follows and a key holds at most one row a letter. The keys are
    ``length`` rows a node, which estimates from the table's size leave out: they are merged, never broadcast.
    """
    keyed = nodes.select("id", "scope_key", "n", F.explode(masked_keys(F.col("seq"), length)).alias("k"))
    keyed = keyed.select("id", "n", F.xxhash64("scope_key").alias("s"), "scope_key", F.col("k.pos").alias("pos"), F.col("k.rest").alias("rest"))
    a, b = keyed.alias("a"), keyed.alias("b")
    same = (F.col("a.s") == F.col("b.s")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.scope_key") == F.col("b.scope_key"))
    joined = a.join(b.hint("merge"), same & (F.col("a.id") != F.col("b.id")) & (F.col("a.n") >= 2 * F.col("b.n") - 1))
    return joined.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("b.n").alias("n_dst"))


def _rank(n: Column, seq: Column) -> Column:
    return F.struct((-n).alias("r"), seq.alias("q"))


def directional_clusters(counts: DataFrame, scope: list[str], length: int, max_rounds: int = 64) -> DataFrame:
    """(scope, seq, n, head) for ``counts`` (scope, seq, n)."""
    scratch = Scratch(counts.sparkSession, "cluster")
    key = F.concat_ws("\x1f", *scope) if scope else F.lit("")
    nodes = scratch.save(counts.select(*scope, "seq", "n", key.alias("scope_key"), F.concat_ws("\x1e", key, "seq").alias("id")), "nodes")
    edges = scratch.save(hamming1_edges(nodes, length), "edges")
    own = nodes.select("id", _rank(F.col("n"), F.col("seq")).alias("label"))
    down = edges.where("n_dst > 1").select("src", "dst")
    label = scratch.save(own, "labels")
    for _ in range(max_rounds):
        offered = down.join(label, F.col("src") == F.col("id")).groupBy("dst").agg(F.min("label").alias("better"))
        after = label.join(offered, F.col("id") == F.col("dst"), "left").select("id", F.least("label", "better").alias("label"), (F.col("better") < F.col("label")).alias("moved"))
        after = scratch.save(after, "labels")
        moved = after.where("moved").limit(1).count()
        label = after.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError(f"labels did not settle in {max_rounds} rounds")
    # Count 1: components of single reads, offered their parents' labels.
    single = nodes.where("n = 1").select("id")
    into = edges.where("n_dst = 1").select("src", "dst")
    among = into.join(single, F.col("src") == F.col("id"), "left_semi")
    comp = connected_components(among).withColumnsRenamed({"node": "id", "component": "comp"})
    ones = scratch.save(single.join(comp, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "ones")
    offers = (
        into.join(label, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "label")
        .unionByName(label.join(single, "id", "left_semi"))
        .join(ones, "id").groupBy("comp").agg(F.min("label").alias("label"))
    )
    heads = ones.join(offers, "comp").select("id", "label").unionByName(label.join(single, "id", "left_anti"))
    return nodes.join(heads, "id").select(*scope, "seq", "n", F.col("label.q").alias("head"))


def apply_correction(reads: DataFrame, labels: DataFrame, scope: list[str], seq: str, out: str) -> DataFrame:
    """``out``: the head of every read's sequence."""
    heads = labels.select(*scope, F.col("seq").alias(seq), F.col("head").alias(out))
    return reads.join(heads, [*scope, seq])


def correct(reads: DataFrame, scope: list[str], seq: str, out: str, length: int) -> DataFrame:
    return apply_correction(reads, directional_clusters(sequence_counts(reads, scope, seq), scope, length), scope, seq, out)


def correct_neurons(reads: DataFrame, length: int = 32) -> DataFrame:
    """``corrected_neuron``, clustered inside each sample."""
    return correct(reads, ["sample"], "neuron", "corrected_neuron", length)


def correct_umis(reads: DataFrame, umi_scope: str = "neuron", length: int = 14) -> DataFrame:
    """``corrected_umi``, clustered inside each corrected neuron of a sample, or inside the sample."""
    if umi_scope not in ("neuron", "sample"):
        raise ValueError(f"umi_scope is {umi_scope!r}; it can be neuron or sample")
    return correct(reads, ["sample", "corrected_neuron"] if umi_scope == "neuron" else ["sample"], "umi", "corrected_umi", length)


def correction_report(reads: DataFrame, seq: str, corrected: str) -> DataFrame:
    """Reads changed and all reads, by sample."""
    return reads.groupBy("sample").agg(F.count_if(F.col(seq) != F.col(corrected)).alias("changed"), F.count("*").alias("total"))
