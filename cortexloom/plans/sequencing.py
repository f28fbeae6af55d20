"""Reads to barcode matrix, as one plan with the queries that show its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.operators import cluster, matrix, molecules, qc, reads
from cortexloom.operators.params import MoleculeParams, ReadParams
from cortexloom.plans.scratch import Scratch
from cortexloom.sources import fastq, fixtures, sinks
from cortexloom.sources.fixtures import SAMPLES, duck, whitelist


def demultiplexed(raw: DataFrame, tags: list, p: ReadParams = ReadParams()) -> DataFrame:
    prepared = Scratch(raw.sparkSession, "reads").save(reads.prepare_reads(raw, p), "prepared")
    return reads.demultiplex(prepared, tags, p.n_mismatch)


def corrected(raw: DataFrame, tags: list, p: ReadParams = ReadParams(), m: MoleculeParams = MoleculeParams()) -> DataFrame:
    """Demultiplexed reads with corrected neuron and UMI; each step is written, so none is worked out twice."""
    scratch = Scratch(raw.sparkSession, "reads")
    sampled = scratch.save(demultiplexed(raw, tags, p), "demultiplexed")
    fixed = scratch.save(cluster.correct_neurons(sampled), "neurons")
    return scratch.save(cluster.correct_umis(fixed, m.umi_scope), "corrected")


def resolved(fixed: DataFrame, m: MoleculeParams = MoleculeParams()) -> DataFrame:
    return molecules.resolve_template_switch(fixed, molecules.umi_switch_summary(fixed), m.template_switch_abundance)


def counts(raw: DataFrame, tags: list, p: ReadParams = ReadParams(), m: MoleculeParams = MoleculeParams()) -> DataFrame:
    """(sample, kind, barcode, counts): the whole way from read pairs."""
    return molecules.barcode_umi_counts(molecules.molecule_counts(resolved(corrected(raw, tags, p, m), m), m), m)


# ---------------------------------------------------------------- registered queries


def _demux(spark: SparkSession, d: str) -> DataFrame:
    return demultiplexed(fixtures.reads(spark, d), whitelist())


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return corrected(fixtures.reads(spark, d), whitelist())


def q_prepare_reads(spark, d):
    return reads.prepare_reads(fixtures.reads(spark, d)).select("read_no", "neuron", "umi", "tag")


def q_demultiplex(spark, d):
    return _demux(spark, d).select("read_no", "sample", "neuron", "umi")


def q_demultiplex_unmatched(spark, d):
    r = Scratch(spark, "reads").save(reads.prepare_reads(fixtures.reads(spark, d)), "prepared")
    some = [(str(s), t) for s, t in whitelist()[:5]]
    return reads.demultiplex(r, some, 0, keep_unmatched=True).groupBy("sample").agg(F.count("*").alias("n"))


def q_correct_neurons(spark, d):
    r = _demux(spark, d)
    return cluster.directional_clusters(cluster.sequence_counts(r, ["sample"], "neuron"), ["sample"], 32)


def q_correct_umis(spark, d):
    scratch = Scratch(spark, "reads")
    r = scratch.save(cluster.correct_neurons(scratch.save(_demux(spark, d), "demultiplexed")), "neurons")
    return cluster.directional_clusters(cluster.sequence_counts(r, ["sample", "corrected_neuron"], "umi"), ["sample", "corrected_neuron"], 14)


def q_correct_umis_by_sample(spark, d):
    r = _demux(spark, d)
    return cluster.directional_clusters(cluster.sequence_counts(r, ["sample"], "umi"), ["sample"], 14)


def q_correction_report(spark, d):
    sampled = Scratch(spark, "reads").save(_demux(spark, d), "demultiplexed")
    return cluster.correction_report(cluster.correct_neurons(sampled), "neuron", "corrected_neuron")


def q_umi_switch_summary(spark, d):
    return molecules.umi_switch_summary(_fixed(spark, d))


def q_shared_umis(spark, d):
    return molecules.shared_umis(molecules.umi_switch_summary(_fixed(spark, d))).select("umi", "different_neurons", F.round("ratio", 6).alias("ratio"))


def q_resolve_template_switch(spark, d):
    r = resolved(_fixed(spark, d))
    return r.groupBy("sample", "corrected_neuron", "corrected_umi").agg(F.count("*").alias("n"))


def q_molecule_counts(spark, d):
    return molecules.molecule_counts(resolved(_fixed(spark, d)))


def q_barcode_umi_counts(spark, d):
    return counts(fixtures.reads(spark, d), whitelist())


def q_barcode_matrix(spark, d):
    return molecules.barcode_matrix(counts(fixtures.reads(spark, d), whitelist()), list(range(1, SAMPLES + 2)))


def q_match_barcodes(spark, d):
    return molecules.match_barcodes(counts(fixtures.reads(spark, d), whitelist()))


def q_umi_histogram(spark, d):
    return qc.umi_histogram(molecules.umi_switch_summary(_fixed(spark, d)), "total", 30, 0.0, 3.0)


def q_neurons_per_umi(spark, d):
    return qc.neurons_per_umi(molecules.umi_switch_summary(_fixed(spark, d)))


def q_umi_composition(spark, d):
    s = qc.umi_composition(molecules.umi_switch_summary(_fixed(spark, d)))
    return s.select("umi", *[F.round(c, 6).alias(c) for c in ("ratio", "entropy", "at_share")])


def q_umi_entropy_histogram(spark, d):
    return qc.umi_2d_histogram(molecules.umi_switch_summary(_fixed(spark, d)), "entropy", 20, 2.0)


def q_umi_at_histogram(spark, d):
    return qc.umi_2d_histogram(molecules.umi_switch_summary(_fixed(spark, d)), "at_share", 15, 1.0)


def q_expected_duplicates(spark, d):
    return qc.expected_duplicates(molecules.umi_switch_summary(_fixed(spark, d)))


def q_runs_through_files(spark, d):
    """Two sequencing runs and a tube map as files: written, read, paired, united, demultiplexed, counted, and the counts written and read again."""
    scratch = Scratch(spark, "runs")
    folder, pairs = scratch.root, scratch.save(fixtures.reads(spark, d), "pairs")
    for run, odd in (("run_a", 0), ("run_b", 1)):
        sinks.write_paired_fastq(pairs.where(f"read_no % 2 = {odd}"), f"{folder}/fastq", run)
    spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey AS sample", "(n_nationkey * 7) % 11 AS tube").write.csv(f"{folder}/tubes", header=True)
    raw = fastq.union_runs(*[fastq.read_paired_fastq(spark, f"{folder}/fastq", run) for run in ("run_a", "run_b")])
    prepared = scratch.save(reads.prepare_reads(raw).select("neuron", "tag"), "prepared")
    sampled = reads.demultiplex(prepared, whitelist())
    counted = sampled.groupBy("sample", "neuron").agg(F.count("*").alias("counts"))
    p = MoleculeParams()
    sinks.write_counts(reads.classify(counted, p.spike_pattern, p.neuron_pattern).select("kind", "sample", F.col("neuron").alias("barcode"), "counts"), f"{folder}/counts")
    again = spark.read.parquet(f"{folder}/counts").where("kind = 'neuron'").select("barcode", F.col("sample").cast("int").alias("sample"), F.col("counts").alias("value"))
    kept = matrix.drop_samples(again, matrix.failed_samples(again, list(range(1, SAMPLES + 2))))
    return matrix.rename_tubes(kept, fastq.read_tube_map(spark, f"{folder}/tubes"))


_TAGS = ", ".join(f"({s}, '{t}', {i})" for i, (s, t) in enumerate(whitelist()))
_BASE = f"""
raw AS ({duck(fixtures.READS_SQL)}),
prep AS (SELECT read_no, substr(r1, 1, 32) AS neuron, substr(r2, 1, 14) AS umi, substr(r2, 15, 16) AS tag FROM raw
         WHERE substr(r1, 38, 5) = 'GCGGC' AND NOT contains(substr(r1, 1, 32) || substr(r2, 1, 30), 'N')),
tags(sample, t, ord) AS (VALUES {_TAGS}),
best AS (SELECT tag, sample FROM (SELECT tag, sample, hamming(tag, t) AS mm, row_number() OVER (PARTITION BY tag ORDER BY hamming(tag, t), ord) AS k
         FROM (SELECT DISTINCT tag FROM prep), tags) WHERE k = 1 AND mm <= 2),
demux AS (SELECT read_no, sample, neuron, umi FROM prep JOIN best USING (tag))"""


def _clusters(name: str, source: str, scope: str, seq: str) -> str:
    """CTEs ending in ``name``(scope columns, seq, n, head)."""
    s = [c.strip() for c in scope.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in s)
    cols = lambda a: ", ".join(f"{a}.{c}" for c in s)
    return f"""
{name}_c AS (SELECT {scope}, {seq} AS seq, count(*) AS n FROM {source} GROUP BY ALL),
{name}_e AS (SELECT {cols("a")}, a.seq AS src, b.seq AS dst FROM {name}_c a JOIN {name}_c b ON {on("a", "b")}
  WHERE a.seq <> b.seq AND hamming(a.seq, b.seq) = 1 AND a.n >= 2 * b.n - 1),
{name}_r AS (SELECT {scope}, seq AS src, seq AS dst FROM {name}_c
  UNION SELECT {cols("r")}, r.src, e.dst FROM {name}_r r JOIN {name}_e e ON {on("r", "e")} AND r.dst = e.src),
{name} AS (SELECT {cols("r")}, r.dst AS seq, any_value(c.n) AS n, arg_min(r.src, {{'n': -h.n, 's': r.src}}) AS head
  FROM {name}_r r JOIN {name}_c h ON {on("r", "h")} AND r.src = h.seq JOIN {name}_c c ON {on("r", "c")} AND r.dst = c.seq GROUP BY {cols("r")}, r.dst)"""


_NEURONS = f"{_BASE},{_clusters('nl', 'demux', 'sample', 'neuron')}"
_WITH_NEURON = f"""{_NEURONS},
d1 AS (SELECT d.*, nl.head AS corrected_neuron FROM demux d JOIN nl ON d.sample = nl.sample AND d.neuron = nl.seq)"""
_UMIS = f"{_WITH_NEURON},{_clusters('ul', 'd1', 'sample, corrected_neuron', 'umi')}"
_SUMMARY = f"""{_UMIS},
fixed AS (SELECT d.*, ul.head AS corrected_umi FROM d1 d JOIN ul ON d.sample = ul.sample AND d.corrected_neuron = ul.corrected_neuron AND d.umi = ul.seq),
g1 AS (SELECT corrected_umi AS umi, corrected_neuron AS neuron, sample, count(*) AS n FROM fixed GROUP BY ALL),
g2 AS (SELECT umi, neuron, sum(n) AS n, arg_max(sample, {{'n': n, 's': -sample}}) AS sample FROM g1 GROUP BY umi, neuron),
g3 AS (SELECT *, row_number() OVER (PARTITION BY umi ORDER BY n DESC, neuron) AS k FROM g2),
summary AS (SELECT umi, CAST(sum(n) AS BIGINT) AS total, count(*) AS different_neurons, CAST(max(n) FILTER (k = 1) AS BIGINT) AS first_abundant,
  CAST(coalesce(max(n) FILTER (k = 2), 0) AS BIGINT) AS second_abundant, max(neuron) FILTER (k = 1) || umi AS sequence_of_1st, max(sample) FILTER (k = 1) AS sample_of_1st
  FROM g3 GROUP BY umi)"""
_RESOLVED = f"""{_SUMMARY},
sw AS (SELECT *, first_abundant / second_abundant AS ratio FROM summary WHERE different_neurons > 1),
res AS (SELECT f.* FROM fixed f LEFT JOIN sw ON f.corrected_umi = sw.umi
  WHERE sw.umi IS NULL OR (ratio > 8 AND corrected_neuron || corrected_umi = sequence_of_1st AND f.sample = sample_of_1st)),
mol0 AS (SELECT sample, corrected_neuron AS neuron, corrected_umi AS umi, count(*) AS n FROM res GROUP BY ALL),
mol AS (SELECT *, 'spike' AS kind FROM mol0 WHERE regexp_matches(neuron, '^.{{24}}ATCAGTCA') UNION ALL SELECT *, 'neuron' FROM mol0 WHERE regexp_matches(neuron, '^.{{30}}[CT][CT]')),
cnt AS (SELECT sample, kind, neuron AS barcode, count(*) AS counts FROM mol WHERE n >= 3 GROUP BY ALL)"""
_COMPO = f"""{_SUMMARY},
ch AS (SELECT umi, first_abundant / second_abundant AS ratio, unnest(string_split(umi, '')) AS c FROM summary WHERE second_abundant > 0),
cc AS (SELECT umi, any_value(ratio) AS ratio, c, count(*) / 14.0 AS p FROM ch GROUP BY umi, c),
compo AS (SELECT umi, any_value(ratio) AS ratio, sum(-p * log2(p)) AS entropy, coalesce(sum(p) FILTER (c IN ('A', 'T')), 0) AS at_share FROM cc GROUP BY umi)"""


def _bucket(x: str, low: float, high: float, n: int) -> str:
    return f"CAST(CASE WHEN {x} < {low} THEN 0 WHEN {x} >= {high} THEN {n + 1} ELSE 1 + floor(({x} - {low}) / ({high} - {low}) * {n}) END AS INTEGER)"


W = "WITH RECURSIVE"
SQL = {
    "prepare_reads": f"{W} {_BASE} SELECT * FROM prep",
    "demultiplex": f"{W} {_BASE} SELECT * FROM demux",
    "demultiplex_unmatched": f"{W} {_BASE} SELECT coalesce(CAST(sample AS VARCHAR), 'unmatched') AS sample, count(*) AS n FROM prep LEFT JOIN (SELECT * FROM tags WHERE ord < 5) ON tag = t GROUP BY ALL",
    "correct_neurons": f"{W} {_NEURONS} SELECT sample, seq, n, head FROM nl",
    "correct_umis": f"{W} {_UMIS} SELECT sample, corrected_neuron, seq, n, head FROM ul",
    "correct_umis_by_sample": f"{W} {_BASE},{_clusters('us', 'demux', 'sample', 'umi')} SELECT sample, seq, n, head FROM us",
    "correction_report": f"{W} {_WITH_NEURON} SELECT sample, count(*) FILTER (neuron <> corrected_neuron) AS changed, count(*) AS total FROM d1 GROUP BY sample",
    "umi_switch_summary": f"{W} {_SUMMARY} SELECT * FROM summary",
    "shared_umis": f"{W} {_SUMMARY} SELECT umi, different_neurons, round(first_abundant / second_abundant, 6) AS ratio FROM summary WHERE different_neurons > 1",
    "resolve_template_switch": f"{W} {_RESOLVED} SELECT sample, neuron AS corrected_neuron, umi AS corrected_umi, n FROM mol0",
    "molecule_counts": f"{W} {_RESOLVED} SELECT sample, neuron, umi, n, kind FROM mol",
    "barcode_umi_counts": f"{W} {_RESOLVED} SELECT * FROM cnt",
    "barcode_matrix": f"{W} {_RESOLVED} SELECT barcode, {', '.join(f'CAST(coalesce(sum(counts) FILTER (sample = {s}), 0) AS BIGINT) AS s{s}' for s in range(1, SAMPLES + 2))} FROM cnt WHERE kind = 'neuron' GROUP BY barcode",
    "match_barcodes": f"{W} {_RESOLVED} SELECT barcode, count(*) AS n_samples, CAST(sum(counts) AS BIGINT) AS total, string_agg(CAST(sample AS VARCHAR), ',' ORDER BY sample) AS samples FROM cnt WHERE kind = 'neuron' GROUP BY barcode",
    "runs_through_files": f"{W} {_BASE} SELECT neuron AS barcode, CAST((n_nationkey * 7) % 11 AS INTEGER) AS sample, count(*) AS value FROM demux JOIN nation ON n_nationkey = sample WHERE regexp_matches(neuron, '^.{{30}}[CT][CT]') AND (n_nationkey * 7) % 11 <> 0 GROUP BY 1, 2",
    "umi_histogram": f"{W} {_SUMMARY} SELECT {_bucket('log10(total)', 0.0, 3.0, 30)} AS bin, count(*) AS n FROM summary GROUP BY 1",
    "neurons_per_umi": f"{W} {_SUMMARY} SELECT different_neurons, count(*) AS n, count(*) / (SELECT count(*) FROM summary) AS share FROM summary GROUP BY 1",
    "umi_composition": f"{W} {_COMPO} SELECT umi, round(ratio, 6) AS ratio, round(entropy, 6) AS entropy, round(CAST(at_share AS DOUBLE), 6) AS at_share FROM compo",
    "umi_entropy_histogram": f"{W} {_COMPO} SELECT {_bucket('entropy', 0.0, 2.0, 20)} AS bin, {_bucket('ratio', 0.0, 200.0, 20)} AS ratio_bin, count(*) AS n FROM compo GROUP BY 1, 2",
    "umi_at_histogram": f"{W} {_COMPO} SELECT {_bucket('CAST(at_share AS DOUBLE)', 0.0, 1.0, 15)} AS bin, {_bucket('ratio', 0.0, 200.0, 20)} AS ratio_bin, count(*) AS n FROM compo GROUP BY 1, 2",
    "expected_duplicates": f"{W} {_SUMMARY} SELECT count(*) AS n_umis, count(*) / 268435456.0 AS expected_duplicates FROM summary",
}
QUERIES = {name: globals()[f"q_{name}"] for name in SQL}
