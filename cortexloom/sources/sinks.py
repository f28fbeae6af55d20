"""Sinks. Every writer takes ``overwrite``: without it, an existing target is an error."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_corrected(corrected: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder a sample; overwriting replaces only the samples that are written."""
    corrected.write.mode(_mode(overwrite)).option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(path)


def write_reused(df: DataFrame, path: str, overwrite: bool = True) -> DataFrame:
    """Write, or with ``overwrite=False`` reuse what is there, and read."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if overwrite or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_counts(counts: DataFrame, path: str, overwrite: bool = False) -> None:
    counts.write.mode(_mode(overwrite)).partitionBy("kind", "sample").parquet(path)


def write_matrix(matrix: DataFrame, path: str, overwrite: bool = False) -> None:
    """The long matrix, sorted by barcode within files."""
    matrix.sortWithinPartitions("barcode", "sample").write.mode(_mode(overwrite)).parquet(path)


def write_dense_matrices(bc: DataFrame, source_samples: list[int], path: str, overwrite: bool = False) -> None:
    """``with_source`` and ``without_source`` below ``path``: a row a barcode, a column a sample, zeros filled in.

    Samples without any count are left out (their transcription failed). The matrix is worked out once; the one without the source
    samples is read from the first one's other columns and keeps all its barcodes.
    """
    samples = sorted(r[0] for r in bc.where("value <> 0").select("sample").distinct().collect())  # those of a plate
    wide = bc.groupBy("barcode").pivot("sample", samples).agg(F.sum("value")) if samples else bc.select("barcode").distinct()
    wide = wide.select("barcode", *[F.coalesce(F.col(f"`{s}`").cast("double"), F.lit(0.0)).alias(f"s{s}") for s in samples])
    wide.write.mode(_mode(overwrite)).parquet(f"{path}/with_source")
    left = bc.sparkSession.read.parquet(f"{path}/with_source").drop(*[f"s{s}" for s in source_samples])
    left.write.mode(_mode(overwrite)).parquet(f"{path}/without_source")


#: Reads of a FASTQ file, as sequencers' software cuts them.
FASTQ_READS = 4_000_000


def write_paired_fastq(pairs: DataFrame, folder: str, acq_id: str, file_reads: int = FASTQ_READS) -> None:
    """(read_no, r1, r2) as ``{acq_id}_R1.fastq.gz`` and ``{acq_id}_R2.fastq.gz``, in the order of ``read_no``; qualities are made up.

    Runs of more than ``file_reads`` are cut into numbered parts, ``{acq_id}_R1_00001.fastq.gz`` and so on, of about so many reads each: a task
    writes a part of both mates. Pairs are sorted as wholes, so mates stay together where ``read_no`` is shared. ``pairs`` is
    read three times, so hand in a written table.
    """
    jvm = pairs.sparkSession.sparkContext._jvm
    key, part = ["read_no", "r1", "r2"], f"{folder}/.{uuid.uuid4().hex}"
    parts = max(1, math.ceil(pairs.count() / file_reads))
    own = pairs.select(*key).repartitionByRange(parts, *key) if parts > 1 else pairs.select(*key).repartition(1)
    each = own.withColumn("mate", F.explode(F.array(F.lit("R1"), F.lit("R2"))))
    sequence = F.when(F.col("mate") == "R1", F.col("r1")).otherwise(F.col("r2"))
    record = F.concat_ws("\n", F.concat(F.lit(f"@{acq_id}:"), F.col("read_no").cast("string")), sequence, F.lit("+"), F.repeat(F.lit("I"), F.length(sequence)))
    each.sortWithinPartitions("mate", *key).select("mate", record.alias("value")).write.partitionBy("mate").option("compression", "gzip").text(part)
    at = jvm.org.apache.hadoop.fs.Path(part)
    files = at.getFileSystem(pairs.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for mate in ("R1", "R2"):
        if not files.exists(jvm.org.apache.hadoop.fs.Path(f"{part}/mate={mate}")):  # a run without reads
            own.limit(0).select("r1").write.option("compression", "gzip").text(f"{part}/mate={mate}")
        written = sorted((f.getPath() for f in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{part}/mate={mate}/part-*")) or []), key=lambda f: f.getName())
        for k, f in enumerate(written, 1):
            files.rename(f, jvm.org.apache.hadoop.fs.Path(f"{folder}/{acq_id}_{mate}{f'_{k:05d}' if len(written) > 1 else ''}.fastq.gz"))
    files.delete(at, True)


def collate_null_stats(spark: SparkSession, parts: str, target: str, name: str, overwrite: bool = True) -> str | None:
    """All tables ``{name}*`` in the folder ``parts`` as one, ``{name}_collated`` in ``target``; returns its path, or None if there are none.

    Without ``overwrite`` the first free of ``{name}_collated``, ``{name}_collated_2``, .. is taken, by a rename that fails
    where the name exists, so runs at the same time get names of their own. The parts are removed only after that.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    files = hadoop.Path(parts).getFileSystem(conf)
    found = [f.getPath() for f in files.globStatus(hadoop.Path(f"{parts}/{name}*")) or []]
    if not found:
        return None
    out = hadoop.Path(target).getFileSystem(conf)
    fresh = hadoop.Path(f"{target}/.{uuid.uuid4().hex}")
    spark.read.parquet(*[f.toString() for f in found]).write.parquet(fresh.toString())
    context = hadoop.FileContext.getFileContext(out.getUri(), conf)
    never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    never[0] = getattr(hadoop, "Options$Rename").NONE
    n = 1
    while True:
        path = hadoop.Path(f"{target}/{name}_collated" + (f"_{n}" if n > 1 else ""))
        if overwrite:
            out.delete(path, True)
        try:
            context.rename(fresh, path, never)
            break
        except Exception:
            if overwrite or not out.exists(path):
                raise
            n += 1
    for f in found:
        files.delete(f, True)
    return path.toString()


def write_null_stats(stats: DataFrame, path: str, run_id: int, overwrite: bool = True) -> None:
    """A run's statistics below ``run_id=``; overwriting replaces this run only."""
    rows = stats.withColumn("run_id", F.lit(run_id))
    writer = rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    writer.mode("overwrite" if overwrite else "append").parquet(path)


def combine_mice(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several mice, one under the other, with a ``mouse`` column."""
    out = None
    for mouse, df in tables.items():
        one = df.withColumn("mouse", F.lit(mouse))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no table is given")
    return out
