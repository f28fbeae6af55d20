"""Reads that arrive run by run: demultiplexed as a stream, counted by molecule.

The batch pipeline reads finished runs. A long run can be followed while its files are written:
each micro-batch is prepared, demultiplexed and counted without state; partial counts are tables that
are added up when they are read. Error correction needs all reads and stays a batch job on the table that the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.operators import reads
from cortexloom.operators.params import ReadParams

SCHEMA = "acq_id string, read_no bigint, r1 string, r2 string"


def stream_reads(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of read pairs below ``folder``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def demultiplex_stream(raw: DataFrame, whitelist: list[tuple[int, str]], p: ReadParams = ReadParams()) -> DataFrame:
    """Prepared reads with their sample: a narrow plan, each read's tag is compared where it is."""
    prepared = reads.prepare_reads(raw, p)
    return prepared.withColumn("sample", reads.best_tag(F.col("tag"), whitelist, p.n_mismatch)).where(F.col("sample").isNotNull())


def append_molecule_counts(demultiplexed: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Counts by (sample, neuron, umi) of every micro-batch, as a table of its own below ``path``; returns the running query.

    Nothing is kept between batches, however long the run. A batch that is repeated after a failure replaces its table, so
    each read counts once; ``molecule_counts_so_far`` adds the tables up.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("sample", "neuron", "umi").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = demultiplexed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def molecule_counts_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(sample, neuron, umi, n) over the batches written by ``append_molecule_counts``."""
    return spark.read.parquet(path).groupBy("sample", "neuron", "umi").agg(F.sum("n").alias("n"))


def append_corrected_input(demultiplexed: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Write demultiplexed reads by sample, exactly once; returns the running query."""
    writer = demultiplexed.writeStream.partitionBy("sample").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.format("parquet").start(path)
