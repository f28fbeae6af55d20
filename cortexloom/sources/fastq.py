"""Paired reads, tag whitelists and per-sample tables as sources."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cortexloom.functions.sequences import list_literal


#: Read numbers of a run's later parts begin at multiples of this.
PART = 1 << 40


def _mate(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """(read_no, sequence) of a mate's files, in the order of its parts.

    A gz file is read by one task, from its first line to its last, so lines are counted in the Arrow batches as they come.
    A task may read several files, one after the other.
    """
    part = {p.rsplit("/", 1)[1]: k for k, p in enumerate(paths)}

    def second_lines(batches):
        now, line = None, 0
        for b in batches:
            files, values, at = b.column(0), b.column(1), 0
            while at < b.num_rows:
                if (file := files[at].as_py()) != now:
                    now, line = file, 0
                rest = files.slice(at)
                n = len(rest) if rest[-1].as_py() == now else pc.index(pc.not_equal(rest, now), True).as_py()
                take = np.arange(at + (1 - line) % 4, at + n, 4)
                yield pa.RecordBatch.from_arrays([pa.array(part[now] * PART + (line + take - at) // 4), values.take(pa.array(take))], ["read_no", name])
                at, line = at + n, line + n

    lines = spark.read.text(paths).select("_metadata.file_name", "value")
    return lines.mapInArrow(second_lines, f"read_no bigint, {name} string").withColumn(name, F.trim(name))


def _parts(files: list[str]) -> dict[str, str]:
    """Files by the number of their part; more than one only if their names differ in that number alone."""
    stems = {re.sub(r"_\d+(?=\.fastq\.gz$)", "", f) for f in files}
    numbers = [re.search(r"(?:_(\d+))?\.fastq\.gz$", f)[1] or "" for f in files]
    if len(files) > 1 and (len(stems) > 1 or "" in numbers):
        return {}
    return dict(zip(numbers, files))


def _files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def read_paired_fastq(spark: SparkSession, folder: str, acq_id: str | list[str], partitions: int | None = None) -> DataFrame:
    """(acq_id, read_no, r1, r2) of one or more sequencing runs.

    Each run must have exactly one file named R1 and one named R2 among ``{acq_id}*.fastq.gz``, or numbered parts of
    one (``.._001.fastq.gz`` and so on), the same for both mates; else ValueError. Mates are paired by their place in the file;
    the shorter file decides.
    """
    runs = None
    for acq in [acq_id] if isinstance(acq_id, str) else acq_id:
        mates = {}
        for mate in ("R1", "R2"):
            found = [f for f in _files(spark, folder, f"{acq}*.fastq.gz") if mate in f.rsplit("/", 1)[1]]
            mates[mate] = _parts(found)
            if not mates[mate]:
                raise ValueError(f"{acq}: {len(found)} files with {mate} in {folder}, expected one or its parts")
        if len(mates["R1"]) > 1 or len(mates["R2"]) > 1:
            if alone := sorted(mates["R1"].keys() ^ mates["R2"].keys()):
                raise ValueError(f"{acq}: parts {', '.join(alone)} of R1 or R2 have no other mate in {folder}")
        one = [_mate(spark, [mates[m][k] for k in sorted(mates[m], key=lambda k: int(k or 0))], m.lower()) for m in ("R1", "R2")]
        both = one[0].join(one[1].hint("merge"), "read_no").select(F.lit(acq).alias("acq_id"), "read_no", "r1", "r2")
        runs = both if runs is None else runs.unionByName(both)
    if runs is None:
        raise ValueError("no sequencing run is given")
    return runs.repartition(partitions) if partitions else runs


def read_tags(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(sample, tag) in file order of a tab-separated whitelist."""
    rows = spark.read.csv(path, sep="\t", schema="sample string, tag string").withColumn("ord", F.monotonically_increasing_id())
    return [(r["sample"], r["tag"]) for r in rows.orderBy("ord").collect()]  # one row a sample


def union_runs(*runs: DataFrame) -> DataFrame:
    """All reads of several runs, with repeats; columns that a run lacks are null."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def read_corrected(spark: SparkSession, path: str) -> DataFrame:
    """Corrected reads: a Parquet table partitioned by sample, or corrected_BC*.csv files."""
    if not _files(spark, path, "*.csv"):
        return spark.read.parquet(path)
    rows = spark.read.csv(f"{path}/corrected_BC*.csv", header=True)
    return rows.withColumn("sample", F.regexp_extract(F.input_file_name(), r"BC(\d+)", 1).try_cast("int"))


def read_switch_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All template-switch chunk tables, with the chunk's number."""
    rows = spark.read.csv(f"{path}/template_switching_chunk_*.csv", header=True, inferSchema=False)
    return rows.withColumn("chunk", F.regexp_extract(F.input_file_name(), r"chunk_(\d+)", 1).try_cast("int"))


def read_tube_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="sample int, tube int")


def read_roi_regions(spark: SparkSession, path: str) -> DataFrame:
    """(roi, area, fraction): region lists of a text table, written as list literals, one row an entry."""
    rows = spark.read.csv(path, header=True, schema="roi int, volume_um3 double, regions string, breakdown string", escape='"')
    pair = F.explode(F.arrays_zip(list_literal(F.col("regions")).alias("area"), list_literal(F.col("breakdown"), "double").alias("fraction")))
    return rows.select("roi", "volume_um3", pair.alias("p")).select("roi", "volume_um3", F.col("p.area").alias("area"), F.col("p.fraction").alias("fraction"))


SECTIONS = "slices array<struct<filename: string, anchoring: array<double>, markers: array<array<double>>, height: int, width: int>>"


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, anchoring, markers, height, width) of registration JSON files."""
    rows = spark.read.json(path, multiLine=True, schema=SECTIONS).select(F.explode("slices").alias("s")).select("s.*")
    name = F.regexp_replace("filename", r"\.jpe?g$", "")
    return rows.select(name.alias("name"), F.regexp_extract(name, r"s(\d+)", 1).try_cast("int").alias("section"), "anchoring", "markers", "height", "width")


def read_mask_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(section, tube, px, py) of the lit pixels of mask images; names hold the section number and TUBE<n>."""
    import numpy as np

    images = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def lit(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                on = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).max(axis=2) > 0
                py, px = np.nonzero(on)
                import pandas as pd

                yield pd.DataFrame({"origin": r.origin, "px": px.astype("int32"), "py": py.astype("int32")})

    pixels = images.mapInPandas(lit, T.StructType([T.StructField("origin", T.StringType()), T.StructField("px", T.IntegerType()), T.StructField("py", T.IntegerType())]))
    file = F.regexp_extract("origin", r"([^/]+)$", 1)
    return pixels.select(F.regexp_extract(file, r"^\D?(\d+)", 1).try_cast("int").alias("section"), F.regexp_extract(file, r"TUBE(\d+)", 1).try_cast("int").alias("tube"), "px", "py")


def read_voxels(spark: SparkSession, path: str, value: str = "label") -> DataFrame:
    """A sparse volume: (x, y, z, value) without the zeros."""
    return spark.read.parquet(path).where(F.col(value) != 0)
