"""Inputs of the registered queries, derived by Spark from the given tables.

Reads, a barcode matrix, voxels, structures and sections are functions of ``lineitem`` and small
dimension tables, so every query's work grows with them and DuckDB can derive equal rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ACGTACGTACGTACGT"
SAMPLES = 7

MOLECULES_SQL = """
WITH m AS (SELECT l_orderkey ok, l_linenumber ln, l_partkey pk,
  CASE WHEN l_orderkey % 53 = 0 THEN (l_partkey + 1) % 60 ELSE l_partkey % 60 END AS nid,
  translate(md5(concat('u', CAST(l_partkey AS string))), '0123456789abcdef', 'ACGTACGTACGTACGT') uh,
  translate(md5(concat('t', CAST(1 + l_partkey % 7 AS string))), '0123456789abcdef', 'ACGTACGTACGTACGT') th FROM {lineitem}),
n AS (SELECT *, translate(md5(concat('n', CAST(nid AS string))), '0123456789abcdef', 'ACGTACGTACGTACGT') nh FROM m),
s AS (SELECT ok, ln, pk, CASE WHEN nid % 20 = 0 THEN concat(substr(nh, 1, 24), 'ATCAGTCA') ELSE concat(substr(nh, 1, 30), 'CT') END neuron0,
  substr(uh, 1, 14) umi0, substr(th, 1, 16) tag0 FROM n)
SELECT * FROM s
"""

ERRORS_SQL = """
WITH e AS (SELECT ok, ln, tag0,
  CASE WHEN ok % 29 = 0 THEN concat(substr(neuron0, 1, CAST(ok % 24 AS int)), translate(substr(neuron0, CAST(ok % 24 AS int) + 1, 1), 'ACGT', 'CGTA'), substr(neuron0, CAST(ok % 24 AS int) + 2)) ELSE neuron0 END neuron1,
  CASE WHEN ok % 31 = 0 THEN concat(substr(umi0, 1, CAST(ok % 14 AS int)), translate(substr(umi0, CAST(ok % 14 AS int) + 1, 1), 'ACGT', 'CGTA'), substr(umi0, CAST(ok % 14 AS int) + 2)) ELSE umi0 END umi1 FROM {molecules})
SELECT ok * 10 + ln AS read_no,
  concat(CASE WHEN ok % 97 = 0 THEN concat('N', substr(neuron1, 2)) ELSE neuron1 END, 'AAAAA', CASE WHEN ok % 37 = 0 THEN 'GCGGA' ELSE 'GCGGC' END, 'TTTT') AS r1,
  concat(umi1, CASE WHEN ok % 41 = 0 THEN concat(translate(substr(tag0, 1, 1), 'ACGT', 'CGTA'), substr(tag0, 2)) ELSE tag0 END, 'GG') AS r2 FROM e
"""

READS_SQL = ERRORS_SQL.replace("{molecules}", f"({MOLECULES_SQL}) s")

MATRIX_SQL = """
SELECT l_partkey AS barcode, 1 + CAST((CASE WHEN l_orderkey % 3 > 0 THEN l_partkey ELSE l_suppkey END) % 12 AS int) AS sample,
  sum(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2
"""

VOXELS_SQL = """
SELECT DISTINCT CAST(1 + l_partkey % 12 AS int) x, CAST(1 + l_suppkey % 10 AS int) y, CAST(1 + l_orderkey % 16 AS int) z,
  CAST(1 + floor((l_partkey % 12) / 4.0) + 3 * floor((l_suppkey % 10) / 4.0) + 9 * floor((l_orderkey % 16) / 6.0) AS int) label
FROM {lineitem} WHERE l_orderkey % 5 > 0 AND (l_partkey % 12 * 7 + l_suppkey % 10 * 3 + l_orderkey % 16) % 5 > 0
"""

STRUCTURES_SQL = """
SELECT 2000 + CAST(n_nationkey AS int) id, concat(n_name, CASE WHEN n_nationkey % 3 = 0 THEN '6a' WHEN n_nationkey % 3 = 1 THEN '2' ELSE '' END) acronym, array(997, 1000 + CAST(n_regionkey AS int), 2000 + CAST(n_nationkey AS int)) structure_id_path FROM {nation}
UNION ALL SELECT 1000 + CAST(r_regionkey AS int), r_name, array(997, 1000 + CAST(r_regionkey AS int)) FROM {region}
UNION ALL SELECT 997, 'root', array(997)
"""

SECTIONS_SQL = """
SELECT CAST(s_suppkey AS int) section, 12 width, 9 height,
  array(200.0 + s_suppkey % 5, 100.0 + 4 * s_suppkey, 100.0 + s_suppkey % 3, 100.0, 0.0, 1.0 * (s_suppkey % 2), 0.0, 1.0, -100.0) anchoring,
  array(array(2.0 + s_suppkey % 2, 2.0, 2.0, 2.0), array(8.0, 3.0 + s_suppkey % 3, 8.5, 2.5), array(3.0, 6.0, 3.0, 6.5 - s_suppkey % 2), array(9.0, 7.0, 8.75, 6.25)) markers
FROM {supplier}
"""


def whitelist() -> list[tuple[int, str]]:
    """Tags of samples 1 to 7."""
    code = str.maketrans("0123456789abcdef", LETTERS)
    return [(i, hashlib.md5(f"t{i}".encode()).hexdigest().translate(code)[:16]) for i in range(1, SAMPLES + 1)]


def _derive(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pairs with errors, switches, spikes and N: one a ``lineitem`` row."""
    lines, cores = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey"), spark.sparkContext.defaultParallelism
    if lines.rdd.getNumPartitions() < cores:  # a table of fewer splits than cores
        lines = lines.repartition(cores)
    molecules = spark.sql(MOLECULES_SQL, lineitem=lines)
    once = molecules.select(F.explode(F.array(F.struct("*"))).alias("x")).select("x.*")  # else its hashes are worked out again for every use
    return spark.sql(ERRORS_SQL, molecules=once)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(barcode, sample, value) of 12 samples, one dominant for each barcode."""
    return _derive(spark, sf_dir, MATRIX_SQL, "lineitem")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, label): 27 labels in a block with holes."""
    return _derive(spark, sf_dir, VOXELS_SQL, "lineitem")


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, acronym, structure_id_path): nations below regions below a root."""
    return _derive(spark, sf_dir, STRUCTURES_SQL, "nation", "region")


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, structure_id) of the voxels."""
    v = voxels(spark, sf_dir)
    return v.selectExpr("x", "y", "z", "2000 + (x * 5 + y * 3 + z + label) % 25 AS structure_id")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, width, height, anchoring, markers), one a supplier."""
    return _derive(spark, sf_dir, SECTIONS_SQL, "supplier")


def duck(sql: str) -> str:
    """The same derivation for DuckDB, where tables are views of their own names and arrays are lists."""
    out = sql.replace("array(", "list_value(").replace("AS string", "AS varchar")
    for t in ("lineitem", "nation", "region", "supplier"):
        out = out.replace(f"{{{t}}}", t)
    return out
