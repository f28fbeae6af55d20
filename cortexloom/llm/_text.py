"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return. ``bytes.split()`` splits at the same six.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(of)


def held_out(doc_id: Column | str, of: int) -> Column:
    """True where the remainder is 0; a null id is not held out."""
    return F.coalesce(remainder(doc_id, of) == 0, F.lit(False))


def to_learn(doc_id: Column | str, of: int) -> Column:
    """True where a row may be learned from: the remainder is known and not 0."""
    return F.coalesce(remainder(doc_id, of) != 0, F.lit(False))


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def lower_words(text: bytes | None) -> list[bytes]:
    """The words of a text after A-Z are lower-cased; none for null."""
    return text.lower().split() if text else []


def pieces(batches: Iterable[pa.RecordBatch], max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size, so that long texts do not pile up in a task."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, max_bytes // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet."""
    while base in df.columns:
        base += "_"
    return base
