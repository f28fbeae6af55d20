"""Column functions on nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment(c: Column | str, start: int, end: int) -> Column:
    """Characters [start, end), counted from 0."""
    return F.substring(c, start + 1, end - start)


def hamming(a: Column, b: Column, length: int) -> Column:
    """Number of differing positions of two sequences of ``length`` characters; an N differs from all but N."""
    step = lambda acc, i: acc + F.when(F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)), 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.lit(0), step)


def char_count(s: Column, c: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))


def shannon_entropy(s: Column, alphabet: str = "ACGT") -> Column:
    """Entropy in bits of a sequence's characters."""
    total = F.lit(0.0)
    for c in alphabet:
        p = char_count(s, c) / F.length(s)
        total = total + F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    return total


def at_content(s: Column) -> Column:
    return (char_count(s, "A") + char_count(s, "T")) / F.length(s)


def masked_keys(s: Column, length: int) -> Column:
    """(position, sequence without that position) for every position: equal keys of two sequences mean at most one mismatch."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.struct(i.alias("pos"), F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)).alias("rest")))


def relative_abundance(first: Column, second: Column) -> Column:
    """first / second, null where there is no second."""
    return first / F.nullif(second, F.lit(0))


def sample_number(name: Column) -> Column:
    """The number in a sample name or path such as BC12 or corrected_BC12.csv."""
    return F.regexp_extract(name, r"BC(\d+)", 1).try_cast("int")


def section_label(section: Column) -> Column:
    """A section number with zeros to three digits; longer numbers stay whole."""
    n = section.cast("string")
    return F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0"))


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws(", ", a, b)


def list_literal(s: Column, kind: str = "string") -> Column:
    """A list written as text, with single or double quotes, as an array."""
    return F.from_json(F.translate(s, "'", '"'), f"array<{kind}>")
