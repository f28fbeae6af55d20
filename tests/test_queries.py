"""Every registered query with SQL, against DuckDB on the smallest tables; the others run and keep their schema."""

import math

import pytest

from cortexloom import registry

#: Heavy plans that others contain are left to the driver's own comparison.
SLOW = {"shared_umis", "umi_histogram", "neurons_per_umi", "umi_composition", "umi_entropy_histogram", "umi_at_histogram", "expected_duplicates", "molecule_counts", "barcode_umi_counts", "resolve_template_switch"}


def norm(v):
    return ("nan" if math.isnan(v) else round(v, 8)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in registry.SQL if n not in SLOW])
def test_query(spark, duck, sf, name):
    ours = registry.QUERIES[name](spark, sf)
    theirs = duck.sql(registry.SQL[name])
    names, cols = [d[0] for d in theirs.description], sorted(ours.columns)
    assert sorted(names) == cols
    a = sorted([tuple(map(norm, r)) for r in ours.select(cols).collect()], key=repr)
    b = sorted([tuple(norm(r[names.index(c)]) for c in cols) for r in theirs.fetchall()], key=repr)
    assert a == b


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_query_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns[0] == "barcode" and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
