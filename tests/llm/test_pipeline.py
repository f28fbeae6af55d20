"""The corpus pipeline, stage by stage, against brute force on the small tables."""

import collections
import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cortexloom.llm import line_dedup, mixing, queries, sentencepiece_codec

from test_operators import CASES, SCHEMA, brute_components, brute_fingerprint, brute_lines


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = pipeline.quality(spark, docs, sf).cache()
    assert kept.columns == names and 0 < kept.count() < docs.count()

    deduped = pipeline.lines(spark, kept, sf).cache()
    want = {i: t for i, t in brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()]).items() if t.split()}
    assert {r["doc_id"]: r["text"] for r in deduped.collect()} == want and deduped.columns == names

    single = pipeline.near_duplicates(spark, deduped, sf).cache()
    ids = sorted(want)
    roots = brute_components([brute_fingerprint(want[i]) for i in ids], 3)
    assert sorted(r["doc_id"] for r in single.collect()) == [i for k, i in enumerate(ids) if roots[k] == k] and single.columns == names

    mixed = pipeline.mixture(spark, single, sf).cache()
    assert mixed.columns == names
    n = collections.Counter(r["doc_id"] for r in mixing.mix(single, mixing.WEIGHTS, other=mixing.OTHER, seed=mixing.SEED).collect())
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == n

    out = pipeline.tokens(spark, mixed, sf)
    lib = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes()).library
    assert all(r["ids"] == lib.encode(want[r["doc_id"]]) and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out.collect())


def test_run_gives_the_rows_of_the_last_stage(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"] and out.where("not round_trip").count() == 0


def test_stages_on_odd_rows(spark, sf):
    for df in (spark.createDataFrame(CASES, SCHEMA), spark.createDataFrame([], SCHEMA)):
        df = df.withColumn("_gone", F.lit(1)).withColumn("goes", F.lit(2))
        for name, stage in pipeline.STAGES:
            df = stage(spark, df, sf).cache()
            df.count()


def test_registration():
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n in entry.queries() if n.startswith("op")] and len(pipeline.STAGES) == 5
    assert line_dedup.THRESHOLD >= 0.8


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_an_operator(n):
    assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1


def test_near_duplicates_of_shared_ids(spark, sf):
    from test_operators import prose

    for shared in (None, 7):
        texts = [prose(100 + i, 80) for i in range(6)]
        rows = [(shared, x, "en", "src0", 1) for x in [*texts, texts[0]]] + [(8, texts[1], "en", "src0", 1)]  # a copy of the same id, one of another
        got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()]
        assert sorted(x for _, x in got) == sorted(texts)
        assert (8 if shared is None else 7, texts[1]) in got
