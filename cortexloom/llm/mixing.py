"""Mixing sources to target weights by Poisson replication.

A source's target rate is the mean number of times each of its documents should appear:
weight share x wanted rows / rows it has. Each document draws its own count from a Poisson
distribution with that mean, by inverting it at a uniform number hashed from (seed, doc_id, text),
so a document's count does not depend on partitions, order or retries. Documents are exploded
by their count and shuffled globally. SQL functions only; the driver sees one row for each
weighted source.

A large rate is the sum of independent draws of mean ``PART`` at most, each with its own hash.

Defined cases: sources without a weight of their own, null included, share the weight ``other``
as one pool (0 leaves them out); a weighted source without rows takes no share. Different texts draw
for themselves, also where their ids are null or shared; rows equal in id and text have one count, and a null id or text
draws as the empty one. Weights must be finite and not
negative; if all are 0 the result is empty. All columns pass through; ``copy`` (1..count) is
added, replacing a column of that name. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm._text import free_name, table

#: Largest mean of one draw, and the entries of its table: beyond them less than 1e-15 is left.
PART, ENTRIES = 8.0, 50


def poisson_table(mean: float) -> list[float]:
    """P(count <= j) for j = 0 .. ENTRIES - 1."""
    out, p, total = [], math.exp(-mean), 0.0
    for j in range(ENTRIES):
        total += p
        out.append(total)
        p *= mean / (j + 1)
    return out


def text_hash(text: Column) -> Column:
    """What a text adds to a draw: its md5 digest, null as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def uniform(seed: int, doc_id: Column, text: Column, part: Column | int = 1) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 digest; ``text`` is a ``text_hash``."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text, F.lit(part).cast("string") if isinstance(part, int) else part.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source", rows: int | None = None, other: float = 0.0) -> dict[str | None, float]:
    """Mean count by weighted source; the key None stands for all the others together."""
    if any(not math.isfinite(w) or w < 0 for w in [*weights.values(), other]):
        raise ValueError("weights must be finite and not negative")
    src = F.col(f"`{source_col}`").cast("string")
    named = F.when(src.isin(list(weights)), src) if weights else F.lit(None).cast("string")
    n = {r[0]: r[1] for r in docs.groupBy(named.alias("s")).count().collect()}  # a row for each weight, and one
    share = {s: w for s, w in {**weights, None: other}.items() if n.get(s)}
    whole = sum(share.values())
    want = sum(n.values()) if rows is None else rows
    return {s: (w / whole * want / n[s] if whole else 0.0) for s, w in share.items()}


def mix(docs: DataFrame, weights: dict[str, float], source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", rows: int | None = None, other: float = 0.0, seed: int = 17) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled; about ``rows`` rows, as many as came in by default."""
    src = F.col(f"`{source_col}`").cast("string")
    parts, cdf = F.lit(0), F.array().cast("array<double>")
    for s, rate in rates(docs, weights, source_col, rows, other).items():
        here = (~F.coalesce(src.isin(list(weights)), F.lit(False)) if weights else F.lit(True)) if s is None else src == s
        m = max(1, math.ceil(rate / PART))
        parts = F.when(here, m).otherwise(parts)
        cdf = F.when(here, F.array(*[F.lit(x) for x in poisson_table(rate / m)])).otherwise(cdf)

    kept = [c for c in docs.columns if c != "copy"]
    mark = free_name(docs, "_text_hash")
    hashed = docs.withColumn(mark, text_hash(F.col(f"`{text_col}`")))

    def draw(part: Column) -> Column:
        u = uniform(seed, F.col(f"`{id_col}`"), F.col(mark), part)
        return F.transform(F.array(u), lambda v: F.size(F.filter(cdf, lambda c: c < v)))[0]

    count = F.when(parts > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), draw), F.lit(0), lambda a, x: a + x)).otherwise(0)
    copies = F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))).alias("copy")
    counted = hashed.select(*[F.col(f"`{c}`") for c in kept], mark, copies)
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(mark), F.col("copy"))
    return counted.repartition(key).sortWithinPartitions(key).drop(mark)


#: The registered query's mixture: src0 three parts, src1 to src9 two parts each, all the rest together ten parts.
WEIGHTS, OTHER, SEED = {"src0": 3.0, **{f"src{i}": 2.0 for i in range(1, 10)}}, 10.0, 17


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, other=OTHER, seed=SEED)


OP10_SQL = f"""
WITH w(s, weight) AS (VALUES {", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())}, ('', {OTHER})),
d AS (SELECT *, row_number() OVER () AS rn, CASE WHEN source IN ({", ".join(f"'{s}'" for s in WEIGHTS)}) THEN source ELSE '' END AS s FROM documents),
n AS (SELECT s, count(*) AS n FROM d GROUP BY s),
r AS (SELECT s, weight / sum(weight) OVER () * (SELECT count(*) FROM documents) / n AS rate FROM n JOIN w USING (s)),
p AS (SELECT s, CAST(greatest(1, ceil(rate / {PART})) AS INTEGER) AS m, rate / greatest(1, ceil(rate / {PART})) AS mean FROM r),
pmf AS (SELECT s, j, exp(-mean + j * ln(mean) - lgamma(j + 1)) AS q FROM p, range({ENTRIES}) AS t(j)),
cdf AS (SELECT s, list(c ORDER BY j) AS cdf FROM (SELECT s, j, sum(q) OVER (PARTITION BY s ORDER BY j) AS c FROM pmf) GROUP BY s),
u AS (SELECT rn, doc_id, text, lang, source, n_chars, m, cdf, unnest(range(1, m + 1)) AS part FROM d JOIN p USING (s) JOIN cdf USING (s)),
k AS (SELECT *, (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || part), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS v FROM u),
c AS (SELECT doc_id, text, lang, source, n_chars, CAST(sum(len(list_filter(cdf, lambda x: x < v))) AS INTEGER) AS n
      FROM k GROUP BY rn, doc_id, text, lang, source, n_chars)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM c
"""
