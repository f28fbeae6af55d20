"""Fuzzy line deduplication by MinHash, in SQL functions only.

1. Signatures: every line gets its hash and the sorted hashes of the character shingles that
   start at words. The hash range has BANDS starting points, and the ROWS smallest hashes from a
   starting point on (around the end of the range) make a band. Equal lines become one line at
   once. Lines that are short, or have few or long words, get bands of all their character
   shingles: up to PARTED shingles these are dealt into more parts than two similar lines can
   differ in, so that one part is equal in both; from SPREAD shingles on there are minima as above.
2. Lines that share a band are candidates. Each bucket compares its lines with one of them, its
   hub (a line that occurs often, so mostly the one that the others were made from): a star, so
   n lines cost n comparisons. Similarity is the exact Jaccard similarity of the full
   character-shingle sets.
3. Links go to the distributed union-find (``connected_components``). Lines of a star that are not
   in its hub's component then meet the star's other lines through an exact prefix filter
   (``rest_pairs``): shingles are ordered from rare to frequent, and two similar sets have one in
   common among their first ones. Lines that differ from a common origin each in its own way start
   with shingles that no other line has, so they are not compared: pairs do not grow with the
   square of a group, and no link is lost.
4. Each component keeps its first line, by (doc_id, text hash, line number); the others are removed.

Lines shorter than ``MIN_CHARS`` code points hold too few shingles for similarity. With ``short``
their exact repeats are removed (blank lines stay); else they are left alone. Lines are known by a
64-bit hash.

Defined cases: null and empty texts have no line to remove and stay as they are. Rows are known
by doc_id and a hash of their text, so different texts of one id (or of none) lose their own lines
only. Rows equal in both count as one document, all of whose copies are treated alike; null ids
sort first. Ties cannot occur beyond that. Other columns pass through ``dedup_lines`` untouched;
an empty table gives an empty result. Very long lines cost time in proportion to their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm._text import free_name, table
from cortexloom.operators.components import connected_components
from cortexloom.plans.scratch import Scratch

SHINGLE, THRESHOLD, MIN_CHARS = 8, 0.8, 24
#: MinHash bands, each of ROWS neighbouring minima.
BANDS, ROWS = 10, 4
#: Lines up to so many code points, with fewer words or with longer words on average, have bands of all character shingles.
SHORT_CHARS, FEW_WORDS, WORD_CHARS = 200, 16, 12
#: Longer lines have bands of the shingles at words; so lines of either kind that can be similar have one kind in common.
WORDED_CHARS = 160
#: Least shingles of the classes whose lines are dealt into parts, the end of the last class, and the shingles from which on there are minima.
PARTED, SPREAD = (1, 5, 9, 13, 17, 21, 26, 32, 40, 50, 57), 40
#: Rows up to which a table of (id, a few numbers) is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000

_AT_WORDS = rf"(?s) (?=({'.' * SHINGLE}))"
#: Two sets are similar only if their sizes together, times this, are at least the size of their difference.
DIFFER = (1 - THRESHOLD) / (1 + THRESHOLD)
#: Open lines of a star up to which all of them are compared with each other, and the words of 64 parities of a line's shingles.
STAR, PARITIES = 32, 16
#: Ratio of the largest to the smallest set of a class of sizes.
CLASS = 1.04
_BANDS = [f"b{j}" for j in range(BANDS)]
_HASH = (1 << 60) - 1  # bits of a line's id that are its hash; the three above grow with its occurrences


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.transform(F.array(value), f)[0]


def grams(line: Column) -> Column:
    """Hashes of the distinct character shingles of a line of at least SHINGLE code points."""
    wide = 4 * SHINGLE  # bytes of a shingle in UTF-32, where each code point has four
    hashes = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - (wide - 1), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(wide))))
    return F.array_distinct(_let(F.encode(line, "UTF-32"), hashes))


def starts_of(n: int) -> list[int]:
    """Where ``n`` equal ranges of the 64-bit hashes begin."""
    return [j * ((1 << 64) // n) - (1 << 63) for j in range(n)]


def minima(lines: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the columns b0, b1 ...: bands of neighbouring minima of s, the sorted hashes of a line (all null where s is)."""
    starts = starts_of(BANDS)
    marked = lines.select(*keep, "s", F.sort_array(F.concat("s", F.array(*map(F.lit, starts)))).alias("m"), F.concat("s", F.slice("s", 1, ROWS)).alias("w"))
    before = [(F.array_position("m", F.lit(x)) - 1 - j).cast("int").alias(f"c{j}") for j, x in enumerate(starts)]  # hashes below a start
    placed = marked.select(*keep, "w", *before, F.size("s").alias(f"c{BANDS}"))
    # an empty part would only repeat the next band
    return placed.select(*keep, *[F.when(F.col(f"c{j}") < F.col(f"c{j + 1}"), F.xxhash64(F.slice("w", F.col(f"c{j}") + 1, F.lit(ROWS)))).alias(f"b{j}") for j in range(BANDS)])


def parted() -> list[tuple[int, int, int]]:
    """(least, most shingles, parts) of the classes: lines of a and b >= a shingles are similar only if b <= a / THRESHOLD and they differ in at most (a + b) * (1 - THRESHOLD) / (1 + THRESHOLD) shingles."""
    out = []
    for low, end in zip(PARTED, PARTED[1:]):
        high = math.floor((end - 1) / THRESHOLD + 1e-9)
        out.append((low, high, math.floor((end - 1 + high) * (1 - THRESHOLD) / (1 + THRESHOLD) + 1e-9) + 1))
    return out


def wordless(line: Column, at: Column) -> Column:
    """Whether the shingles at words, ``at``, may be too few to find the line."""
    return (F.length(line) <= SHORT_CHARS) | (F.size(at) < FEW_WORDS) | (F.size(at) * WORD_CHARS < F.length(line))


def _dealt(s: Column, low: int, n: int) -> Column:
    """Band hashes of sorted hashes ``s``, dealt into ``n`` equal ranges of the hashes; null for an empty one."""
    starts = starts_of(n)[1:]
    ends = lambda m: F.array(F.lit(0), *[(F.array_position(m, F.lit(x)) - 1 - j).cast("int") for j, x in enumerate(starts)], F.size(s))
    slices = lambda at: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda p: F.when(at[p - 1] < at[p], F.xxhash64(F.lit(low), F.slice(s, at[p - 1] + 1, at[p] - at[p - 1]))))
    return _let(_let(F.sort_array(F.concat(s, F.array(*map(F.lit, starts)))), ends), slices)


def brief_bands(brief: DataFrame) -> DataFrame:
    """(id, bucket) of the bands of all character shingles of (id, line)."""
    n, none = F.size("s"), F.array().cast("array<bigint>")
    banded = minima(brief.select("id", F.sort_array(grams(F.col("line"))).alias("s")), ["id", "s"])
    kinds = [F.when(n >= SPREAD, F.array(*_BANDS)).otherwise(none)]
    kinds += [F.when((n >= low) & (n <= high), _dealt(F.col("s"), low, parts)).otherwise(none) for low, high, parts in parted()]
    return banded.select("id", F.explode(F.array_distinct(F.concat(*kinds))).alias("bucket")).where("bucket is not null")


def _exploded(banded: DataFrame) -> DataFrame:
    return banded.unpivot("id", _BANDS, "band", "bucket").select("id", "bucket").where("bucket is not null")


def row_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text.cast("string"), F.lit(6))


def _lines(docs: DataFrame, least: Column | None = None) -> DataFrame:
    """(doc_id, t, line_no, line, h) of the lines that take part: those of MIN_CHARS or more, or for which ``least`` holds."""
    each = docs.select("doc_id", row_hash(F.col("text")).alias("t"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.length("line") >= MIN_CHARS if least is None else least)
    return each.withColumn("h", F.xxhash64("line"))


def _sized(df: DataFrame) -> DataFrame:
    """A scratch table, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def line_id(h: Column, n: Column) -> Column:
    """The id of a line of hash ``h`` that occurs ``n`` times: lines that occur more often have greater ids."""
    return F.shiftleft(F.least(F.floor(F.log2(n)), F.lit(7)), 60).bitwiseOR(h.bitwiseAND(F.lit(_HASH)))


def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, id, nx, ny, both): the pairs with the sizes of both shingle sets and of what they share."""
    left = pairs.join(texts.select("id", F.col("line").alias("q")), "id")
    hubs = texts.select(F.col("id").alias("hub"), F.col("line").alias("p")).join(pairs.select("hub").distinct(), "hub").select("hub", grams(F.col("p")).alias("x"))  # once a hub
    both = left.join(hubs, "hub").select("hub", "id", "x", grams(F.col("q")).alias("y"))
    return both.select("hub", "id", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("both"))


def _links(found: DataFrame) -> DataFrame:
    """(src, dst) of the judged pairs whose Jaccard similarity reaches THRESHOLD."""
    return found.where(F.col("both") >= THRESHOLD * (F.col("nx") + F.col("ny") - F.col("both"))).select(F.col("hub").alias("src"), F.col("id").alias("dst"))


def open_lines(found: DataFrame, comps: DataFrame) -> DataFrame:
    """(hub, id, c, u, d, n): the lines of judged stars that may have a link yet, their components, whether one is outside its hub's, in how many shingles they differ from the hub, and how many they have.

    With d the size of the difference of a line and its hub, two lines of a star are similar only if
    d of the one is at most DIFFER * (both sizes) more than d of the other.
    """
    of = _sized(comps)
    placed = found.join(of.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").join(of.select(F.col("node").alias("hub"), F.col("component").alias("o")), "hub", "left")
    placed = placed.select("hub", "id", F.coalesce("c", "id").alias("c"), F.coalesce("o", "hub").alias("o"), (F.col("nx") + F.col("ny") - 2 * F.col("both")).alias("d"), F.col("ny").alias("n"))
    placed = placed.withColumn("u", F.col("c") != F.col("o")).withColumn("slack", DIFFER * F.col("n") + 1e-6)
    stars = placed.groupBy("hub").agg(F.min(F.when(F.col("u"), F.col("d") - F.col("slack"))).alias("near"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("near is not null and lo < hi")
    held = placed.join(stars.select("hub", "near"), "hub").where("u or d + slack >= near")
    return held.select("hub", "id", "c", "u", "d", "n")


def star_pairs(held: DataFrame) -> DataFrame:
    """(hub, id) of the pairs of open lines within each star that may be similar, at least one of them outside its hub's component."""
    a, b = (held.select("hub", *[F.col(x).alias(f"{n}_{x}") for x in ("id", "c", "u", "d", "n")]) for n in "ab")
    may = (F.col("a_id") > F.col("b_id")) & (F.col("a_c") != F.col("b_c")) & (F.col("a_u") | F.col("b_u"))
    may &= F.abs(F.col("a_d") - F.col("b_d")) <= DIFFER * (F.col("a_n") + F.col("b_n")) + 1e-6
    return a.join(b, "hub").where(may).select(F.col("a_id").alias("hub"), F.col("b_id").alias("id"))


def parities(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n, x0, x1 ...): how many shingles a line has, and as bits whether their number in each of 64 * PARITIES parts of the hash range is odd."""
    each = lines.join(texts, "id").select("id", F.explode(grams(F.col("line"))).alias("s"))
    each = each.select("id", F.expr("shiftleft(1L, cast(s & 63 as int))").alias("bit"), F.shiftright("s", 6).bitwiseAND(F.lit(PARITIES - 1)).alias("part"))
    bits = [F.coalesce(F.bit_xor(F.when(F.col("part") == j, F.col("bit"))), F.lit(0)).alias(f"x{j}") for j in range(PARITIES)]
    return each.groupBy("id").agg(F.count("*").alias("n"), *bits)


def near_pairs(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs whose parities leave room for similarity: two sets differ in at least as many shingles as their parities in bits."""
    names = ["n", *[f"x{j}" for j in range(PARITIES)]]
    for end, n in (("hub", "p"), ("id", "q")):
        pairs = pairs.join(marks.select(F.col("id").alias(end), *[F.col(x).alias(f"{n}_{x}") for x in names]), end)
    differ = sum(F.bit_count(F.col(f"p_{x}").bitwiseXOR(F.col(f"q_{x}"))) for x in names[1:])
    return pairs.where(differ <= DIFFER * (F.col("p_n") + F.col("q_n")) + 1e-6).select("hub", "id")


def prefix_pairs(lines: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, id) of the pairs of the lines (id, c, u, n) of different components that may be similar, at least one of them marked by u.

    Similar sets of n and m shingles share at least t / (1 + t) * (n + m), so they share one of
    the first n - that + 1 of each in any common order. Shingles of one line only come first and
    need not be posted. The smaller line posts as ``small`` under its class of sizes, the larger
    one under each class that its partner may be of.
    """
    part, step = THRESHOLD / (1 + THRESHOLD), math.log(CLASS)
    kind = lambda n: F.floor(F.log(n + 1e-6) / step).cast("int")
    sets = scratch.save(lines.join(texts, "id").select("id", "c", "u", "n", F.explode(grams(F.col("line"))).alias("s")), "grams")
    often = sets.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    ranked = F.shiftleft(F.least("f", F.lit((1 << 15) - 1)), 48).bitwiseOR(F.col("s").bitwiseAND(F.lit((1 << 48) - 1)))  # rare ones first, then by hash
    shared = sets.join(often, "s").groupBy("id", "c", "u", "n").agg(F.sort_array(F.collect_list(ranked)).alias("s"))
    shared = scratch.save(shared.select("id", "c", "u", "n", (F.col("n") - F.size("s")).alias("alone"), "s"), "shared")

    def posts(partner: Column) -> Column:  # how many of s are among the first ones for a partner of so many shingles
        first = F.col("n") - F.ceil(part * (F.col("n") + partner) - 1e-6) + 1
        return F.least(F.size("s"), F.greatest(F.lit(0), first - F.col("alone"))).cast("int")

    def put(rows: DataFrame, n: str) -> DataFrame:
        rows = rows.select("id", "c", "u", "n", "kind", "alone", F.posexplode(F.slice("s", F.lit(1), F.col("posts"))).alias("at", "s"))
        return rows.select(F.xxhash64("kind", "s").alias("key"), F.col("id").alias(f"{n}_id"), F.col("c").alias(f"{n}_c"), F.col("u").alias(f"{n}_u"), F.col("n").alias(f"{n}_n"), (F.col("n") - F.col("alone") - F.col("at")).alias(f"{n}_left"))

    small = scratch.save(put(shared.withColumn("kind", kind(F.col("n"))).withColumn("posts", posts(F.col("n"))), "a"), "small")
    large = shared.withColumn("kind", F.explode(F.sequence(kind(THRESHOLD * F.col("n") - 1), kind(F.col("n")))))
    large = scratch.save(put(large.withColumn("posts", posts(F.greatest(THRESHOLD * F.col("n"), F.exp(F.col("kind") * step)))), "b"), "large")
    may = (F.col("a_n") <= F.col("b_n")) & (F.col("a_c") != F.col("b_c")) & (F.least("a_left", "b_left") >= part * (F.col("a_n") + F.col("b_n")) - 1e-6)
    found = [x.join(y, "key").where(may).select(F.col("a_id").alias("hub"), F.col("b_id").alias("id")) for x, y in ((small, large.where("b_u")), (small.where("a_u"), large.where("not b_u")))]
    return found[0].unionAll(found[1]).select(F.greatest("hub", "id").alias("hub"), F.least("hub", "id").alias("id")).distinct()


def rest_pairs(held: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, id) of the pairs of open lines that may be similar, at least one of them outside its hub's component.

    Lines of stars of up to STAR open lines meet each other, those of larger ones meet through the prefix filter.
    """
    stars = scratch.save(held.groupBy("hub").agg((F.count("*") > STAR).alias("large")), "sizes")
    held = held.join(_sized(stars), "hub")
    pairs = star_pairs(held.where("not large"))
    large = scratch.save(held.where("large").groupBy("id", "c", "n").agg(F.max("u").alias("u")), "large_stars")
    if not large.isEmpty():
        pairs = pairs.unionAll(prefix_pairs(large, texts, scratch))
    pairs = scratch.save(pairs.distinct(), "rest")
    marks = scratch.save(parities(pairs.select(F.explode(F.array("hub", "id")).alias("id")).distinct(), texts), "parities")
    return scratch.save(near_pairs(pairs, marks), "near")


def _joined(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``comps`` with further links: only the components that these connect go through the union-find again."""
    of = _sized(comps)
    ends = links.join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src", "left").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst", "left")
    ends = scratch.save(ends.select("src", "dst", F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b")), "ends")
    moved = _sized(scratch.save(connected_components(ends.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "moved").select(F.col("node").alias("component"), F.col("component").alias("to")))
    both = comps.unionAll(ends.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("a").alias("component")), F.struct(F.col("dst").alias("node"), F.col("b").alias("component")))).alias("x")).select("x.*")).distinct()
    return scratch.save(both.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")


def signed(lines: DataFrame) -> DataFrame:
    """(h, line, n, b0, b1 ...) of the distinct lines: the text of those that need bands of all their shingles, how often a line occurs, and the bands at words of those beyond WORDED_CHARS (else null).

    One pass over the texts, and one shuffle.
    """
    at = F.when(F.length("line") > WORDED_CHARS, F.regexp_extract_all(F.concat(F.lit(" "), "line"), F.lit(_AT_WORDS), 1))
    hashed = F.sort_array(F.array_distinct(F.transform("at", lambda x: F.xxhash64(x))))
    each = lines.select("h", "line", at.alias("at")).select("h", F.when(wordless(F.col("line"), F.col("at")), F.col("line")).alias("line"), hashed.alias("s"))
    return minima(each, ["h", "line"]).groupBy("h", "line", *_BANDS).agg(F.count("*").alias("n"))  # equal lines have equal bands


def _linked(docs: DataFrame, seen: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the ids of all lines that are similar to another one."""
    bands = scratch.save(brief_bands(seen.where("line is not null")), "brief_bands")
    banded = _exploded(seen.where(F.coalesce(*_BANDS).isNotNull())).unionAll(bands)
    stars = scratch.save(banded.groupBy("bucket").agg(F.max("id").alias("hub"), F.min("id").alias("least")).where("least < hub").select("bucket", "hub"), "stars")
    pairs = scratch.save(banded.join(_sized(stars), "bucket").where("id <> hub").select("hub", "id").distinct(), "pairs")
    scratch.drop(bands)
    scratch.drop(stars)
    ids = scratch.save(pairs.select(F.explode(F.array("hub", "id")).alias("id")).distinct().select("id", F.col("id").bitwiseAND(F.lit(_HASH)).alias("k")), "ids")
    texts = _lines(docs).select(F.col("h").bitwiseAND(F.lit(_HASH)).alias("k"), "line").join(_sized(ids), "k")
    texts = scratch.save(texts.select("id", "line").distinct(), "texts")
    found = scratch.save(judged(pairs, texts), "judged")
    comps = scratch.save(connected_components(_links(found)), "components")
    held = scratch.save(open_lines(found, comps), "open")
    more = scratch.save(_links(judged(rest_pairs(held, texts, scratch), texts)), "more")
    scratch.drop(texts)
    return comps if more.isEmpty() else _joined(comps, more, scratch)


def removals(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, t, gone): the numbers of the lines that a document loses; documents that lose none are absent."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "lines", tidy=True)
    worded = F.col("line").rlike(r"[^\x20\x09-\x0D]")
    least = (F.length("line") >= MIN_CHARS) | worded if short else None
    seen = scratch.save(signed(_lines(docs, least)), "seen").withColumn("id", line_id(F.col("h"), F.col("n")))
    tiny, full = seen.where(F.length("line") < MIN_CHARS), seen.where(F.col("line").isNull() | (F.length("line") >= MIN_CHARS))
    comps = _linked(docs, full, scratch)

    reps = full.select("h", "id", "n")
    grouped = reps.join(_sized(comps.withColumnRenamed("node", "id")), "id", "left").where("n > 1 or component is not null")
    grouped = grouped.select("h", F.coalesce("component", "id").alias("c"))
    grouped = grouped if short else scratch.save(grouped, "grouped")
    if short:  # equal short lines are groups of their own
        grouped = scratch.save(grouped.unionAll(tiny.where("n > 1").select("h", F.col("h").alias("c"))), "grouped")
    again = scratch.save(_lines(docs, least).select("doc_id", "t", "line_no", "h").join(_sized(grouped), "h").select("c", "doc_id", "t", "line_no"), "again")
    keep = scratch.save(again.groupBy("c").agg(F.min(F.struct("doc_id", "t", "line_no")).alias("k")).select("c", F.col("k.doc_id").alias("kd"), F.col("k.t").alias("kt"), F.col("k.line_no").alias("kl")), "keep")
    gone = again.join(_sized(keep), "c").where("not (doc_id <=> kd and t = kt and line_no = kl)")
    return scratch.save(gone.groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("gone")), "gone")


def dedup_lines(docs: DataFrame, counts: bool = False, short: bool = False) -> DataFrame:
    """``docs`` with each near-duplicate line kept once; with ``counts`` also n_lines and n_removed, with ``short`` exact repeats of short lines go too.

    A document whose lines are all removed stays, with an empty text.
    """
    gone = removals(docs, short)
    n, g, k, t = gone.count(), free_name(docs, "_gone"), free_name(docs, "_id"), free_name(docs, "_text_hash")
    small = gone.select(F.col("doc_id").alias(k), F.col("t").alias(t), F.col("gone").alias(g))
    small = F.broadcast(small) if n <= BROADCAST_ROWS else small
    both = docs.join(small, docs["doc_id"].cast("bigint").eqNullSafe(F.col(k)) & (row_hash(docs["text"]) == F.col(t)), "left")
    split = F.split(F.col("text").cast("string"), "\n")
    cleaned = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains(g, i)), "\n"))
    out = [cleaned.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        out += [F.coalesce(F.size(split), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size(g), F.lit(0)).cast("bigint").alias("n_removed")]
    return both.select(*out)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True, short=True)
