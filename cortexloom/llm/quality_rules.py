"""Quality rules, line first: bad lines go, then documents that lost too much text.

All of it is SQL functions on one scan: no shuffle, no Python. Per line:

* navigation: separators between entries (``|``, ``>``, bullets) that make up many of its tokens;
* punctuation: many tokens that carry symbols or exclamation marks, or a line mostly of symbols;
* boilerplate: a short line most of whose words are fixed phrases of page furniture (as whole
  words: "the dialog in the second act" is none) or markup, or a short line that ends in a separator;
* shouting and stutter: many words, nearly all upper case, or one word repeated through the line.

A line without a word is kept. The document then fails if its base counts fail (too few words,
too many words in repeated windows), if the kept lines hold less than ``min_kept`` of its word
characters, or if too many of its lines repeat earlier ones.

Defined cases: a null text has no words and no lines (all counts 0), is not kept and keeps its
null text; an empty or blank text has no words. Repeated rows and null ids are judged row by
row. Only doc_id and text are read; other columns pass through ``clean`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm._text import SPACES, table

# Phrases of page furniture (lower case); they count as whole words only.
PHRASES = (
    "all rights reserved|terms of use|terms of service|privacy policy|cookie policy|use cookies|accept cookies|"
    "enable javascript|lorem ipsum|click here|read more|sign in|log in|sign up|subscribe now|"
    "skip to content|back to top|share this|powered by|page not found"
)
#: A phrase with its edges, or a tag; what a line of prose has beside them is text.
BOILERPLATE = rf"(?:\A|[^\p{{L}}\p{{N}}])(?:{PHRASES})(?:\z|[^\p{{L}}\p{{N}}])|</?[a-z][^>]{{0,200}}>"
#: How lines of text do not end.
LINE_END = r"[|>•·][\x20\x09-\x0D]*\z"
NAVIGATION, SYMBOLS = r"\A[|>»•·]+\z", r"[#*$%&|<>]|!!"
#: Shares of a line's tokens above which it fails, and the least number of tokens for the shares to count.
NAV_SHARE, SYMBOL_SHARE, UPPER_SHARE, REPEAT_SHARE, MIN_TOKENS = 0.25, 0.4, 0.9, 0.6, 3
#: Least share of word characters that must be left, and the largest share of repeated lines.
MIN_KEPT, MAX_DUP_LINES = 0.5, 0.5
#: Words of a line up to which it can be boilerplate, and the share of them in phrases and tags above which it is.
BOILER_WORDS, BOILER_SHARE = 20, 0.5


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def _letters(c: Column, kind: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, kind, ""))


def line_fails(line: Column, w: Column) -> Column:
    """Whether a line with words ``w`` fails one of the rules; false for a line without words.

    Each rule is guarded by a cheap test that only lines it could fail can pass.
    """
    n = F.size(w)
    nav = F.size(F.filter(w, lambda x: x.rlike(NAVIGATION)))
    sym = F.size(F.filter(w, lambda x: x.rlike(SYMBOLS)))
    shares = (n >= MIN_TOKENS) & line.rlike(r"[#*$%&|<>»•·]|!!") & ((nav > NAV_SHARE * n) | (sym > SYMBOL_SHARE * n))
    shout = (n >= 10) & line.rlike(r"\p{Lu}\p{Lu}") & (_letters(line, r"\p{Lu}") > UPPER_SHARE * _letters(line, r"\p{L}"))
    stutter = (n >= 10) & (F.size(F.array_distinct(w)) < (1 - REPEAT_SHARE) * n)
    low = F.lower(line)
    beside = F.size(_words(F.regexp_replace(low, BOILERPLATE, " ")))
    boiler = low.rlike(BOILERPLATE) & (n - beside > BOILER_SHARE * n) | line.rlike(LINE_END)
    return shares | shout | stutter | ((n > 0) & (n <= BOILER_WORDS) & boiler)


def repeat_words(words: Column, window: int = 8) -> Column:
    """How many words lie in windows of ``window`` words that the text holds at least twice, the first included.

    Windows are compared by a 64-bit hash. Where all differ (one pass over a hash set) the
    answer is 0; else the windows are sorted by hash, equal neighbours are marked, and the
    marked positions are measured in order. Time n log n in the text's words, at any repetition.
    """

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return F.when(F.size(w) < window, 0).otherwise(F.transform(F.array(hashes), among)[0])

    def among(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.transform(F.array(ordered), covered)[0])

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = F.transform(F.array(at), lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("end")), lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x + window - a["end"])).alias("n"), (x + window).alias("end"))))
        return steps[0]["n"]

    return F.transform(F.array(words), of)[0].cast("bigint")


def _measure(text: Column, then) -> Column:
    """``then(m)`` of the struct m of a text's counts and kept lines, which is worked out once."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def counts(w: Column) -> Column:
        solid = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(solid).cast("bigint").alias("word_chars"),
            (F.length(solid) - F.length(F.regexp_replace(solid, r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
            repeat_words(w).alias("n_repeat_words"),
        )

    def by_line(ls: Column) -> Column:  # of (line, words)
        worded = F.transform(F.filter(ls, lambda x: F.size(x["w"]) > 0), lambda x: x["s"])
        return F.struct(
            F.size(worded).cast("bigint").alias("n_lines"),
            (F.size(worded) - F.size(F.array_distinct(worded))).cast("bigint").alias("n_dup_lines"),
            F.transform(F.filter(ls, lambda x: ~line_fails(x["s"], x["w"])), lambda x: x["s"]).alias("left"),
            _once(F.flatten(F.transform(ls, lambda x: x["w"])), counts).alias("c"),
        )

    return _once(_once(F.transform(lines, lambda x: F.struct(x.alias("s"), _words(x).alias("w"))), by_line), then)


def _once(c: Column, f) -> Column:
    """f(c), with c named inside the expression so that it is worked out once."""
    return F.transform(F.array(c), f)[0]


def _verdict(m: Column) -> tuple[Column, Column, Column]:
    c = m["c"]
    base_failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    left_chars = F.length(F.regexp_replace(F.array_join(m["left"], "\n"), SPACES, ""))
    ok = (left_chars >= MIN_KEPT * c["word_chars"]) & (m["n_dup_lines"] <= MAX_DUP_LINES * m["n_lines"])
    return base_failed, ~base_failed & ok, left_chars


def assess(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, left_chars) for every row."""

    def row(m: Column) -> Column:
        base_failed, kept, left = _verdict(m)
        c = m["c"]
        return F.struct(c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"), base_failed.alias("base_failed"), kept.alias("kept"), left.cast("bigint").alias("left_chars"))

    return docs.select("doc_id", F.inline(F.array(_measure(F.col(text_col).cast("string"), row))))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents, all columns as they came, their text without the failed lines.

    A document gives one text or none, so the rules run once and no filter repeats them.
    """
    none = F.array().cast("array<string>")
    texts = _measure(F.col(text_col).cast("string"), lambda m: F.when(_verdict(m)[1], F.array(F.array_join(m["left"], "\n"))).otherwise(none))
    return docs.select(*[F.explode(texts).alias(n) if n == text_col else F.col(f"`{n}`") for n in docs.columns])


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, list_filter(string_split_regex(t, '{SPACES}'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS r(k) GROUP BY rid),
l AS (SELECT rid, unnest(ls) AS s FROM w),
lw AS (SELECT rid, s, list_filter(string_split_regex(s, '{SPACES}'), lambda x: x <> '') AS ws FROM l),
judged AS (
  SELECT rid, s, len(ws) AS n,
    (len(ws) >= {MIN_TOKENS} AND (len(list_filter(ws, lambda x: regexp_matches(x, '{NAVIGATION}'))) > {NAV_SHARE} * len(ws)
                                  OR len(list_filter(ws, lambda x: regexp_matches(x, '{SYMBOLS}'))) > {SYMBOL_SHARE} * len(ws)))
    OR (len(ws) >= 10 AND length(s) - length(regexp_replace(s, '\p{{Lu}}', '', 'g')) > {UPPER_SHARE} * (length(s) - length(regexp_replace(s, '\p{{L}}', '', 'g'))))
    OR (len(ws) >= 10 AND len(list_distinct(ws)) < {1 - REPEAT_SHARE} * len(ws))
    OR (len(ws) BETWEEN 1 AND {BOILER_WORDS} AND (regexp_matches(s, '{LINE_END}') OR regexp_matches(lower(s), '{BOILERPLATE}')
        AND len(ws) - len(list_filter(string_split_regex(regexp_replace(lower(s), '{BOILERPLATE}', ' ', 'g'), '{SPACES}'), lambda x: x <> '')) > {BOILER_SHARE} * len(ws))) AS fails
  FROM lw
),
byline AS (
  SELECT rid, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (n > 0) - count(DISTINCT s) FILTER (n > 0) AS n_dup_lines,
         CAST(coalesce(sum(length(regexp_replace(s, '{SPACES}', '', 'g'))) FILTER (NOT fails), 0) AS BIGINT) AS left_chars
  FROM judged GROUP BY rid
),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(array_to_string(ws, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines, left_chars
  FROM w JOIN byline USING (rid) LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND left_chars >= {MIN_KEPT} * word_chars AND n_dup_lines <= {MAX_DUP_LINES} * n_lines AS kept,
       left_chars
FROM m
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))
