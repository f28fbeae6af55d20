"""Every dealt operator: against brute force, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cortexloom.llm import language_id, line_dedup, maxent_lm, mixing, quality_classifier, quality_rules, queries, sentencepiece_codec, simhash, surrogates, topk
from cortexloom.llm._text import held_out
from cortexloom.operators.components import connected_components
from cortexloom.plans.scratch import Scratch

WORDS = "anton berta cäsar dora emil friedrich gustav heinrich ida julius kaufmann ludwig martha nordpol otto paula quelle richard samuel theodor ulrich viktor wilhelm xanthippe ypsilon zeppelin".split()


def prose(seed, n, low=0):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[(low + i) % 26] + str(int(rng.integers(0, 50))) for i in rng.integers(0, 26, n))


BASE = prose(1, 120)
CASES = [
    (1, BASE, "en", "src0", 1),
    (2, BASE, "en", "src0", 1),  # copy
    (3, BASE.replace("otto", "hugo", 1), "en", "src1", 2),  # near copy
    (4, None, None, None, None),
    (5, "", "de", "src2", 0),
    (6, " \t\r\n\x0b\x0c ", "de", "src2", 7),
    (7, prose(3, 6000), "fr", "src0", 9),  # long
    (8, "x" * 70000, "fr", "src0", 9),  # one long word
    (9, "the the the the the the the the the the the the the the the the the the the the the the", "en", "src9", 3),
    (None, BASE, "en", None, 1),  # no id
    (10, prose(4, 30) + "\n" + prose(5, 30) + "\n\n" + prose(4, 30), "es", "src3", 5),
    (10, prose(4, 30) + "\n" + prose(5, 30) + "\n\n" + prose(4, 30), "es", "src3", 5),  # repeated row
    (11, "日本語のテキスト、そして絵文字🙂。 é é", "ja", "src3", 5),
    (12, "home | about | contact | login | imprint | news\n" + prose(6, 40), "en", "src5", 8),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CASES, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clash(docs):
    """The same documents with columns named like the operators' own."""
    for c in ("score", "fp", "h", "line", "_q", "_gone", "_id", "copy", "held_out", "component_id", "n", "b"):
        docs = docs.withColumn(c, F.lit("own"))
    return docs


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ 1


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = [(int(i), [float(x) for x in rng.normal(size=8).round(2)]) for i in range(300)]
    vecs += [(300, vecs[0][1]), (301, vecs[0][1]), (302, None), (303, [1.0, None] + [0.0] * 6), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (306, [1.0]), (307, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id bigint, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=40, block_queries=3, fan_in=2).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: [math.floor(256 * x) for x in v] for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in ok if i % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))[:5]
        assert sorted(got[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(best)]


def test_topk_short_lists_and_large_numbers(spark):
    df = spark.createDataFrame([(0, [3e13, 1.0]), (50, [2.0, -1.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 50): 256 * 3 * 10**13 * 512 - 256 * 256, (0, 1): 256 * 3 * 10**13 * 128 + 256 * 128, (50, 0): 256 * 3 * 10**13 * 512 - 256 * 256, (50, 1): 512 * 128 - 256 * 128}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


# ------------------------------------------------------------------ 3


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(points, radius):
    at = list(range(len(points)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= radius:
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def test_simhash_fingerprints_and_groups(docs, clash, empty):
    for df in (docs, clash):
        got = simhash.near_duplicates(df).collect()
        assert len(got) == len(CASES)
        fps = collections.Counter((c[0], f"{brute_fingerprint(c[1]):016x}") for c in CASES)
        assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in got) == fps
        of = {r["doc_id"]: r["component_id"] for r in got}
        assert of[1] == of[2] == of[None] == 1 and of[4] == of[5] == of[6] == 4
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("leaf", [4, 16, 2048])
def test_vantage_point_trees_lose_no_link(spark, leaf):
    rng = np.random.default_rng(leaf)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    points = set(seeds.tolist())
    for s in seeds[:20]:
        p = int(s)
        for _ in range(12):  # chains and balls of near points
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                p ^= 1 << int(b)
            points.add(p)
    points = sorted(points)
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    from cortexloom.operators.components import connected_components
    from cortexloom.plans.scratch import Scratch

    fps = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    found = simhash.links(fps, len(points), Scratch(spark, "test"), 3, leaf)
    comp = {r["node"]: r["component"] for r in connected_components(found).collect()}
    want = brute_components(points, 3)
    groups = collections.defaultdict(set)
    for i, r in enumerate(want):
        groups[r].add(signed[i])
    got = collections.defaultdict(set)
    for s in signed:
        got[comp.get(s, s)].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


# ------------------------------------------------------------------ 2 and 7


def test_quality_learns_and_scores_every_row(spark, docs, clash, empty):
    good = [(1000 + i, prose(i, 60), None, None, None) for i in range(60)]
    bad = [(2000 + i, " ".join([WORDS[i % 26] + "!!"] * 60), None, None, None) for i in range(60)]
    train = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(d[0], 1, 0) for d in good] + [(d[0], 0, 1) for d in bad] + [(1000, None, 0), (None, 1, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.fit(train, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(train, model).collect()}
    assert min(got[d[0]] for d in good) > 0.5 > max(got[d[0]] for d in bad)
    for df in (docs, clash):
        scored = quality_classifier.score(df, model).collect()
        assert len(scored) == len(CASES) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_classifier.score(empty, model).count() == 0
    none = quality_classifier.fit(empty, labels)
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} != set()


def test_quality_score_is_the_models_probability(spark):
    rows = [(*quality_classifier.features(prose(i, 30).encode()), int(i % 2)) for i in range(10)]
    m = quality_classifier.train(rows, epochs=2)
    texts = {1: prose(2, 50), 2: "one", 3: "", 4: None, 5: "the the the end", 6: "日本 語 " * 40}
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), m).collect()}
    for i, t in texts.items():
        words, h = (t or "").encode().split(), np.zeros(m["E"].shape[1])
        grams = lambda w: [zlib.crc32(w, 1) % quality_classifier.BUCKETS] + [zlib.crc32(x[k : k + n].encode(), n) % quality_classifier.BUCKETS for x in ["<" + w.decode() + ">"] for n in (3, 4) for k in range(len(x) - n + 1)]
        for w in words:
            h += np.mean([m["E"][g] for g in grams(w)], axis=0) / len(words) / 2
        hashes = [zlib.crc32(w, 2) % (1 << 24) for w in words]
        for x, y in zip(hashes, hashes[1:]):
            mixed = ((x * 0x9E3779B1 + y) % (1 << 64) * 0xBF58476D1CE4E5B9) % (1 << 64) >> 40
            h += m["E"][quality_classifier.BUCKETS + mixed % quality_classifier.BUCKETS] / (len(words) - 1) / 2
        z = h @ m["W"] + m["b"]
        assert abs(got[i] - np.exp(z[1]) / np.exp(z).sum()) < 1e-4


def test_fitting_takes_one_row_of_a_repeated_id(spark):
    rows = [(1, "good words here", "en")] + [(2, f"bad {i}", "de") for i in range(50)] + [(None, "none", "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id bigint, quality int")
    seen = []
    try:
        old, quality_classifier.train = quality_classifier.train, lambda r, c: seen.append(len(r))
        quality_classifier.fit(docs, labels)
    finally:
        quality_classifier.train = old
    try:
        old, language_id.train = language_id.train, lambda r: seen.append(len(r))
        language_id.fit(docs)
    finally:
        language_id.train = old
    assert seen == [2, 2]


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_classifier.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n, right = out.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert right >= 0.95 * n


def test_language_hierarchy(spark, docs, clash, empty):
    texts = {"en": "the cat and the dog were with them when this thing was there", "de": "der hund und die katze waren nicht mit ihnen als sich das ereignete", "fr": "le chien et le chat étaient avec eux quand cela est arrivé où", "es": "el perro y el gato estaban con ellos cuando esto ocurrió mañana", "xx": "qwz wqz zzq qqw wzq qzw zqz wwq"}
    train = spark.createDataFrame([(i * 10 + k, " ".join(np.random.default_rng(i).permutation(t.split())), lang, None, None) for i in range(30) for k, (lang, t) in enumerate(texts.items())], SCHEMA)
    model = language_id.fit(train)
    assert [k for k, _ in model["groups"]][0] == "family" and ("romance", ["es", "fr"]) in model["groups"]
    out = language_id.predict(train, model).join(train, "doc_id")
    assert out.where("lang <> lang_pred").count() == 0
    for df in (docs, clash):
        got = language_id.predict(df, model).collect()
        assert len(got) == len(CASES) and all(0 <= r["score"] <= 1 for r in got)
        of = {r["doc_id"]: r["lang_pred"] for r in got}
        assert of[4] == of[5] == of[6] == "und" and of[8] != "und"
    assert language_id.predict(spark.createDataFrame([(1, "123 456 !")], "doc_id bigint, text string"), model).first()["lang_pred"] == "und"
    odd = spark.createDataFrame(list(enumerate(["½ ² ① Ⅷ ½", "_ ٣", "é"])), "doc_id bigint, text string")
    assert [r["lang_pred"] == "und" for r in language_id.predict(odd, model).orderBy("doc_id").collect()] == [True, True, False]
    # against a plain reading of the machines: vote, then the sum of margins
    for lang, t in texts.items():
        ids, x = language_id.features(t.encode())
        kind = "family"
        for _ in range(2):
            members = dict(model["groups"])[kind]
            votes = {m: [0, 0.0] for m in members}
            for j, (k, one, two) in enumerate(model["pairs"]):
                if k == kind:
                    z = float(x @ model["W"][ids, j])
                    votes[one if z >= 0 else two][0] += 1
                    votes[one][1] += z
                    votes[two][1] -= z
            kind = max(members, key=lambda m: (*votes[m], m))
            if kind not in dict(model["groups"]):
                break
        assert kind == lang
    nameless = spark.createDataFrame([(None if i % 2 else 7, f"text {i}", "a" if i < 4000 else "b") for i in range(8000)], "doc_id bigint, text string, source string")
    for seed in (17, 18):  # null and shared ids keep their weight, and lie in many partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        out = mixing.mix(nameless, {"a": 1.0, "b": 1.0}, seed=seed)
        n = collections.Counter(r["source"] for r in out.collect())
        assert all(abs(n[s] - 4000) < 5 * 4000**0.5 for s in "ab")
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 4000
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    many = language_id.fit(spark.createDataFrame([(i, f"w{i} text", f"q{i}") for i in range(130)], "doc_id bigint, text string, lang string"), sample_rows=40)
    assert len(many["langs"]) == 130 and dict(many["groups"])["family"] == ["other"]
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}


# ------------------------------------------------------------------ 4


def test_surrogates_keep_type_format_and_identity(spark, docs, clash, empty):
    text = "Mail bob@ex.org or BOB@EX.ORG, card 4111 1111 1111 1111 (4111111111111111), not 4111111111111112, ip 10.2.3.4, call +49 30 1234567, iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, token = \"0123abcd0123abcd\". Frau Müller met Mr. John Smith; v1.2.3."
    rows = [(1, text), (2, "again bob@ex.org"), (3, None), (4, ""), (5, "nothing here"), (None, "bob@ex.org")]
    got = {r["doc_id"]: r for r in surrogates.pseudonymize(spark.createDataFrame(rows, "doc_id bigint, text string"), b"k").collect()}
    new = got[1]["text"]
    assert all(x not in new for x in ("bob@", "BOB@", "4111 1111", "10.2.3.4", "1234567", "WEST", "123-45", "0123abcd", "Müller", "John", "Smith"))
    assert "4111111111111112" in new and "v1.2.3" in new and "ip 10." in new and "+49 " in new
    found = surrogates.find(new)
    assert [e[2] for e in found] == [e[2] for e in surrogates.find(text)]
    mail = got[2]["text"].removeprefix("again ")
    assert mail in new and mail.upper() in new and got[None]["text"] == mail and mail.endswith(".org")
    assert (got[3]["text"], got[4]["text"], got[5]["text"], got[5]["n_entities"], got[3]["kinds"]) == (None, "", "nothing here", 0, "")
    for df in (docs, clash):
        out = surrogates.pseudonymize(df, b"k")
        assert set(df.columns) <= set(out.columns) and out.count() == len(CASES)
        assert out.where("doc_id = 1").first()["text"] == BASE
    assert surrogates.pseudonymize(empty, b"k").count() == 0


def test_surrogates_of_a_tiny_domain_stay_distinct(spark, monkeypatch):
    """Eight entities whose first candidates nearly all collide end with eight surrogates, none of them a real entity."""
    from cortexloom.plans.scratch import Scratch

    real = surrogates.surrogate
    ents = [("phone", f"+4990{i:02d}") for i in range(8)]
    df = spark.createDataFrame(ents, "kind string, canon string")
    moved = {(r["kind"], r["canon"]): r["attempt"] for r in surrogates.collisions(df, b"k", Scratch(spark, "t")).collect()}
    final = [real(b"k", k, c, moved.get((k, c), 0)) for k, c in ents]
    assert len(set(final)) == 8 and not set(final) & {c for _, c in ents}


# ------------------------------------------------------------------ 5


def brute_counts(t):
    t = t or ""
    w, where = re.findall(r"[^\x20\x09-\x0D]+", t), collections.defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    covered = {k for p in where.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts(docs, clash, empty):
    want = collections.Counter((c[0], *brute_counts(c[1])) for c in CASES)
    for df in (docs, clash):
        got = quality_rules.assess(df).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
        of = {r["doc_id"]: r for r in got}
        assert of[1]["kept"] and of[12]["kept"] and not of[4]["kept"] and not of[9]["kept"] and of[9]["base_failed"]
        cleaned = quality_rules.clean(df)
        assert cleaned.columns == df.columns and "home |" not in cleaned.where("doc_id = 12").first()["text"]
        assert cleaned.where("doc_id = 1").first()["text"] == BASE
    assert quality_rules.assess(empty).count() == 0 and quality_rules.clean(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(spark, duck, sf, name):
    ours = queries.QUERIES[name](spark, sf)
    theirs = duck.sql(queries.SQL[name])
    cols = sorted(ours.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted([tuple(map(norm, r)) for r in ours.select(cols).collect()], key=repr)
    names = [d[0] for d in theirs.description]
    b = sorted([tuple(norm(r[names.index(c)]) for c in cols) for r in theirs.fetchall()], key=repr)
    assert a == b and a


# ------------------------------------------------------------------ 6


def brute_lines(rows):
    first = {}
    for i, t in sorted(rows):
        for n, line in enumerate(t.split("\n")):
            if len(line) >= line_dedup.MIN_CHARS:
                first.setdefault(line, (i, n))
    lines = list(first)
    sets = [{x[k : k + line_dedup.SHINGLE] for k in range(len(x) - line_dedup.SHINGLE + 1)} for x in lines]
    at = list(range(len(lines)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= line_dedup.THRESHOLD * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    keep = {}
    for i, line in enumerate(lines):
        keep[root(i)] = min(keep.get(root(i), first[line]), first[line])
    of = {line: keep[root(i)] for i, line in enumerate(lines)}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if len(x) < line_dedup.MIN_CHARS or of[x] == (i, n)) for i, t in rows}


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [prose(i, int(rng.integers(4, 60))) for i in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(4):
            words = base[int(rng.integers(0, 40))].split()
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = WORDS[int(rng.integers(0, 26))]
            lines.append(" ".join(words))
        rows.append((d, "\n".join([*lines, "short", ""])))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_lines(rows)
    assert sum(got[i] != want[i] for i in want) <= 2  # banding finds nearly every link at the threshold itself
    assert sum(map(len, got.values())) <= 1.02 * sum(map(len, want.values()))


def test_line_dedup_link_recall(spark):
    """Of planted pairs of long and short lines at Jaccard 0.8 to 1, at least nine in ten are found; of pairs below, none."""
    rng, rows, want = np.random.default_rng(11), [], {}
    grams = lambda x: {x[k : k + line_dedup.SHINGLE] for k in range(len(x) - line_dedup.SHINGLE + 1)}
    for i in range(400):
        one = ["".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(int(rng.integers(8, 90)))]
        two = list(one)
        for _ in range(int(rng.integers(1, 2 + len(one) // 14))):
            two[int(rng.integers(0, len(two)))] = "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
        a, b = " ".join(one), " ".join(two)
        x, y = grams(a), grams(b)
        if min(len(a), len(b)) >= line_dedup.MIN_CHARS:
            rows += [(2 * i, a), (2 * i + 1, b)]
            want[i] = len(x & y) >= line_dedup.THRESHOLD * len(x | y)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = {i: got[2 * i + 1] == "" for i in want}
    assert sum(want.values()) > 100 and not any(found[i] for i in want if not want[i])
    recall = sum(found[i] for i in want if want[i]) / sum(want.values())
    print("link recall", recall, "of", sum(want.values()))
    assert recall >= 0.97


def test_line_dedup_meets_the_rest_of_a_group(spark):
    """Many lines made from one, each changed in its own places: all links of the group, however the star fell."""
    rng, base = np.random.default_rng(13), prose(77, 70).split()
    lines = set()
    for _ in range(150):
        words = list(base)
        for _ in range(int(rng.integers(1, 6))):
            words[int(rng.integers(0, len(words)))] = "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
        lines.add(" ".join(words))
    rows = list(enumerate(sorted(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_verifies_few_of_the_rest(spark):
    """What stars leave open: every similar pair of a star of any size is verified, and few that are not similar."""
    rng, lines, stars = np.random.default_rng(17), [], []
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    for size in (3, 12, line_dedup.STAR + 20):
        base = [word() for _ in range(60)]
        stars.append(range(len(lines), len(lines) + size))
        for k in range(size):
            words = base if k % 4 else [word() if i < 12 else w for i, w in enumerate(base)]  # some are like each other, and not like the hub
            words = list(base if k == size - 1 else words)
            for _ in range(0 if k == size - 1 else int(rng.integers(1, 12))):
                words[int(rng.integers(12, 60))] = word()
            if k % 4 == 0 and k:
                words = lines[-4].split()[:20] + words[20:]
            lines.append(" ".join(words))
    sets = [{x[k : k + line_dedup.SHINGLE] for k in range(len(x) - line_dedup.SHINGLE + 1)} for x in lines]
    texts = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    pairs = spark.createDataFrame([(g[-1], k) for g in stars for k in g[:-1]], "hub bigint, id bigint")
    scratch = Scratch(spark, "test", tidy=True)
    found = scratch.save(line_dedup.judged(pairs, texts))
    comps = scratch.save(connected_components(line_dedup._links(found)))
    of = {r["node"]: r["component"] for r in comps.collect()}
    held = scratch.save(line_dedup.open_lines(found, comps))
    got = {(r["hub"], r["id"]) for r in line_dedup.rest_pairs(held, texts, scratch).collect()}
    like = lambda a, b: len(sets[a] & sets[b]) >= line_dedup.THRESHOLD * len(sets[a] | sets[b])
    # two of a star that are both in the hub's component need no link
    want = {(a, b) for g in stars for a in g[:-1] for b in g if b < a and of.get(a, a) != of.get(b, b) and like(a, b)}
    assert want and want <= got and len(got) <= 2 * len(want) + 20


def test_tidy_scratch_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before = files()
    out = Scratch(spark, "test", tidy=True).save(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and out.count() == 10


def test_line_dedup_cases(docs, clash, empty):
    for df in (docs, clash):
        out = line_dedup.dedup_lines(df, counts="n_lines" not in df.columns)
        assert set(df.columns) <= set(out.columns) and out.count() == len(CASES)
        of = {r["doc_id"]: r["text"] for r in out.collect()}
        assert of[None] == BASE and of[1] == of[2] == ""  # the null id sorts first and keeps the line
        assert (of[4], of[5]) == (None, "")
        assert of[10] == prose(4, 30) + "\n" + prose(5, 30) + "\n"  # the third line repeats the first
    assert line_dedup.dedup_lines(empty).count() == 0


# ------------------------------------------------------------------ 8


def test_lm_base_score_and_probabilities(spark, docs, clash, empty):
    for df in (docs, clash):
        got = maxent_lm.score(df, ~held_out("doc_id", 10) & F.col("doc_id").isNotNull()).collect()
        tok = [(c[0], (c[1] or "").encode().lower().split() + [b""]) for c in CASES]
        count = collections.Counter(w for i, ws in tok if i is not None and zlib.crc32(str(i).encode()) % 10 for w in ws)
        n, v = sum(count.values()), len(count)
        want = collections.Counter((i, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tok)
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert maxent_lm.score(empty, F.lit(True)).count() == 0
    assert all(math.isfinite(r["score"]) for r in maxent_lm.score(docs, F.lit(False)).collect())


def test_lm_probabilities_sum_to_one():
    vocab = [b"", b"the", b"cat", b"sat", b"mat", b"on"]
    tokens, distinct = np.zeros(maxent_lm.CLASSES, np.int64), np.zeros(maxent_lm.CLASSES, np.int64)
    counts = dict(zip(vocab, (3, 9, 4, 2, 1, 5)))
    for t, c in counts.items():
        tokens[maxent_lm.tail_class(t)] += c
        distinct[maxent_lm.tail_class(t)] += 1
    classes = maxent_lm.Classes([(t, counts[t]) for t in (b"", b"the", b"on")], tokens, distinct)
    cls, _ = classes.local(pa.array(vocab, pa.binary()))
    inside = collections.defaultdict(float)
    for t, c in zip(vocab, cls):
        inside[c] += (counts[t] + maxent_lm.ADD) / classes.below[c]
    for c in range(maxent_lm.CLASSES):
        if classes.kinds[c]:
            rest = maxent_lm.ADD / classes.below[c] if c > maxent_lm.HEAD_CLASSES else 0.0
            assert abs(inside[c] + rest - 1) < 1e-9


def test_lm_beats_its_base_on_held_out_text(spark):
    out = maxent_lm.op8_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


# ------------------------------------------------------------------ 9


def test_sentencepiece_matches_the_library(spark, docs, clash, empty):
    model = sentencepiece_codec.model_bytes()
    lib = sentencepiece_codec.Codec(model).library
    want = collections.Counter()
    for c in CASES:
        ids = lib.encode(c[1] or "")
        want[(c[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += 1
    for df in (docs, clash):
        assert collections.Counter(tuple(r) for r in sentencepiece_codec.digests(df, model).collect()) == want
        both = sentencepiece_codec.decode(sentencepiece_codec.encode(df.withColumn("was", F.col("text")), model), model)
        assert both.where("text <> coalesce(was, '')").count() == 0 and both.count() == len(CASES)
    assert sentencepiece_codec.digests(empty, model).count() == 0


def test_sentencepiece_on_odd_strings():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    c = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())
    alphabet = st.sampled_from([*"ab \t\n▁é①中🙂\x00.,!²", "<s>", "the", "  ", "<0x0A>", "́", "mm²"]) | st.characters(codec="utf-8")

    @settings(max_examples=300, deadline=None)
    @given(st.lists(alphabet, max_size=60).map("".join))
    def same(s):
        assert c.encode(s) == c.library.encode(s) and c.decode(c.encode(s)) == c.library.decode(c.library.encode(s))
        assert c._merge_long(c.normalized(s)) == c._merge_short(c.normalized(s))

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.integers(3, 600), max_size=12))
    def same_text(ids):
        assert c.decode(ids) == c.library.decode(ids)

    same()
    same_text()


# ------------------------------------------------------------------ 10


def test_mixing_counts_follow_poisson(spark, docs, clash, empty):
    many = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' ELSE null END AS source", "1L AS n_chars")
    out = mixing.mix(many, {"a": 3.0, "b": 1.0}, rows=40000, other=0.0)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] - 30000) < 1000 and abs(n["b"] - 10000) < 700
    per = collections.Counter(r["doc_id"] for r in out.where("source = 'b'").collect())
    counts = [per.get(i, 0) for i in range(1, 4000, 3)]
    assert abs(np.var(counts) / np.mean(counts) - 1) < 0.15
    assert sorted(out.collect()) == sorted(mixing.mix(many.repartition(7), {"a": 3.0, "b": 1.0}, rows=40000).collect())
    for df in (docs, clash):
        got = mixing.mix(df, {"src0": 1.0, "gone": 5.0}, other=2.0, rows=200)
        assert set(got.columns) == set(df.columns) | {"copy"} and got.where("source is null").count() > 0
        same = [tuple(r) for r in got.where("doc_id = 10").groupBy("copy").count().collect()]
        assert all(c == 2 for _, c in same)  # the repeated row is drawn alike
    assert mixing.mix(empty, {"a": 1.0}).count() == 0 and mixing.mix(docs, {}, other=0.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": -1.0})


def near_lines(kind, n, seed):
    """Pairs of short lines of Jaccard similarity 0.8 to 0.95."""
    rng = np.random.default_rng(seed)
    letters, out = "abcdefghijklmnopqrstuvwxyz", []
    word = lambda: "".join(letters[i] for i in rng.integers(0, 26, int(rng.integers(4, 10))))
    grams = lambda x: {x[k : k + line_dedup.SHINGLE] for k in range(len(x) - line_dedup.SHINGLE + 1)}
    while len(out) < n:
        if kind == "cjk":
            a = "".join(chr(0x4E00 + i) for i in rng.integers(0, 5000, int(rng.integers(24, 33))))
            b = "界" + a[1:]
        elif kind == "numbered":
            a, b = (" ".join(ws) for ws in zip(*[(w, w) for w in (word() for _ in range(rng.integers(3, 10)))], (str(rng.integers(0, 10)), str(rng.integers(0, 10)))))
        else:
            ws = [word() for _ in range(rng.integers(9, 13))]
            at = int(rng.integers(0, len(ws)))
            a, b = " ".join(ws), " ".join(ws[:at] + [word()] + ws[at + 1 :])
        x, y = grams(a), grams(b)
        if min(len(a), len(b)) >= line_dedup.MIN_CHARS and 0.8 <= len(x & y) / len(x | y) <= 0.95:
            out.append((a, b))
    return out


def test_quality_rules_leave_prose_alone(spark):
    clean = ["The dialog in the second act", "The catalog in the library", "A modern design in oak.", "We read more books;", "A blog in Spanish", "Use List<String> for the names of all parts"]
    bad = ["Sign in", "click here", "Home | About | Contact |", "Log in | Sign up", "<div class='x'>", "All rights reserved 2020"]
    text = "\n".join([prose(3, 40), *clean, *bad])
    (out,) = quality_rules.clean(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert out["text"].split("\n")[1:] == clean


def test_sentencepiece_on_batches_that_end_in_spaces(spark):
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())
    rng = np.random.default_rng(3)
    bits = ["one", "two ", "three", " ", "  ", " \n", "\n", "\t", "é", "日本", "🙂", "12", "▁", "A.", ""]
    for i in range(1500):
        texts = ["".join(bits[k] for k in rng.integers(0, len(bits), int(rng.integers(0, 9)))) for _ in range(3)] + ["one  \n two", "three "]
        if i % 20 == 0:
            codec.known.clear()
        for t, parts in zip(texts, codec.learn(texts)):
            ids = [k for p in parts for k in np.frombuffer(codec.known[p][3], np.int32).tolist()]
            assert ids == codec.library.encode(t) and codec.decode(ids) == codec.library.decode(ids)
            assert b"".join(codec.known[p][2] for p in parts)[1:].decode() == codec.library.decode(ids)


@pytest.mark.parametrize("kind", ["cjk", "numbered", "word"])
def test_line_dedup_finds_short_near_lines(spark, kind):
    pairs = near_lines(kind, 150, 3)
    rows = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    missed = sum(got[2 * i + 1] != "" for i in range(len(pairs)))
    print(kind, "missed", missed, "of", len(pairs))
    assert missed <= (0 if kind != "word" else 1) and all(got[2 * i] == p[0] for i, p in enumerate(pairs))


def test_line_dedup_keeps_rows_of_shared_ids_apart(spark):
    for shared in (None, 7):
        texts = [f"{prose(100 + i, 20)}\n{prose(200 + i, 20)}\n{prose(300 + i, 20)}" for i in range(10)]
        double = texts[0] + "\n" + texts[0].split("\n")[1]  # its fourth line repeats its second
        same = prose(400, 20)
        rows = [(shared, x + "\n" + prose(500 + i, 20)) for i, x in enumerate(texts[1:])] + [(shared, double), (shared, same + "\n" + prose(601, 20)), (shared, same + "\n" + prose(602, 20))]
        got = collections.Counter(r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
        assert all(got[x] == 1 for _, x in rows[:9]) and got[texts[0]] == 1
        assert sum(same in x for x in got) == 1 and prose(601, 20) in "\n".join(got) and prose(602, 20) in "\n".join(got)


def test_line_dedup_removes_exact_repeats_of_short_lines(spark):
    rows = [(1, "今日は天気がいい\n \nHome page\n" + prose(1, 20)), (2, "Home page\n \n今日は天気がいい\nHome pages"), (3, None), (None, "今日は天気がいい")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), short=True).collect()}
    assert got == {None: "今日は天気がいい", 1: " \nHome page\n" + prose(1, 20), 2: " \nHome pages", 3: None}


def test_line_signatures_take_one_pass(spark):
    """Lines of every kind are signed by one scan and one shuffle; only those that need all their shingles keep a text."""
    long, wide, flat = prose(7, 120), "word " * 5 + "x" * 400, "🙂日é" * 20
    rows = [(1, "\n".join([long, "a line of some forty characters, no more", flat])), (2, long + "\n" + wide)]
    lines = line_dedup._lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    signed = line_dedup.signed(lines)
    plan = signed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan ExistingRDD") == 1 and "SortAggregate" not in plan
    got = {(r["line"], r["n"], all(r[f"b{j}"] is None for j in range(line_dedup.BANDS))) for r in signed.collect()}
    assert got == {(None, 2, False), (rows[0][1].split("\n")[1], 1, True), (flat, 1, True), (wide, 1, False)}
    for line, n in spark.createDataFrame([(x,) for x in (long, wide, flat)], "line string").select("line", F.size(line_dedup.grams(F.col("line")))).collect():
        assert n == len({line[k : k + line_dedup.SHINGLE] for k in range(len(line) - line_dedup.SHINGLE + 1)})


def test_line_parts_hold_a_band_in_common(spark):
    """Two sets have a band in common for each part of the hashes in which they are equal and not empty."""
    rng = np.random.default_rng(23)
    some = lambda n: [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)]
    for low, _, parts in line_dedup.parted()[4:]:
        rows, want, starts = [], [], line_dedup.starts_of(parts)
        for _ in range(20):
            same = some(low - (parts - 1) // 2)
            a, b = (sorted(same + some((parts - 1) // 2)) for _ in "ab")
            rows.append((len(rows), a, b))
            cut = [[tuple(x for x in v if s <= x < e) for s, e in zip(starts, [*starts[1:], 1 << 63])] for v in (a, b)]
            want.append(sum(x == y != () for x, y in zip(*cut)))
        df = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>")
        got = df.select("k", *[F.filter(line_dedup._dealt(F.col(x), low, parts), lambda v: v.isNotNull()).alias(x) for x in "ab"]).orderBy("k").collect()
        assert [len(set(r["a"]) & set(r["b"])) for r in got] == want and sum(want) > 20


def test_surrogates_take_whole_secrets_and_all_digits():
    key, jwt = "k9" * 450, "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSM_x-y"
    for text, value in ((f"token={key} end", key), (f'token = "{jwt}"', jwt), (f"token: {jwt}.", jwt), ("password: Tr0ub!dor&3xyzabc", "Tr0ub!dor&3xyzabc"), ("password='two words, here'", "two words, here")):
        ((start, end, kind, canon),) = surrogates.find(text)
        assert (text[start:end], kind, canon) == (value, "secret", value)
        new = surrogates.dressed(value, kind, surrogates.surrogate(b"k", kind, canon))
        assert len(new) == len(value) and new != value
    assert surrogates.find("token=abcdefgH")[0][3] != surrogates.find("token=abcdefgh")[0][3]
    assert surrogates.surrogate(b"k", "secret", "!!!!!!!!") != "!!!!!!!!"
    text = "٤١١١١١١١١١١١١١١١"
    ((start, end, kind, canon),) = surrogates.find(text)
    assert (kind, canon) == ("card", "4111111111111111")
    new = surrogates.dressed(text, kind, surrogates.surrogate(b"k", kind, canon))
    assert new != text and surrogates.find(new)[0][2] == "card" and all("٠" <= c <= "٩" for c in new)


def test_surrogates_leave_lower_case_words_alone(spark):
    rows = [(1, "доктор пришёл домой. Мы идём домой."), (2, "Herr über alles, Mr ülkü and Dr. şimdi"), (3, "Herr Über kam; доктор Иванов пришёл. Κύριος Dr Ωμέγα Άλφα")]
    got = {r["doc_id"]: r["text"] for r in surrogates.pseudonymize(spark.createDataFrame(rows, "doc_id bigint, text string"), b"k").collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1]
    assert "Über" not in got[3] and "Иванов" not in got[3] and "Ωμέγα" not in got[3] and "пришёл" in got[3] and " kam; доктор " in got[3]


def test_surrogates_keep_one_person_one(spark):
    text = "Mr. John Smith met. John Smith said; Mr Smith left. Dr. John Smith and SMITH? Smith. Frau Ελένη Παπαδοπούλου, Herr 王小明, Dr أحمد. Mrs. Mary Smith"
    rows = [(1, text), (2, "Dr. Smith"), (3, "Smith without a title"), (4, "call 555-123-4567 or 030 1234567, at 2001:db8::8a2e:370:7334")]
    got = {r["doc_id"]: r["text"] for r in surrogates.pseudonymize(spark.createDataFrame(rows, "doc_id bigint, text string"), b"k").collect()}
    names = re.findall(r"(?:Mr\.|Dr\.|met\.) (\w+) (\w+)", got[1])
    assert len(set(names)) == 1 and "Smith" not in got[1] and "John" not in got[1] and "Mary" not in got[1]
    family = names[0][1]
    assert got[1].count(family) == 6 and f"Mr {family} left" in got[1] and got[2] == f"Dr. {family}" and got[3] == rows[2][1]
    assert re.search(r"Frau [Ͱ-Ͽἀ-῿]+ [Ͱ-Ͽ]+, Herr [一-鿿]{2,}, Dr [؀-ۿ]+\.", got[1]) and "王小明" not in got[1]
    assert re.fullmatch(r"call \d{3}-\d{3}-\d{4} or \d{3} \d{7}, at 2001:[0-9a-f]+::[0-9a-f:]+", got[4]) and not any(x in got[4] for x in ("555-123", "1234567", "8a2e"))


def test_surrogates_of_many_family_names_are_distinct(spark):
    """Twenty thousand names, over all scripts' candidates: distinct, and none of them a real one."""
    from cortexloom.plans.scratch import Scratch

    ents = [("family", f"name{i}") for i in range(20000)]
    moved = {r["canon"]: r["attempt"] for r in surrogates.collisions(spark.createDataFrame(ents, "kind string, canon string"), b"k", Scratch(spark, "t")).collect()}
    final = [surrogates.surrogate(b"k", k, c, moved.get(c, 0)) for k, c in ents]
    assert len(set(final)) == len(ents) and not set(final) & {c for _, c in ents}


def test_surrogates_of_a_full_range_are_a_permutation(spark):
    from cortexloom.plans.scratch import Scratch

    ents = [("phone", f"+49{i:02d}") for i in range(100)]
    moved = {(r["kind"], r["canon"]): r["attempt"] for r in surrogates.collisions(spark.createDataFrame(ents, "kind string, canon string"), b"k", Scratch(spark, "t"), 2).collect()}
    final = [surrogates.surrogate(b"k", k, c, moved.get((k, c), 0)) for k, c in ents]
    assert len(set(final)) == 100 and all(a != c for a, (_, c) in zip(final, ents))
    for head in ("192.168.{}.{}", "10.0.{}.{}"):
        every = [head.format(i // 256, i % 256) for i in range(0, 65536, 9)]
        new = [surrogates.permuted(b"k", "ipv4", x) for x in every]
        assert len(set(new)) == len(every) and all(a != b for a, b in zip(new, every))
        assert all(x.startswith(head.split("{")[0].removesuffix("0.")) for x in new)


def test_lm_texts_come_in_small_batches(spark, monkeypatch):
    pack = maxent_lm._pack

    def watched(batches):
        def small():
            for b in batches:
                assert b.nbytes <= 4 * maxent_lm.BATCH_BYTES
                yield b

        return pack(small())

    monkeypatch.setattr(maxent_lm, "_pack", watched)
    docs = spark.range(40).repartition(1).selectExpr("id AS doc_id", "repeat(concat(repeat('w', 999), id % 7, ' '), 1000) AS text")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    got = maxent_lm.score(docs, F.col("doc_id") % 10 != 0).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(40)) and {r["n_tokens"] for r in got} == {1001}
    assert spark.conf.get(key) == before
