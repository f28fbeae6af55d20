"""Curve packing, token alignment and vector codes: against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cortexloom.llm import curve_packing, queries, token_alignment, vector_codes
from cortexloom.llm.sentencepiece_codec import model_bytes

from test_operators import CASES, SCHEMA

ODD = [
    *CASES,
    (20, "café   naïve\n\n\tcafé 龘🙂👩‍👩 \x00 \x1c|\x85| \xa0nbsp　wide", "en", "a", 1),
    (21, "<|endoftext|> <s>x</s> <unk> <0x41> it's 'sabc don't;\r\n}\r x ", "en", "a", 1),
    (22, "a ▁ b", "en", "a", 1),  # B gives the visible space sign back as a space
    (23, "  two  spaces  ", "en", "a", 1),
    (24, " ", "en", "a", 1),
    (25, "\n", "en", "a", 1),
]
BITS = ["a", "Z", "word", "don't", " ", "  ", "\n", "\r", "\t", "\r\n", "\xa0", " ", "é", "é", "日本", "龘", "🙂", "👩‍👩", "\x00", "\x1c", "\x85", "▁", "<0x41>", "<|endoftext|>", "<s>", ";", "}", "12", "_", "'s", "​", "ﬁ", "�", "İ", "Σ", "!", ".", "क़"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for c in ("id", "ids", "n", "row", "range", "place", "links", "pair", "p0", "groups", "n_links"):  # names of the operators' own
        df = df.withColumn(c, F.lit("own"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ 11


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = curve_packing.hilbert(grid, bits)
    walk = grid[np.argsort(key)]
    assert sorted(key) == list(range(len(grid))) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def packed_as_it_should(pieces, rows, length=4096, end=2):
    """Every id of every document in exactly one piece, sequences gapless and not too long; returns the padding."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, text, *_ in rows:
        want[(i, np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4").tobytes())] += 1
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    padding = 0
    for v in sequences.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    got = collections.Counter()
    stream = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))  # a document's pieces follow one another
    buffer = b""
    for r in stream:
        assert r["start"] == len(buffer) // 4
        buffer += r["ids"]
        if len(buffer) == 4 * r["doc_tokens"]:
            got[(r["doc_id"], buffer)] += 1
            buffer = b""
    assert got == want and not buffer
    return padding


def test_packing_against_the_library(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = curve_packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), curve_packing.vocabulary_text()).collect()
    assert packed_as_it_should(out, rows) == 0
    digest = {tuple(r) for r in curve_packing.op11_curve_packing(spark, sf).collect()}
    assert digest == {(r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in out}


def test_packing_of_odd_rows(spark, docs, empty):
    out = curve_packing.pack(docs, curve_packing.vocabulary_text(), length=64).collect()
    assert packed_as_it_should(out, ODD, 64) == 0
    assert {r["doc_tokens"] for r in out if r["doc_id"] in (4, 5, 6, 24, 25)} == {1}
    assert curve_packing.pack(empty, curve_packing.vocabulary_text()).count() == 0


def test_packing_splits_copies_and_keeps_likes_together(spark):
    rows = [(i if i % 2 else None, "one text for all of them " * 20) for i in range(600)]
    topics = [[f"{w}{k}" for k in range(8)] for w in ("apple", "engine", "river", "violin")]
    rng = random.Random(3)
    mixed = [(1000 + i, " ".join(rng.choices(topics[i % 4], k=100))) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        copies = curve_packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), curve_packing.vocabulary_text())
        assert packed_as_it_should(copies.collect(), rows) == 0
        assert copies.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 150
        out = curve_packing.pack(spark.createDataFrame(mixed, "doc_id bigint, text string"), curve_packing.vocabulary_text(), length=2048).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    by = collections.defaultdict(collections.Counter)
    for r in out:
        by[r["sequence_id"]][r["doc_id"] % 4] += r["length"]
    full = [c for c in by.values() if sum(c.values()) == 2048]
    assert len(full) > 20 and sum(max(c.values()) for c in full) > 0.9 * 2048 * len(full)


def test_packing_words_equal_whole_texts():
    words, rng = curve_packing.Words(curve_packing.vocabulary_text()), random.Random(5)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 15))) for _ in range(1500)]
    assert words.encode([t.encode() for t in texts]) == [words.packed(t.encode()) for t in texts]


def test_packing_words_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(curve_packing, "REMEMBERED", 40)
    words, rng = curve_packing.Words(curve_packing.vocabulary_text()), random.Random(6)
    for _ in range(60):
        texts = [" ".join(f"w{rng.randint(0, 90)}" for _ in range(12)).encode() for _ in range(3)] + ["x\ue000y \ue000 z".encode(), b""]
        assert words.encode(texts) == [words.packed(t) for t in texts]


# ------------------------------------------------------------------ 12


def plain_alignment(rows):
    """The contract's columns by decoded bytes alone, on the driver."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet, per, count = token_alignment._byte_alphabet(), [], collections.Counter()
    for i, text, *_ in rows:
        found = None
        if text:
            ea, ids_b, whole = a.encode(" " + text, add_special_tokens=False), b.encode(text), (" " + text).encode()
            bytes_a = [bytes(alphabet[c] for c in t) for t in ea.tokens]
            bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
            if b"".join(bytes_a) == whole == b"".join(bytes_b):
                ends_a, ends_b = (list(np.cumsum([len(t) for t in x])) for x in (bytes_a, bytes_b))
                todo_a, todo_b, groups, links = list(zip(ea.ids, ends_a))[::-1], list(zip(ids_b, ends_b))[::-1], [], []
                for end in sorted(set(ends_a) & set(ends_b)):
                    one, two = [], []
                    while todo_a and todo_a[-1][1] <= end:
                        one.append(todo_a.pop()[0])
                    while todo_b and todo_b[-1][1] <= end:
                        two.append(todo_b.pop()[0])
                    groups.append(f"{','.join(map(str, one))}|{','.join(map(str, two))}")
                    links.append((one[-1], two[-1]))
                found = (len(ea.ids), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
                count.update(links)
        per.append((i, found))
    most = collections.Counter()
    for (_, k), n in count.items():
        most[k] = max(most[k], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, *f[:3], len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]), f[4]) for i, f in per]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def vocabularies():
    return curve_packing.vocabulary_text(public_tokenizers.path("byte_bpe_50k.json")), model_bytes()


def test_alignment_against_decoded_bytes(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = token_alignment.op12_token_alignment(spark, sf)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == sorted(plain_alignment(rows))


@pytest.mark.parametrize("share", [1, 40, 1 << 20])  # all pairs joined by a shuffle, some, none
def test_alignment_of_odd_rows(spark, docs, empty, vocabularies, tmp_path, share):
    def run(df, at):
        rows = token_alignment.aligned(df, *vocabularies)
        digest = F.when(F.col("groups").isNull(), "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
        rows.select("doc_id", "n_a", "n_b", "n_groups", digest, "links").write.parquet(str(tmp_path / at))
        rows = spark.read.parquet(str(tmp_path / at))
        return token_alignment.link_statistics(rows, token_alignment.aligner(*vocabularies).size_b, share).select(COLUMNS)

    assert sorted(map(tuple, run(docs, "odd").collect()), key=repr) == sorted(plain_alignment(ODD), key=repr)
    assert run(empty, "empty").count() == 0


def test_alignment_chunks_equal_whole_texts(vocabularies):
    own, rng = token_alignment.aligner(*vocabularies), random.Random(7)
    for _ in range(300):
        texts = ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(5)]
        own.known.clear()
        assert own.documents(texts) == [(own.align(" " + t) or [None])[0] if t else None for t in texts]


# ------------------------------------------------------------------ 13


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Integer product codes by the plain definition: (id, label) -> code and error, and the codebooks."""
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = math.ceil(max([len(v) for *_, v in ok], default=0) / parts)
    ok = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in ok]
    first = {}
    for i, _, v in ok:
        first[i] = min(first.get(i, v), v)
    start = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:entries]]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in start] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = collections.defaultdict(list)
            for *_, v in ok:
                mine[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, label, v in ok:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, [k for _, k in found], sum(d for d, _ in found)))
    return out, books


VECTORS = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("dim", [16, 40, 48, 130])
def test_codes_against_plain(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in rng.normal(size=dim).round(1)], int(i) % 3) for i in rng.permutation(150)]
    rows += [(3, rows[0][1], None), (3, rows[1][1], None), (None, rows[2][1], 1), (None, rows[3][1], None), (500, None, 1), (501, [float("nan")] * dim, 1), (502, [None] * dim, 1), (503, [float("inf")] * dim, 1), (-5, rows[4][1][: dim // 2], 7)]
    rows += [rows[5]] * 40
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("own")).withColumn("code", F.lit("own")).repartition(4)
    books = vector_codes.train(df)
    got = sorted(((r["id"], r["label"], list(r["code"]), r["error"]) for r in vector_codes.encode(df, books).collect()), key=repr)
    want, plain = plain_codes(rows)
    assert books.entries.tolist() == plain and got == sorted(want, key=repr)


def test_codes_of_few_huge_and_no_vectors(spark):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([[1e18, -1e18] * 16, [3e17, 5.0] * 16, [0.25, -0.001] * 16])]
    df = spark.createDataFrame(rows, VECTORS)
    books = vector_codes.train(df)
    want, plain = plain_codes(rows)
    assert books.entries.dtype == object and books.entries.tolist() == plain
    assert sorted((r["id"], r["label"], list(r["code"]), r["error"]) for r in vector_codes.encode(df, books).collect()) == sorted(want)
    none = spark.createDataFrame([(1, None, 0)], VECTORS)
    assert vector_codes.encode(none, vector_codes.train(none)).count() == 0
    assert vector_codes.encode(none.limit(0), vector_codes.train(none.limit(0))).count() == 0


def test_nearest_drops_no_tie():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 5, 8):
        x, e = rng.integers(-3, 4, (500, width)), rng.integers(-3, 4, (64, width))
        e[32:] = e[:32]
        d = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        code, dist = vector_codes.nearest(x, e)
        assert (code == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
    h = vector_codes.walsh(16)
    assert (h @ h.T == 16 * np.eye(16)).all() and [(np.diff(r) != 0).sum() for r in h] == list(range(16))


def test_group_sums_of_common_and_rare_keys(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vector_codes, "COMMON", 4)
    rows = [(i, "a" if i % 2 else (None if i % 3 else f"k{i}"), i) for i in range(60)]
    spark.createDataFrame(rows, "id int, k string, v bigint").write.parquet(str(tmp_path / "r"))
    got = vector_codes.with_group_sum(spark.read.parquet(str(tmp_path / "r")), "k", "v", "s").collect()
    want = collections.Counter()
    for _, k, v in rows:
        want[k] += v
    assert sorted((r["id"], r["s"]) for r in got) == [(i, want[k]) for i, k, _ in rows]


@pytest.mark.parametrize("n", [11, 12, 13])
def test_one_query_an_operator(n):
    assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1


def test_codes_against_sql(spark, duck, sf):
    theirs = duck.sql(vector_codes.OP13_SQL)
    cols = [d[0] for d in theirs.description]
    assert sorted(map(tuple, vector_codes.op13_vector_codes(spark, sf).select(cols).collect())) == sorted(theirs.fetchall())
