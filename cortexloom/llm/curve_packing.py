"""Packing token sequences along a space-filling curve, so that similar documents share a sequence.

Every document is tokenized, ended with one more id, and placed: its token ids are hashed into a
signed count vector, damped by a square root, scaled to length one and projected to a few dimensions.
Centred and scaled by the corpus' mean and deviation, the projection is a cell of a grid, and the
cell's place on a Hilbert curve is the document's key. Documents are range-sorted by key, and the
sorted corpus is one stream of tokens that is cut every ``length`` ids. The last, incomplete sequence
is cut into powers of two, which need no padding: nothing at all is padded, and only documents at an edge
are cut.

The tokenized table is written once, and everything after it reads that. Ranges are
quantiles of (key, hash of the row), so copies that share a key are split; their token totals give
each range its first position before the rows are moved, so that one shuffle sorts and numbers
them. Only one row of sums, one quantile and one total a range come to the driver. All arithmetic
on keys is on integers, so every pass gives a row the same range.

Texts are split at ASCII space, across which this kind of vocabulary (white space dropped, word
ends marked) never merges; every distinct word goes through the tokenizers library once a worker, and a
whole text of each batch is compared with the library's own result.

Defined cases: a null text counts as empty, and an empty text is the end id alone. Null and
repeated ids, and repeated rows, are documents of their own. An empty table gives an empty result. Only the id
and the text are read, whatever other columns are called. A vocabulary whose words run across
white space is refused with ValueError when a text shows it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import operator
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm._text import pieces, raw, table
from cortexloom.plans.scratch import Scratch

#: Hashed vector components; dimensions and bits a dimension of the curve; bits that tell rows of one cell apart. Places have 52 bits, since quantiles are doubles.
BUCKETS, DIMS, BITS, SPLIT = 256, 4, 8, 20
#: Tokens that a range should hold, and the most ranges there are.
RANGE_TOKENS, MAX_RANGES = 1 << 23, 50_000
#: Quantiles of rows that a range is put together from.
FINE = 16
#: Distinct words in each of the two halves of a worker's memory; when one is full the older one goes, which costs time only.
REMEMBERED = 800_000
#: What stands between words that are encoded as one text: a character for private use.
EDGE = "\ue000"
#: What a word may end in that a letter is never joined to.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_PIECE = 4 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes of integers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


#: The projection: a sign for each component and dimension.
PROJECTION = 1 - 2 * (_mixed(np.arange(1, 1 + BUCKETS * DIMS)) & np.uint64(1)).astype(np.int64).reshape(BUCKETS, DIMS)


def _ends_in_letter(word: bytes) -> bool:
    """Whether the last character is a letter in composed lower case too (some become a letter and a mark)."""
    return word[-1:].isalpha() or word[-1] > 127 and unicodedata.normalize("NFC", word.decode()[-1]).lower()[-1].isalpha()


class Words:
    """A vocabulary of the tokenizers library, given as its JSON text, with the words met so far."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        #: How ids are held: in two bytes where all of them fit.
        self.kind = "<u2" if max(self.library.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.added = re.compile(b"|".join([re.escape(t.content.encode()) for t in self.library.get_added_tokens_decoder().values()]) or b"(?!)")
        self.mark = self._ids(EDGE)
        self.final = np.zeros(1 + max(self.library.get_vocab(with_added_tokens=True).values(), default=0), bool)
        suffix = json.loads(vocabulary)["model"].get("end_of_word_suffix")
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.final[i] = bool(suffix) and token.endswith(suffix)
        self.places = hashed(np.arange(1 + max(self.library.get_vocab(with_added_tokens=True).values(), default=0)))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def packed(self, text: bytes) -> bytes:
        return self._ids(text.decode()).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Words many at a time, as one text with a mark between them that no word holds and whose ids only it can have.

        A word that ends in marks after a letter has the ids of the two, so ``word,`` needs nothing once ``word`` is known.
        """
        if len(self.known) + len(new) > REMEMBERED:  # words that come again are taken back from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        again = [w for w in new if w in older]
        known.update(zip(again, [older[w] for w in again]))
        new = [w for w in new if w not in older]
        whole = self.added.search(b" ".join(new)) is not None  # ids of their own, which a cut would break
        cut = {w: n for w in new if 0 < (n := len(w.rstrip(MARKS))) < len(w) and _ends_in_letter(w[:n]) and not (whole and self.added.search(w))}
        parts = {p for w, n in cut.items() for p in (w[:n], w[n:])}
        parts.update([w for w in new if w not in cut])
        self._ask([p for p in parts if p not in known])
        known.update({w: known[w[:n]] + known[w[n:]] for w, n in cut.items()})

    def _ask(self, new: list[bytes]) -> None:
        """Get the ids of new words. Words of letters end where an id ends a word; between others stands a mark that no word holds."""
        texts = [w.decode() for w in new]
        letters = [t for t in texts if t.isalpha()]
        for at in range(0, len(letters), 1024):
            some = letters[at : at + 1024]
            joined = self._ids(" ".join(some))
            stops = np.flatnonzero(self.final[joined]) + 1
            if len(stops) == len(some):  # a word has one end at least, so each has one
                self._keep(some, joined, [0, *stops.tolist()], stops.tolist())
            else:
                self._marked(some)
        self._marked([t for t in texts if not t.isalpha()])

    def _marked(self, new: list[str]) -> None:
        mark = self.mark
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            text = f" {EDGE} ".join(some)
            joined = self._ids(text)
            hits = np.flatnonzero(np.logical_and.reduce([joined[i : len(joined) - len(mark) + 1 + i] == m for i, m in enumerate(mark)])) if len(joined) >= len(mark) else []
            if text.count(EDGE) != len(some) - 1 or len(hits) != len(some) - 1:
                self.known.update({t.encode(): self.packed(t.encode()) for t in some})
            else:
                self._keep(some, joined, [0, *(hits + len(mark)).tolist()], [*hits.tolist(), len(joined)])

    def _keep(self, some: list[str], joined: np.ndarray, begins: list[int], ends: list[int]) -> None:
        data, size = joined.tobytes(), joined.itemsize
        self.known.update({t.encode(): data[lo * size : hi * size] for t, lo, hi in zip(some, begins, ends)})

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``kind``."""
        split = [t.split() for t in texts]
        get = self.known.get
        found = [list(map(get, words)) for words in split]
        lack = [i for i, got in enumerate(found) if None in got]
        if lack:
            new: set[bytes] = set()
            for i in lack:
                new.update(itertools.compress(split[i], map(operator.not_, found[i])))
            self._learn(list(new))
            known, older = self.known, self.older
            for i in lack:
                got, words, k = found[i], split[i], -1
                for _ in range(got.count(None)):
                    k = got.index(None, k + 1)
                    got[k] = known[words[k]] if words[k] in known else older[words[k]]
        out = list(map(b"".join, found))
        i = min(range(len(texts)), key=lambda k: (len(texts[k]) > 1 << 16, len(texts[k]) == 0, k), default=None)
        if i is not None and len(texts[i]) <= 1 << 20 and out[i] != self.packed(texts[i]):
            raise ValueError("the ids of this vocabulary depend on more than single words")
        return out


_WORDS: dict[str, Words] = {}


def words_of(vocabulary: str) -> Words:
    """The worker's words of a vocabulary, kept from task to task."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(vocabulary)
    return _WORDS[key]


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file, by default the public one of whole words; read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def hashed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component, sign) of the hashed vector that each id counts in."""
    h = _mixed(ids)
    return (h % np.uint64(BUCKETS)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.int64)


def projected(bucket: np.ndarray, sign: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The projections of documents whose ids' components and signs lie one after the other, as integers of about 16 bits."""
    out = np.zeros((len(sizes), DIMS), np.int64)
    ends = np.cumsum(sizes)
    for at in range(0, len(sizes), 1024):  # a block's vectors are BUCKETS numbers a document
        n = sizes[at : at + 1024]
        lo, hi = ends[at] - sizes[at], ends[at + len(n) - 1]
        cell = np.repeat(np.arange(len(n)), n) * BUCKETS + bucket[lo:hi]
        count = np.bincount(cell, sign[lo:hi], len(n) * BUCKETS).astype(np.int64).reshape(-1, BUCKETS)
        v = np.sign(count) * np.floor(np.sqrt(np.abs(count)) * 1024).astype(np.int64)
        norm = np.maximum(1, np.floor(np.sqrt((v * v).sum(axis=1)))).astype(np.int64)
        out[at : at + 1024] = (v @ PROJECTION << 16) // norm[:, None]
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of grid coordinates below 2**bits (Skilling's transposed form)."""
    x = [c.astype(np.int64) for c in cells.T]
    for k in range(bits - 1, 0, -1):
        low = (1 << k) - 1
        for i in range(len(x)):
            high = (x[i] >> k & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> k & 1, (1 << k) - 1, 0)
    key = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c ^ flip) >> k & 1
    return key


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids, p0 ..): every document's ids, end id included, in two or four bytes each, and its projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        end, size = np.array([end_id], words.kind).tobytes(), int(words.kind[-1])
        for b in pieces(batches, _PIECE):
            packed = [x + end for x in words.encode([t or b"" for t in raw(b.column(1))])]
            sizes = np.array([len(x) // size for x in packed], np.int64)
            ids = np.minimum(np.frombuffer(b"".join(packed), words.kind), len(words.places[0]) - 1)
            p = projected(words.places[0][ids], words.places[1][ids], sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(packed, pa.binary()), *[pa.array(c) for c in p.T]], ["id", "n", "ids", *[f"p{i}" for i in range(DIMS)]])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, ids binary" + "".join(f", p{i} bigint" for i in range(DIMS)))


def _ordered(rows: DataFrame, mean: list[int], deviation: list[int], bounds: list[int], keep: list[str]) -> DataFrame:
    """``keep`` of ``rows``, with ``place`` (Hilbert key, then a hash of id and row number) and its range."""
    cut = np.array(bounds, np.int64)
    m, sd = np.array(mean), np.array(deviation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False)
            p = np.stack([col(f"p{i}") for i in range(DIMS)], axis=1)
            side = 1 << BITS
            cell = np.clip((p - m) * (side // 6) // sd + side // 2, 0, side - 1)  # three deviations to each side
            low = SPLIT // 2
            part = ((_mixed(col("id")) >> np.uint64(64 - SPLIT + low)) << np.uint64(low)) | (_mixed(col("row")) >> np.uint64(64 - low))
            place = hilbert(cell, BITS) << SPLIT | part.astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(place), pa.array(np.searchsorted(cut, place, "right"), pa.int32())], [*keep, "place", "range"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    need = list(dict.fromkeys([*keep, "id", "row", *[f"p{i}" for i in range(DIMS)]]))
    return rows.select(need).mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in keep], "place bigint", "range int"]))


def _pieces(first: list[int], total: int, length: int):
    """Cut the sorted documents of each range at the edges of the sequences. ``first``: each range's first position."""
    whole = total // length
    rest = total - whole * length
    edges = np.cumsum([0] + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]) + whole * length

    def sequence(at: np.ndarray) -> np.ndarray:
        return np.where(at < whole * length, at // length, whole + np.searchsorted(edges, at, "right") - 1)

    def edge(s: np.ndarray) -> np.ndarray:
        return np.where(s <= whole, s * length, edges[np.clip(s - whole, 0, len(edges) - 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = -1, 0
        for b in pieces(batches, _PIECE):
            if not b.num_rows:
                continue
            ranges, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            begin = np.zeros(len(n), np.int64)
            for lo in np.flatnonzero(np.diff(ranges, prepend=-1)):  # runs of one range
                hi = lo + np.count_nonzero(ranges[lo:] == ranges[lo])
                at = at if ranges[lo] == now else first[ranges[lo]]
                now = ranges[lo]
                begin[lo:hi] = at + np.cumsum(n[lo:hi]) - n[lo:hi]
                at += int(n[lo:hi].sum())
            one, last = sequence(begin), sequence(begin + n - 1)
            times = last - one + 1
            doc = np.repeat(np.arange(len(n)), times)
            seq = one[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
            lo, hi = np.maximum(begin[doc], edge(seq)), np.minimum((begin + n)[doc], edge(seq + 1))
            data = b"".join(b.column(3).to_pylist())  # the pieces follow one another as the documents do
            data = np.frombuffer(data, f"<u{len(data) // int(n.sum())}").astype("<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(hi - lo)]) * 4
            ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(doc)), pa.array(lo - begin[doc]), pa.array(hi - lo), ids, pa.array(n[doc]), pa.array(seq), pa.array(lo - edge(seq))],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all sequences.

    ``ids`` are little-endian unsigned 32-bit numbers. Sequences are numbered along the curve; all are ``length``
    ids long but the last few, which are falling powers of two.
    """
    spark = docs.sparkSession
    rows = Scratch(spark, "packing").save(tokenized(docs, vocabulary, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokenized")
    wide = [F.col(f"p{i}").cast("decimal(20,0)") for i in range(DIMS)]
    sums = rows.agg(F.count("*"), F.sum("n"), *[F.sum(c) for c in wide], *[F.sum(c * c) for c in wide]).first()
    count, total = sums[0], int(sums[1] or 0)
    mean = [int(s or 0) // max(1, count) for s in sums[2 : 2 + DIMS]]
    deviation = [max(1, math.isqrt(max(0, int(q or 0) // max(1, count) - m * m))) for q, m in zip(sums[2 + DIMS :], mean)]
    ranges = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / RANGE_TOKENS)))
    places = _ordered(rows, mean, deviation, [], ["n"])
    fine = min(MAX_RANGES, FINE * ranges)  # quantiles of rows, put together to ranges of about as many tokens
    at = [i / fine for i in range(1, fine)]
    bounds = sorted(set(places.agg(F.percentile_approx("place", at, max(10_000, 10 * fine))).first()[0] or [])) if at else []
    totals = dict(_ordered(rows, mean, deviation, bounds, ["n"]).groupBy("range").agg(F.sum("n")).collect())  # a row of each quantile
    start = np.cumsum([0] + [totals.get(r, 0) for r in range(len(bounds))])
    head = np.flatnonzero(np.diff(start * ranges // max(1, total), prepend=-1))
    first, bounds = start[head].tolist(), [bounds[h - 1] for h in head[1:]]
    dealt = _ordered(rows, mean, deviation, bounds, ["id", "row", "n", "ids"]).repartitionById(len(bounds) + 1, F.col("range"))
    dealt = dealt.sortWithinPartitions("range", "place", "id", "row").select("range", "id", "n", "ids")
    out = dealt.mapInArrow(_pieces(first, total, length), "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", "doc_id")


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), vocabulary_text())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
