"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which ids answer to each other.

Vocabulary A is byte-level and gives character offsets; B is a sentencepiece vocabulary with byte
pieces and gives spans. Both sets of offsets are coarse cuts: they place every token that
ends at a character's end, but tokens that share a character, and byte pieces, only get the whole
character. Those are placed by the lengths of their decoded bytes. Every token's bytes are then compared
with the text's at the place found, so a text that one of the two doesn't give back byte
for byte is recognised, and has no tokens.

Both vocabularies split a text before a space that follows a word (for B this is read off its
pieces; white space that some piece joins to a word doesn't count) and between a letter and a mark
or digit after it, so a text is cut there into chunks, and every distinct chunk is aligned once a worker. A text with a chunk that does not come back is
aligned again as a whole, and one whole text of each batch is compared with its chunks.

Links are counted over the corpus in two steps. Tasks count their own pairs of ids, a shuffle adds the counts
up. Then each document needs the count of each of its pairs. Pairs that hold at least one link in ``SHARE``
are fewer than that by arithmetic: those are looked up where the documents are. All other links are joined by
a shuffle, in which no pair can be frequent enough to fill a partition. No pair and no document is left out.

Defined cases: null and empty texts, and texts that A or B do not give back, have no tokens, and
zeros. Null and repeated ids, and repeated rows, are documents of their own. An empty table gives an
empty result. Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm._text import pieces, raw, table
from cortexloom.llm.curve_packing import vocabulary_text
from cortexloom.llm.sentencepiece_codec import model_bytes
from cortexloom.plans.scratch import Scratch

#: The characters that Unicode calls white space.
WHITE = "\t-\r \x85\xa0  -     　"
#: A pair of ids is common from one link in so many on; at most so many pairs are.
SHARE = 1 << 20
#: Letters, and what may follow a word without a space: a cut between the two is one for A, and for B unless a piece holds both.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-@\[-`{-~"
#: Distinct chunks in each of the two halves of a worker's memory; when one is full the older one goes, which costs time only.
REMEMBERED = 125_000
_PIECE = 1 << 20
#: Rows of links are long: a writer buffers this much of them, not 128 MB a task.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20)}
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_alphabet() -> dict[str, int]:
    """The characters in which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def placed(cuts: np.ndarray, tokens: list[bytes], text: bytes) -> np.ndarray | None:
    """Where each token ends: at its coarse cut, or where that is -1, as many bytes after the cut before as the tokens since hold. None if the tokens do not spell the text."""
    spelt = np.cumsum([len(t) for t in tokens])
    last = np.maximum.accumulate(np.where(cuts >= 0, np.arange(len(cuts)), -1))
    ends = spelt + np.where(last >= 0, (cuts - spelt)[last], 0)
    return ends if (ends == spelt).all() and b"".join(tokens) == text else None


class Aligner:
    """Both vocabularies, and the chunks met so far."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sp = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = _byte_alphabet()
        self.a_bytes = {i: bytes([byte[c] for c in t]) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.size_b = len(names)
        self.b_bytes = [bytes([int(m[1], 16)]) if sp.is_byte(i) and (m := _BYTE.fullmatch(n)) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.b_byte = [sp.is_byte(i) for i in range(self.size_b)]
        self.chunks = re.compile(self._pattern([n.replace("▁", " ") for i, n in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]))
        self.white = re.compile(f"[{WHITE}]")
        self.word = re.compile(f"[{WHITE}]+[^{WHITE}▁]+")
        self.known: dict[str, tuple[int, int, int, bytes, bytes] | None] = {}
        self.older: dict[str, tuple[int, int, int, bytes, bytes] | None] = {}

    @staticmethod
    def _pattern(names: list[str]) -> str:
        """Cuts in front of white space after other characters, where no piece of B reaches across and the space of B's start joins nothing."""
        inside = {n[i + 1] for n in names for i in range(len(n) - 1) if re.match(f"[^{WHITE}][{WHITE}]", n[i : i + 2])}
        inside |= {n[i + 1] for n in names for i in range(len(n) - 1) if n[i] == " " and n[i + 1] != " " and re.match(f"[{WHITE}]", n[i + 1])}
        if " " in inside:
            return r"(?s).+"
        joined = "".join(f"\\u{ord(c):04x}" for c in sorted(inside))
        more = f"(?:[{joined}][{WHITE}]*[^{WHITE}]*)*" if joined else ""
        whole = f"[{WHITE}]*[^{WHITE}]+{more}|[{WHITE}]+"
        if any(re.search(f"[{LETTERS}][{MARKS}]", n) for n in names):
            return whole
        return f"[{WHITE}]*+[^{WHITE}{LETTERS}]*+[{LETTERS}]++(?=[{MARKS}])|{whole}"

    def tokens_a(self, text: str, own: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, where they end in the bytes of ``text``) by A."""
        found = self.a.encode(text, add_special_tokens=False)
        ids, spans = found.ids, np.array(found.offsets, np.int64).reshape(-1, 2)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
        clear = np.append(spans[1:, 0], len(text)) == spans[:, 1]  # the next token begins where this one ends, so no character is shared
        ends = placed(np.where(clear, at[spans[:, 1]], -1), [self.a_bytes[i] for i in ids], own)
        return None if ends is None else (np.array(ids), ends)

    def tokens_b(self, text: str, own: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """The same by B, which puts a space in front: the one that ``text`` begins with, or one that is no part of it. A mark that begins a text follows a letter, as in its document."""
        ahead = 1 if text[0] == " " else 0 if self.white.match(text) else -1
        found = self.b.encode(text[1:] if ahead == 1 else text if ahead == 0 else "a" + text, return_type="proto").pieces
        extra = 0
        if ahead < 1:
            while extra < len(found) and found[extra].end <= -ahead and found[extra].piece.strip("▁a") == "":
                extra += 1
            if not extra or found[extra - 1].end != -ahead:
                return None
        found, shift = found[extra:], ahead
        ids = [p.id for p in found]
        cuts = np.array([-1 if self.b_byte[p.id] else p.end + shift for p in found], np.int64)
        ends = placed(cuts, [self.b_bytes[i] for i in ids], own)
        return None if ends is None else (np.array(ids), ends)

    def align(self, text: str, parts: list[str] | None = None) -> list[tuple[int, int, int, bytes, bytes]] | None:
        """Of each part of a text (of the text itself, if none are given): tokens of A, of B, groups, groups as text, linked pairs as 64-bit a * size_b + b.

        None if the text does not come back, or if tokens reach across the edge of a part.
        """
        own = text.encode()
        found_a, found_b = self.tokens_a(text, own), self.tokens_b(text, own)
        if found_a is None or found_b is None:
            return None
        (ia, ea), (ib, eb) = found_a, found_b
        at = np.searchsorted(eb, ea)  # both end with the text
        x = np.flatnonzero(eb[at] == ea)
        common, x, y = ea[x], x + 1, at[x] + 1
        pairs = (ia[x - 1] * self.size_b + ib[y - 1]).astype(np.int64).tobytes()
        sa, sb, xs, ys = list(map(str, ia.tolist())), list(map(str, ib.tolist())), [0, *x.tolist()], [0, *y.tolist()]
        groups = [f"{','.join(sa[x0:x1])}|{','.join(sb[y0:y1])}" for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:])]
        edges = np.cumsum([len(p.encode()) for p in parts or [text]])
        g = np.searchsorted(common, edges)
        if (g >= len(common)).any() or (common[g] != edges).any():
            return None
        g = [0, *(g + 1).tolist()]
        return [(xs[q] - xs[p], ys[q] - ys[p], q - p, ";".join(groups[p:q]).encode(), pairs[8 * p : 8 * q]) for p, q in zip(g, g[1:])]

    def learn(self, chunks: list[str]) -> None:
        """Align new chunks: those that are white space and a word many at a time, as one text, the others one by one."""
        if len(self.known) + len(chunks) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update({c: self.older[c] for c in chunks if c in self.older})
        chunks = [c for c in chunks if c not in self.older]
        joins = [c for c in chunks if self.word.fullmatch(c)]
        for at in range(0, len(joins), 512):
            some = joins[at : at + 512]
            got = self.align("".join(some), some)
            self.known.update(zip(some, got) if got else [(c, (self.align(c) or [None])[0]) for c in some])
        for c in chunks:
            if c not in self.known:
                self.known[c] = (self.align(c) or [None])[0]

    def documents(self, texts: list[str]) -> list[tuple[int, int, int, bytes, bytes] | None]:
        """The same for whole texts, of which A gets a space in front as B does; None for empty ones too."""
        split = [self.chunks.findall(" " + t) if t else [] for t in texts]
        self.learn(list({c for cs in split for c in cs if c not in self.known}))
        known, older = self.known, self.older
        out: list[tuple[int, int, int, bytes, bytes] | None] = []
        for t, cs in zip(texts, split):
            try:
                got = [known[c] for c in cs]
            except KeyError:  # the memory was turned over in between
                got = [known[c] if c in known else older[c] for c in cs]
            if None in got:  # only the whole text can tell
                out.append((self.align(" " + t) or [None])[0])
            elif not got:
                out.append(None)
            else:
                a, b, n, groups, links = zip(*got)
                out.append((sum(a), sum(b), sum(n), b";".join(groups), b"".join(links)))
        i = min((k for k in range(len(texts)) if texts[k]), key=lambda k: (len(texts[k]) > 1 << 16, k), default=None)
        if i is not None and len(texts[i]) <= 1 << 20 and (self.align(" " + texts[i]) or [None])[0] != out[i]:
            raise ValueError("these vocabularies do not split a text at its spaces")
        return out


_ALIGNERS: dict[str, Aligner] = {}


def aligner(a: str, b: bytes) -> Aligner:
    """The worker's aligner of two vocabularies, kept from task to task."""
    key = hashlib.sha256(a.encode() + b).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a, b)
    return _ALIGNERS[key]


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>"


def aligned(docs: DataFrame, a: str, b: bytes, id_col: str = "doc_id", text_col: str = "text", then: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch, schema: str = ALIGNED) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links): ``groups`` as text, null without tokens; ``links`` the pairs a * (size of B) + b.

    A caller that needs less than the groups' text, which is longer than the documents, derives it with ``then``: a function on
    each batch of these columns, run where the batch is made, with the ``schema`` that it gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in pieces(batches, _PIECE):
            got = own.documents([t or "" for t in batch.column(1).to_pylist()])
            got = [(0, 0, 0, None, b"") if g is None else g for g in got]
            ends = np.cumsum([0] + [len(g[4]) // 8 for g in got])
            links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join([g[4] for g in got]), np.int64)))
            yield then(pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[i] for g in got], pa.int64()) for i in range(3)], pa.array([g[3] for g in got], pa.binary()).cast(pa.string()), links], ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"]))

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's own counts of its pairs, batch by batch."""
    _ALIGNERS.clear()  # texts are done: what the worker remembers of them only fills its memory
    for b in pieces(batches, _PIECE):
        pair, n = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n, pa.int64())], ["pair", "n"])


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): the links of every pair in the corpus, and whether that is the most that its id of B has."""
    n = rows.select("links").mapInArrow(_partial_counts, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    n = Scratch(rows.sparkSession, "pairs").save(n.withColumn("b", F.col("pair") % size_b))
    top = n.groupBy("b").agg(F.max("n").alias("most"))  # a row for an id of B at most: its vocabulary bounds the broadcast
    return n.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(rows: DataFrame, size_b: int, share: int = SHARE) -> DataFrame:
    """``rows`` (a written table with ``links``) with (n_links, n_best, count_sum) instead of its links."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "links")
    counts = scratch.save(pair_counts(rows, size_b), "counts")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / share
    top = counts.where(F.col("n") >= least).select("pair", "n", "best").orderBy("pair").toArrow()  # fewer than ``share`` rows
    sent = spark.sparkContext.broadcast([top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy().astype(np.int64)])
    kept = [c for c in rows.columns if c != "links"]
    more = ["row", "n_links", "n_best", "count_sum", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, ns, best = sent.value
        for b in pieces(batches, _PIECE):
            links = b.column(b.schema.get_field_index("links"))
            flat, sizes = links.flatten().to_numpy(), np.asarray(links.value_lengths())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            distinct, back = np.unique(flat, return_inverse=True)
            at = np.minimum(np.searchsorted(pairs, distinct), max(0, len(pairs) - 1))
            hit = pairs[at] == distinct if len(pairs) else np.zeros(len(distinct), bool)
            n, is_best, rare = (np.where(hit, ns[at], 0), np.where(hit, best[at], 0), ~hit[back]) if len(pairs) else (np.zeros(len(distinct), np.int64),) * 2 + (np.ones(len(flat), bool),)
            total, good = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(total, doc, n[back])
            np.add.at(good, doc, is_best[back])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(sizes)))])
            left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[rare]))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + [b.column(b.schema.get_field_index("row")), pa.array(sizes, pa.int64()), pa.array(good), pa.array(total), left], [*kept, *more])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in kept], "row bigint, n_links bigint, n_best bigint, count_sum bigint, rare array<bigint>"])
    part = scratch.save(numbered.mapInArrow(run, schema), "common", **SMALL_GROUPS)
    rest = part.select("row", F.explode("rare").alias("pair")).join(counts.where(F.col("n") < least), "pair")
    rest = rest.groupBy(F.col("row").alias("_row")).agg(F.sum("n").alias("_n"), F.sum(F.col("best").cast("bigint")).alias("_best"))
    add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return part.join(rest, F.col("row") == F.col("_row"), "left").select(*kept, "n_links", add("n_best", "_best"), add("count_sum", "_n"))


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """SHA-256 of the groups instead of their text."""
    sha = [hashlib.sha256(g).hexdigest() if g is not None else "" for g in raw(batch.column(4))]
    return batch.set_column(4, "groups_sha256", pa.array(sha, pa.string()))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = vocabulary_text(public_tokenizers.path("byte_bpe_50k.json")), model_bytes()
    rows = aligned(table(spark, sf_dir, "documents"), a, b, then=_digests, schema=ALIGNED.replace("groups string", "groups_sha256 string"))
    return link_statistics(Scratch(spark, "alignment").save(rows, "links", **SMALL_GROUPS), aligner(a, b).size_b)
