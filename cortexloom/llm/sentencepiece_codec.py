"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece that the
pair would form (then from left to right). The best pair is merged, its neighbours form new
pairs, and so on until no pair is in the vocabulary; symbols without a piece become byte pieces.
No piece of such a vocabulary reaches across the start of a word, so the agenda runs on one
word at a time and each distinct word is merged once per worker. All words that a worker meets
for the first time in an Arrow batch are checked against the sentencepiece library before they
are used; a difference stops the job.

The vocabulary file's bytes travel with the task (they are small and fixed), so executors need
no local copy.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import math
import re
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cortexloom.llm._text import pieces, table

_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_LETTER = r"[^\W\d_²³¹]"
#: Ways to cut a text where no merge can cross, finest first: at word starts and between letters and other characters; at word starts; nowhere.
_PARTS = (
    f"{_SPACE}*{_LETTER}+|(?:(?!{_LETTER}){_SPACE})+(?:(?!{_LETTER})[^{_SPACE}])*|(?:(?!{_LETTER})[^{_SPACE}])+",
    f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+",
    r"(?s).+",
)
#: Distinct words that a worker remembers; when full it starts anew, which costs time only.
REMEMBERED = 400_000
_PIECE = 4 << 20  # bytes of a batch worked on at a time


codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Codec:
    """Encoder and decoder of one vocabulary, given as the bytes of a ``.model`` file."""

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.byte_ids = {int(m[1], 16): i for i, n in enumerate(names) if sp.is_byte(i) and (m := _BYTE.fullmatch(n))}
        self.unk = sp.unk_id()
        self.bytes_of = [b""] * len(names)
        for i in plain:
            self.bytes_of[i] = names[i].replace(_SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        if 0 <= self.unk < len(names):
            self.bytes_of[self.unk] = " ⁇ ".encode()
        self.parts = next(p for p in map(re.compile, _PARTS) if self.safe(p))
        self.known: dict[str, tuple[int, bytes, bytes, bytes]] = {}

    def safe(self, parts: re.Pattern) -> bool:
        """Whether no piece reaches across an edge at which ``parts`` cuts."""
        joined = {n[i : i + 2] for n in self.ids for i in range(len(n) - 1)}
        return all(len(parts.findall(pair)) == 1 for pair in joined)

    def normalized(self, text: str) -> str:
        """Spaces as the visible space sign, with one in front of a text that is not empty."""
        return _SPACE + text.replace(" ", _SPACE) if text else ""

    def merge(self, part: str) -> list[int]:
        """The ids of a normalized part, by the agenda."""
        sym = self._merge_short(part) if len(part) <= 48 else self._merge_long(part)
        out: list[int] = []
        for s in sym:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode()]
            elif not out or out[-1] != self.unk:  # without byte pieces a run of unknown symbols is one id
                out.append(self.unk)
        return out

    def _merge_short(self, part: str) -> list[str]:
        """The agenda as a list beside the symbols: entry i is the score of symbols i and i + 1."""
        sym, score, never = list(part), self.score.get, -math.inf
        agenda = [score(a + b, never) for a, b in zip(part, part[1:])]
        while agenda and (best := max(agenda)) != never:
            i = agenda.index(best)
            sym[i] += sym.pop(i + 1)
            agenda.pop(i)
            if i:
                agenda[i - 1] = score(sym[i - 1] + sym[i], never)
            if i < len(agenda):
                agenda[i] = score(sym[i] + sym[i + 1], never)
        return sym

    def _merge_long(self, part: str) -> list[str]:
        """The agenda as a heap over linked symbols, for parts of any length."""
        sym: list[str] = list(part)
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        score, agenda = self.score, []
        for i in range(n - 1):
            if (s := score.get(pair := sym[i] + sym[i + 1])) is not None:
                agenda.append((-s, i, i + 1, len(pair)))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not sym[a] or not sym[b] or len(sym[a]) + len(sym[b]) != size or nxt[a] != b:
                continue  # one of the two has changed since
            sym[a] += sym[b]
            sym[b] = ""
            nxt[a] = after = nxt[b]
            if after < n:
                prev[after] = a
            for x, y in ((prev[a], a), (a, after)):
                if x >= 0 and y < n and (s := score.get(pair := sym[x] + sym[y])) is not None:
                    heapq.heappush(agenda, (-s, x, y, len(pair)))
        return [s for s in sym if s]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts.findall(self.normalized(text)) for i in self.merge(part)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the space in front of the first piece is dropped, broken byte runs become U+FFFD."""
        out = b"".join([self.bytes_of[i] for i in ids])
        if ids and self.bytes_of[ids[0]][:1] == b" " and ids[0] not in (self.unk, self.byte_ids.get(32)):
            out = out[1:]
        return out.decode("utf-8", "each-byte")

    def check(self, parts: list[str], ids: list[list[int]]) -> None:
        """Compare encoding and decoding with the library, every part as a text of its own (which begins with the space sign)."""
        texts = [p[1:].replace(_SPACE, " ") if p[0] == _SPACE else p for p in parts]
        own = [got if p[0] == _SPACE else self.merge(_SPACE + p) for p, got in zip(parts, ids)]
        for p, t, o, theirs, back in zip(parts, texts, own, self.library.encode(texts, num_threads=1), self.library.decode(own, num_threads=1)):
            if t and (o != theirs or self.decode(o) != back):
                raise ValueError(f"the library and the agenda differ on {p!r}")

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The parts of each text, all of them in ``known`` afterwards and checked against the library."""
        parts = [self.parts.findall(self.normalized(t)) for t in texts]
        new = list({p for ps in parts for p in ps if p not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({p for ps in parts for p in ps})
        ids = [self.merge(p) for p in new]
        self.check(new, ids)
        for p, own in zip(new, ids):
            self.known[p] = (len(own), ",".join(map(str, own)).encode(), b"".join([self.bytes_of[i] for i in own]), array("i", own).tobytes())
        return parts


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The worker's codec for a vocabulary; kept, with what it remembers, from task to task."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file, by default the public 32k one; read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", round_trip_col: str | None = None) -> DataFrame:
    """``docs`` with an array of ids appended (an existing column of that name is replaced). Null text: no ids.

    With ``round_trip_col`` the ids are decoded again, and that column says whether they give the text.
    """
    more = [ids_col] + ([round_trip_col] if round_trip_col else [])
    kept = [c for c in docs.columns if c not in more]

    def run(batches):
        c = codec(model)
        for b in pieces(batches, _PIECE):
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            packed = [b"".join([c.known[p][3] for p in parts]) for parts in c.learn(texts)]
            ids = np.frombuffer(b"".join(packed), np.int32)
            ends = np.cumsum([0] + [len(p) // 4 for p in packed])
            cols = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
            if round_trip_col:
                cols.append(pa.array([c.decode(ids[x:y].tolist()) == t for x, y, t in zip(ends, ends[1:], texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in kept] + cols, [*kept, *more])

    schema = docs.select([F.col(f"`{k}`") for k in kept]).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, schema.add(round_trip_col, T.BooleanType()) if round_trip_col else schema)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the decoded text appended (an existing column of that name is replaced). Null ids: empty text."""
    kept = [c for c in rows.columns if c != text_col]

    def run(batches):
        c = codec(model)
        for b in pieces(batches, _PIECE):
            texts = [c.decode(ids.values.to_pylist() if ids.is_valid else []) for ids in b.column(b.schema.get_field_index(ids_col))]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in kept] + [pa.array(texts, pa.string())], [*kept, text_col])

    return rows.mapInArrow(run, rows.select([F.col(f"`{k}`") for k in kept]).schema.add(text_col, "string"))


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded.

    Null and empty texts have no ids and decode to the empty text. Repeated rows and null ids
    come back as they are. Only doc_id and text are read.
    """

    def run(batches):
        c = codec(model)
        for b in pieces(batches, _PIECE):
            n, ids_sha, text_sha = [], [], []
            for parts in c.learn([t or "" for t in b.column(1).to_pylist()]):
                got = [c.known[p] for p in parts]
                n.append(sum([g[0] for g in got]))
                ids_sha.append(hashlib.sha256(b",".join([g[1] for g in got])).hexdigest())
                text_sha.append(hashlib.sha256(b"".join([g[2] for g in got])[1:]).hexdigest())  # without the space in front
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_bytes())
