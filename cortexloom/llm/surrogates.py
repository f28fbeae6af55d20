"""PII surrogates: detected entities receive keyed, type-consistent replacements.

Detected: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment card numbers (Luhn),
IBANs (mod 97), US social security numbers, values of token/secret/password assignments, and
names after an honorific, with their later mentions in the document that have none ("Mr. John
Smith ... John Smith ... Smith"). Numbers that fail their checksum are not entities and stay.

Names are replaced word by word: a family name has one surrogate, a given name one for each gender
(that of its honorifics in the document; after neutral ones only, a neutral choice). So a full name
and a bare family name stay one person, in all documents, and people of one family stay one.

A surrogate depends only on the key, the type and the entity's canonical form, so all mentions
of an entity get the same one in every document (coreference). It keeps the mention's format
(separators, case, length, grouping, checksum), an address's domain structure and private
range, and a name's gender and script. Distinctness is checked over the whole corpus: surrogates
that equal another entity's surrogate or any real entity of their type lose to the smaller
canonical form and try their next candidate, until no collision is left. Where a range of addresses
or numbers is too full for that, all its entities take a keyed permutation of the range instead:
distinct, and none its own, though it may be another's. Only those exceptions
travel back to the documents; all others are recomputed where they are needed.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm._text import free_name, pieces, table
from cortexloom.plans.scratch import Scratch

# Honorifics by gender, given names by script and gender, syllables of family names by script.
HONORIFICS = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Signor господин",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Señorita Doña Signora госпожа",
    "n": "Dr Prof Professor доктор",
}
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul Ralf Simon Theo Victor Walter",
    ("latin", "f"): "Alma Berta Clara Dora Elena Flora Greta Helen Irene Julia Karla Lena Marta Nora Olga Paula Rosa Sofia Tilda Vera",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур",
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Мария Нина Ольга Полина Рита Софья",
    ("greek", "m"): "Άρης Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος Σταύρος",
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία",
    ("han", "m"): "伟 强 军 磊 勇 涛 明 杰",
    ("han", "f"): "芳 娜 敏 静 丽 霞 娟 婷",
    ("arabic", "m"): "أحمد حسن خالد سامي عمر كريم محمود يوسف",
    ("arabic", "f"): "أمل خديجة زينب سلمى فاطمة ليلى مريم نور",
    ("devanagari", "m"): "अजय अनिल दीपक मोहन राज रवि सुनील विजय",
    ("devanagari", "f"): "अनिता गीता ज्योति मीना रेखा सीता सुनीता उषा",
    ("hangul", "m"): "민준 서준 지훈 현우 도윤 준서 건우 우진",
    ("hangul", "f"): "서연 지우 서윤 하은 민서 수빈 지아 예은",
}
SYLLABLES = {
    "latin": "ba bel cor dan der fal gor han kel lin mar nor per ras sel tor val wen",
    "cyrillic": "бар вол гор дан зел кор лаз мир нов пет рос сав тур хол",
    "greek": "βα γκο δα κα λο μα νι πα ρο σα τα φω",
    "han": "林 文 高 江 安 宁 方 石 田 白 金 叶 云 雷 康 平",
    "arabic": "با دا را سا كا لا ما نا وا حا",
    "devanagari": "बा दा गा का ला मा ना पा रा सा ता वा",
    "hangul": "강 남 도 류 문 배 서 오 정 차 하 윤",
}
#: The script of a name by a letter of it.
SCRIPTS = [(re.compile(r"[Ѐ-ӿ]"), "cyrillic"), (re.compile(r"[Ͱ-Ͽἀ-῿]"), "greek"), (re.compile(r"[㐀-鿿]"), "han"), (re.compile(r"[؀-ۿ]"), "arabic"), (re.compile(r"[ऀ-ॿ]"), "devanagari"), (re.compile(r"[가-힣]"), "hangul")]
_HON = {h: g for g, hs in HONORIFICS.items() for h in hs.split()}


def _ranges(chars: list[int]) -> str:
    """A regular expression's ranges of sorted code points."""
    edges = [c for i, c in enumerate(chars) if i == 0 or chars[i - 1] != c - 1], [c for i, c in enumerate(chars) if i == len(chars) - 1 or chars[i + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(*edges))


#: No word of a name begins with a lower-case letter, of whatever script.
_LOWER = _ranges([c for c in range(0x10000) if chr(c).islower()])
_NAME = rf"[^\W\d_{_LOWER}][^\W\d_]{{1,30}}"
_WORD = re.compile(r"[^ \xa0-]+")
_PERSON = re.compile(rf"\b({'|'.join(sorted(_HON, key=len, reverse=True))})\b\.?[  ]({_NAME}(?:[  -]{_NAME}){{0,2}})")
#: What a text must hold for the slower patterns to be tried at all.
_HON_ENDS, _SECRET_WORDS = [h + end for h in _HON for end in ". \xa0"], ("token", "secret", "passw", "key")
_LOCAL = re.compile(r"[\w.%+-]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])")
# A quoted value to its closing quote, any other to the next space, at any length; the last group leaves out closing punctuation.
_SECRET = re.compile(
    r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}"
    r"(?:\"((?:[^\"\\\n]|\\.){8,})\"|'((?:[^'\\\n]|\\.){8,})'|[\"']?(\S{8,}))"
)
_CLOSING, _DIGIT = ".,;:!?)]}>\"'", re.compile(r"\d")
_NUMBER = re.compile(
    r"(?P<ipv4>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]|\.\d)|(?<![\w.+-])0\d{2,4}[ /-]\d{6,8}(?![\w-]))"
    r"|(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]))"
)
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
_IPV6 = re.compile(rf"(?<![\w:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|{_GROUPS}::(?:{_GROUPS})?)(?![\w:])")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}\b")


def luhn(digits: str) -> int:
    """The digit that completes a number to a valid one."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def _is_ipv6(s: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def people(text: str) -> list[tuple[int, int, str, str]]:
    """The words of names after honorifics, and of the same names (whole, or the family name alone) elsewhere in the text."""
    named = [(m.start(2), m[2], _HON[m[1]]) for m in _PERSON.finditer(text)]
    gender: dict[str, str] = {}  # of a given name in this text
    for _, name, g in named:
        for w in _WORD.findall(name)[:-1]:
            if g != "n" or w.casefold() not in gender:
                gender[w.casefold()] = g
    out = {}

    def put(at: int, name: str) -> None:
        words = list(_WORD.finditer(name))
        for w in words[:-1]:
            out[at + w.start()] = (at + w.start(), at + w.end(), "given", f"{gender.get(w[0].casefold(), 'n')}:{w[0].casefold()}")
        w = words[-1]
        out[at + w.start()] = (at + w.start(), at + w.end(), "family", w[0].casefold())

    again = {n for _, n, _ in named} | {_WORD.findall(n)[-1] for _, n, _ in named}
    if again:  # longer names first
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(again, key=lambda x: (-len(x), x))))})\b", text):
            put(m.start(), m[0])
    for at, name, _ in named:
        put(at, name)
    return list(out.values())


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities of a text, in order, without overlap."""
    out: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        if (a := _LOCAL.search(text, max(0, at - 64), at)) and (b := _DOMAIN.match(text, at + 1)):
            start = a.start() + len(a[0]) - len(a[0].lstrip("."))
            if start < at:
                out.append((start, b.end(), "email", text[start : b.end()].lower()))
        at = text.find("@", at + 1)
    if ("=" in text or ":" in text) and any(k in low for low in (text.lower(),) for k in _SECRET_WORDS):
        for m in _SECRET.finditer(text):
            n = m.lastindex
            value = m[n].rstrip(_CLOSING) if n == 3 else m[n]
            if len(value) >= 8:
                out.append((m.start(n), m.start(n) + len(value), "secret", value))
    numbers = _DIGIT.search(text) is not None
    for m in _IBAN.finditer(text) if numbers else ():
        s = m[0].replace(" ", "")
        if 15 <= len(s) <= 34 and int(iban_check(s[:2], s[4:])) == int(s[2:4]):
            out.append((m.start(), m.end(), "iban", s))
    for m in _NUMBER.finditer(text) if numbers else ():
        kind, digits = m.lastgroup, "".join(str(int(c)) for c in m[0] if c.isdecimal())
        if kind == "ipv4" and all(int(p) < 256 for p in m[0].split(".")):
            out.append((m.start(), m.end(), kind, ".".join(str(int(p)) for p in m[0].split("."))))
        elif kind == "card" and 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1:
            out.append((m.start(), m.end(), kind, digits))
        elif kind == "ssn" or kind == "phone" and 7 <= len(digits) <= 15:
            out.append((m.start(), m.end(), kind, "+" * m[0].startswith("+") + digits))
    for m in _IPV6.finditer(text) if numbers and text.count(":") > 1 else ():
        if len(re.findall(r"[^:]+", m[0])) > 2 and _is_ipv6(m[0]):
            out.append((m.start(), m.end(), "ipv6", ipaddress.IPv6Address(m[0]).exploded))
    if any(h in text for h in _HON_ENDS):
        out += people(text)
    out.sort(key=lambda e: (e[0], -e[1]))
    kept: list[tuple[int, int, str, str]] = []
    for e in out:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


class Draw:
    """Numbers drawn from a keyed hash of an entity."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.n, self.pool = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.what + b"\x1f%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n

    def like(self, s: str, hexadecimal: bool = False) -> str:
        """Digits for digits, letters for letters of the same case (hexadecimal ones for such), the rest as it is."""
        out, upper = [], not any(c.islower() for c in s)
        for c in s:
            if hexadecimal and c in "0123456789abcdefABCDEF":
                x = "0123456789abcdef"[self.below(16)]
                out.append(x.upper() if upper else x)
            elif c.isdecimal():
                out.append(str(self.below(10)))
            elif c.isalpha():
                first, n = (("а", 32) if "Ѐ" <= c <= "ӿ" else ("α", 17) if "Ͱ" <= c <= "Ͽ" else ("a", 26))
                x = chr(ord(first) + self.below(n))
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def place(kind: str, canon: str) -> tuple[str, int, int] | None:
    """(prefix, size, index) of an entity in the range that its surrogate keeps, if that can run out."""
    if kind == "ipv4":
        p = [int(x) for x in canon.split(".")]
        if p[0] in (10, 127):
            return f"{p[0]}.", 1 << 24, p[1] << 16 | p[2] << 8 | p[3]
        if p[:2] == [192, 168] or (p[0] == 172 and 16 <= p[1] < 32):
            return f"{p[0]}.{p[1]}.", 1 << 16, p[2] << 8 | p[3]
    elif kind in ("phone", "ssn"):
        keep = 0 if canon[0] != "+" else 2 if canon[1] in "17" else 3
        return canon[:keep] + "*" * (len(canon) - keep), 10 ** (len(canon) - keep), int(canon[keep:])
    return None


def permuted(key: bytes, kind: str, canon: str) -> str:
    """The entity's place in a keyed permutation without fixed points: a Feistel network F and one step, F'(F(x) + 1)."""
    prefix, size, x = place(kind, canon)
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    f = lambda r, v: Draw(key, "permute", kind, prefix, r, v).below(1 << half)

    def network(v: int, rounds: list[int], back: bool) -> int:
        while True:  # walks on until inside the range again
            a, b = v >> half, v & mask
            for r in rounds:
                a, b = (b ^ f(r, a), a) if back else (b, a ^ f(r, b))
            v = a << half | b
            if v < size:
                return v

    y = network((network(x, [0, 1, 2, 3], False) + 1) % size, [3, 2, 1, 0], True)
    if kind == "ipv4":
        return prefix + ".".join(str(y >> s & 255) for s in range(16 if size > 1 << 16 else 8, -1, -8))
    return prefix.rstrip("*") + str(y).zfill(prefix.count("*"))


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate; attempt -1 stands for the permutation of its range."""
    if attempt < 0:
        return permuted(key, kind, canon)
    d = Draw(key, kind, canon, attempt)
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        names, top = domain.rsplit(".", 1)
        return f"{d.like(local + 'a' * (attempt // 8))}@{Draw(key, 'domain', domain).like(names)}.{top}"
    if kind == "ipv4":
        p = [int(x) for x in canon.split(".")]
        keep = 1 if p[0] in (10, 127) else 2 if p[:2] == [192, 168] or (p[0] == 172 and 16 <= p[1] < 32) else 0
        head = p[:keep] or [next(x for x in iter(lambda: 1 + d.below(223), None) if x not in (10, 127, 172, 192))]
        return ".".join(map(str, head + [d.below(256) for _ in range(4 - len(head))]))
    if kind == "card":
        body = canon[0] + d.like(canon[1:-1])
        return body + str(luhn(body))
    if kind == "iban":
        rest = d.like(canon[4:])
        return canon[:2] + iban_check(canon[:2], rest) + rest
    if kind == "secret":
        if sum(c.isalnum() for c in canon) < 8:  # too few letters and digits for a value of its own
            return d.like("".join(c if c.isalnum() or c.isspace() else "a" for c in canon))
        return d.like(canon, hexadecimal=not any(c.isalpha() and c not in "abcdefABCDEF" for c in canon))
    if kind in ("given", "family"):
        gender, name = canon.split(":", 1) if kind == "given" else ("", canon)
        script = next((x for letter, x in SCRIPTS if letter.search(name)), "latin")
        syl = SYLLABLES[script].split()
        some = lambda n: "".join(syl[d.below(len(syl))] for _ in range(n))
        if kind == "family":
            return some(2 + (attempt > 2) + attempt // 8 + d.below(2))
        names = GIVEN[script, gender if gender != "n" else "mf"[Draw(key, "gender", canon).below(2)]].split()
        return names[d.below(len(names))].casefold() + some(1 + (attempt > 2) + attempt // 8)
    if kind == "ipv6":
        groups = canon.split(":")
        return ":".join([groups[0]] + [f"{1 + d.below(65535):04x}" if int(g, 16) else g for g in groups[1:]])
    if canon[0] == "+":  # the country code stays: one digit for the zones 1 and 7, else two
        keep = 2 if canon[1] in "17" else 3
        return canon[:keep] + d.like(canon[keep:])
    return d.like(canon)  # other telephone numbers, social security numbers


def dressed(surface: str, kind: str, new: str) -> str:
    """A canonical surrogate in the format of a mention."""
    if kind in ("given", "family"):
        return new.upper() if surface.isupper() and len(surface) > 1 else new.capitalize()
    if kind == "ipv6":
        new = ipaddress.IPv6Address(new).compressed if len(surface) < 39 else new
        return new.upper() if any(c.isupper() for c in surface) else new
    if kind == "secret":
        return new
    if kind == "email":
        return "".join(n.upper() if s.isupper() else n for s, n in zip(surface, new)) if len(surface) == len(new) else new
    local = lambda c, like: chr(ord(like) - int(like) + int(c)) if c.isdecimal() and like.isdecimal() else c
    if kind == "ipv4":
        return "".join(local(c, surface[0]) for c in new)
    chars = iter(new.lstrip("+"))
    return "".join(local(next(chars), c) if c.isalnum() else c for c in surface)


def _ranges(entities: DataFrame) -> DataFrame:
    """(kind, canon, range) of entities; the range is null where it cannot run out."""

    def run(batches):
        for b in batches:
            found = [place(k, c) for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f and f[0] for f in found], pa.string())], ["kind", "canon", "range"])

    return entities.select("kind", "canon").mapInArrow(run, "kind string, canon string, range string")


def collisions(entities: DataFrame, key: bytes, scratch: Scratch, max_rounds: int = 50) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate is not their final one.

    ``entities``: distinct (kind, canon). All steps are joins and grouped minima over that table.
    """

    def candidates(batches):
        for b in batches:
            s = [surrogate(key, k, c, a) for k, c, a in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.string())], ["kind", "canon", "attempt", "s"])

    attempt = lambda df, a: df.select("kind", "canon", F.lit(a).alias("attempt")).mapInArrow(candidates, "kind string, canon string, attempt int, s string")
    taken = entities.select("kind", F.when(F.col("kind") == "given", F.substring("canon", 3, 1 << 30)).otherwise(F.col("canon")).alias("s"))  # as they are seen
    waiting, settled, moved = entities, None, None
    for a in range(max_rounds):
        cand = scratch.save(attempt(waiting, a), "candidates")
        free = cand.join(taken, ["kind", "s"], "left_anti")
        won = scratch.save(free.groupBy("kind", "s").agg(F.min("canon").alias("canon")), "won")
        taken = taken.unionAll(won.select("kind", "s"))
        if a:
            now = won.select("kind", "canon", F.lit(a).alias("attempt"))
            moved = now if moved is None else moved.unionAll(now)
        waiting = scratch.save(cand.join(won, ["kind", "canon"], "left_anti").select("kind", "canon"), "waiting")
        if waiting.isEmpty():
            break
    else:
        full = scratch.save(_ranges(waiting).select("kind", "range").distinct(), "full")
        if not full.where("range is null").isEmpty():
            raise RuntimeError(f"surrogates still collide after {max_rounds} candidates each")
        inside = scratch.save(_ranges(entities).join(F.broadcast(full), ["kind", "range"]).select("kind", "canon", F.lit(-1).alias("attempt")), "permuted")
        return inside if moved is None else moved.join(inside, ["kind", "canon"], "left_anti").unionAll(inside)
    return moved if moved is not None else entities.select("kind", "canon", F.lit(0).alias("attempt")).where(F.lit(False))


_COUNTED = {"family": "person"}
#: Rows up to which the documents' exceptions are broadcast; beyond that they are joined by shuffle.
BROADCAST_ROWS = 200_000


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, and n_entities, kinds appended (replacing columns of these names).

    ``kinds`` counts entities as "card:1,email:2". Null and empty texts stay as they are with 0
    entities. Rows that share a doc_id and null ids are treated alike. Other columns pass through.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")

    def mentions(batches):
        for b in pieces(batches):
            ids, kinds, canons = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, c in sorted({e[2:] for e in find(t)} if t else ()):
                    ids.append(i), kinds.append(k), canons.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(canons, pa.string())], ["doc_id", "kind", "canon"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = scratch.save(rows.mapInArrow(mentions, "doc_id bigint, kind string, canon string"), "mentions")
    entities = scratch.save(seen.select("kind", "canon").distinct(), "entities")
    moved = scratch.save(collisions(entities, key, scratch), "exceptions")
    mine, k, kept = free_name(docs, "_moved"), free_name(docs, "_id"), [c for c in docs.columns if c not in ("n_entities", "kinds")]
    by_doc = seen.join(moved, ["kind", "canon"]).groupBy("doc_id").agg(F.collect_set(F.concat_ws("\x1f", "kind", "canon", "attempt")).alias(mine)).withColumnRenamed("doc_id", k)
    by_doc = scratch.save(by_doc, "by_doc")
    by_doc = F.broadcast(by_doc) if by_doc.count() <= BROADCAST_ROWS else by_doc
    both = docs.select([F.col(f"`{c}`") for c in kept]).join(by_doc, docs["doc_id"].cast("bigint").eqNullSafe(F.col(k)), "left").drop(k)

    def replace(batches):
        for b in pieces(batches):
            texts, n, kinds = [], [], []
            for t, m in zip(b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.schema.get_field_index(mine)).to_pylist()):
                tries = {tuple(x.split("\x1f")[:2]): int(x.split("\x1f")[2]) for x in m or ()}
                found = find(t) if t else []
                parts, at, count = [], 0, {}
                for start, end, kind, canon in found:
                    parts += [t[at:start], dressed(t[start:end], kind, surrogate(key, kind, canon, tries.get((kind, canon), 0)))]
                    at = end
                    if kind != "given":  # a name counts once
                        count[_COUNTED.get(kind, kind)] = count.get(_COUNTED.get(kind, kind), 0) + 1
                texts.append("".join([*parts, t[at:]]) if found else t)
                n.append(sum(count.values()))
                kinds.append(",".join(f"{x}:{count[x]}" for x in sorted(count)))
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(kinds, pa.string())], [*kept, "n_entities", "kinds"])

    return both.mapInArrow(replace, docs.select([F.col(f"`{c}`") for c in kept]).schema.add("n_entities", "long").add("kinds", "string"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), b"registered query")
