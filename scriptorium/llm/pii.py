"""Surrogates for personal data and secrets: keyed, type-consistent, distinct, and the same wherever an entity recurs.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment cards (Luhn), IBANs (mod 97), US social
security numbers, secrets (assigned tokens and passwords, long hexadecimal strings, well-known key formats), and
person names (after an honorific, or a known given name before a capitalised surname).

A surrogate is the image of the entity's canonical form under a keyed permutation of all strings of its shape:
each character moves within its own alphabet (digits, hexadecimal digits, or the upper or lower case of its script), so
format and script stay; cards and IBANs get new check digits; a telephone number keeps its country code and
punctuation; an e-mail address its top-level domain; given names move within the names of their script and gender. The
permutation is P^-1(P(x) + 1): it has no fixed point, and different entities of one shape get different
surrogates. Equal entities, in whatever punctuation or case, get equal ones: coreference holds over the whole corpus
without any exchange of data. check_collisions() holds the whole corpus's entities against each other, and
surrogate_documents() changes the key should two of them ever meet.

A null text stays null; an empty one stays empty. Repeated rows are treated alike; rows with a null id too. An
empty table gives an empty result. Texts are processed whole, where they are read; only distinct entities are
shuffled. Extra columns are kept by surrogate_documents() and ignored by find().
"""

from __future__ import annotations

import hashlib
import hmac
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

DIGITS = "0123456789"
HEX = "0123456789abcdef"
ALPHABETS = [
    DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
_WHERE = {c: (i, j) for i, a in enumerate(ALPHABETS) for j, c in enumerate(a)}
NAMES = {
    ("latin", "f"): "Alice Amelie Angela Anna Carla Carmen Caroline Charlotte Claire Clara Diana Elena Elizabeth Emily Emma Eva Hannah Helena Ingrid Isabel Jessica Julia Katharina Laura Lucia Margaret Maria Marie Martha Monika Nicole Olivia Patricia Petra Rachel Sabine Sarah Sofia Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Adam Alexander Andreas Andrew Antonio Carlos Charles Christian Daniel David Diego Edward Francisco George Henry Jacques James Javier Jean John Jonathan Joseph Klaus Louis Manuel Marcel Martin Matthew Michael Miguel Nicolas Oliver Pablo Paul Peter Philippe Robert Samuel Stefan Thomas Wolfgang William".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Михаил Николай Владимир Павел Юрий".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Γιάννης".split(),
}
_GIVEN = {n: (group, i) for group, names in NAMES.items() for i, n in enumerate(names)}
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][a-zß-öø-ÿа-яёα-ωά-ώ'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"[\w.%+-]*\w@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "secret": r"(?i:\b(?:token|secret|passwo?r?d|api[_-]?key|access[_-]?key|auth[_-]?token|client[_-]?secret))[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[^\s\"'<>,;|]{8,})",
    "key": r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![\w-])",
    "hex": r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4})(?!\w|[.]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "person": rf"\b(?P<title>Mr|Mrs|Ms|Miss|Mister|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora|Señor|Sra|Sr)(?P<dot>\.? )(?P<titled>{_CAP}(?: {_CAP})?)|\b(?P<given>{'|'.join(map(re.escape, _GIVEN))}) (?P<surname>{_CAP})",
}
_RULES = [(k, re.compile(p.replace(r"\d", "[0-9]"))) for k, p in PATTERNS.items()]
_DIGIT = re.compile("[0-9]")
_HINTS = ahocorasick.Automaton()
for _word in [*_GIVEN, "Mr", "Ms", "Miss", "Mister", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Sra", "Sr"]:
    _HINTS.add_word(_word, True)
_HINTS.make_automaton()
_KEY_WORDS = ("token", "secret", "passw", "key", "pwd")
_KEY_STARTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ")
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"0123456789@=:")] = True


def luhn(digits: str) -> int:
    """Check digit for a card number without its last digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


class Surrogates:
    """The keyed permutations of one key."""

    def __init__(self, key: bytes):
        self.key = key

    def _feistel(self, x: int, size: int, tweak: bytes, inverse: bool) -> int:
        bits = max(2, (size - 1).bit_length() + 1) // 2
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for r in range(8) if not inverse else range(7, -1, -1):
                half = left if inverse else right
                data = tweak + bytes([r]) + half.to_bytes((bits + 7) // 8, "big")
                need, f, i = (bits + 7) // 8, b"", 0
                while len(f) < need:
                    f += hmac.new(self.key, data + bytes([i]), hashlib.sha256).digest()
                    i += 1
                f = int.from_bytes(f[:need], "big") & mask
                left, right = (right ^ f, left) if inverse else (right, left ^ f)
            x = (left << bits) | right
            if x < size:
                return x

    def number(self, x: int, size: int, tweak: str) -> int:
        """x in 0..size-1 to another, without fixed points where size is 2 or more."""
        if size < 2:
            return x
        t = f"{tweak}/{size}".encode()
        return self._feistel((self._feistel(x, size, t, False) + 1) % size, size, t, True)

    def text(self, s: str, tweak: str, alphabets: list[str] | None = None) -> str:
        """s with every character moved within its alphabet; characters of none stay."""
        where = _WHERE if alphabets is None else {c: (i, j) for i, a in enumerate(alphabets) for j, c in enumerate(a)}
        alphabets = alphabets or ALPHABETS
        x, size, shape = 0, 1, []
        for c in s:
            at = where.get(c)
            shape.append(c if at is None else str(at[0]))
            if at:
                n = len(alphabets[at[0]])
                x, size = x * n + at[1], size * n
        x = self.number(x, size, tweak + "/" + "\0".join(shape))
        out = []
        for c in reversed(s):
            at = where.get(c)
            if at:
                x, j = divmod(x, len(alphabets[at[0]]))
                c = alphabets[at[0]][j]
            out.append(c)
        return "".join(reversed(out))

    def digits_in(self, found: str, new: str) -> str:
        """found with its digits (and, if new has letters, letters) replaced in order by new."""
        it = iter(new)
        return "".join(next(it) if c.isalnum() else c for c in found)

    def word(self, s: str, tweak: str) -> str:
        """A word by its lower-case form, its capitals kept where they were."""
        new = self.text(s.lower(), tweak)
        if len(new) != len(s):
            return self.text(s, tweak)
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(s, new, strict=True))

    def name(self, s: str) -> str:
        if s in _GIVEN:
            group, i = _GIVEN[s]
            return NAMES[group][self.number(i, len(NAMES[group]), "given/" + "/".join(group))]
        return self.word(s, "surname")


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of each entity, in order, without overlaps; earlier types win."""
    has_digit = _DIGIT.search(text) is not None
    on = {"person": next(_HINTS.iter(text), None) is not None, "email": "@" in text, "key": any(k in text for k in _KEY_STARTS)}
    on["secret"] = "=" in text or ":" in text
    if on["secret"]:
        low = text.lower()
        on["secret"] = any(k in low for k in _KEY_WORDS)
    rules = [(kind, rule) for kind, rule in _RULES if on.get(kind, has_digit)]
    found: list[tuple[int, int, str, str]] = []
    for kind, rule in rules:
        for m in rule.finditer(text):
            start, end = m.span()
            s = m.group()
            if kind == "secret":
                start, end = m.span("value")
                s = m.group("value")
                canon = s
            elif kind == "person":
                start, end = m.span("titled") if m.group("titled") else (m.start("given"), m.end("surname"))
                canon = s = text[start:end]
            elif kind == "card":
                canon = re.sub(r"\D", "", s)
                if luhn(canon[:-1]) != int(canon[-1]):
                    continue
            elif kind == "iban":
                canon = s.replace(" ", "")
                if iban_check(canon[:2], canon[4:]) != canon[2:4]:
                    continue
            elif kind == "phone":
                canon = re.sub(r"\D", "", s)
            elif kind == "email":
                canon = s.lower()
            else:
                canon = s
            if not any(start < e and end > b for b, e, _, _ in found):
                found.append((start, end, kind, canon))
    return sorted(found)


def surrogate(s: Surrogates, kind: str, found: str, canon: str) -> str:
    if kind == "email":
        local, _, domain = found.rpartition("@")
        head, dot, top = domain.rpartition(".")
        return s.word(local, "local") + "@" + s.word(head, "domain") + dot + top
    if kind == "phone":
        national = canon[-10:]
        return s.digits_in(found, canon[: len(canon) - len(national)] + s.text(national, "phone"))
    if kind == "ip":
        x = 0
        for o in canon.split("."):
            x = x * 256 + int(o)
        x = s.number(x, 1 << 32, "ip")
        return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))
    if kind == "card":
        body = s.text(canon[:-1], "card")
        return s.digits_in(found, body + str(luhn(body)))
    if kind == "iban":
        account = s.text(canon[4:], "iban")
        return s.digits_in(found, canon[:2] + iban_check(canon[:2], account) + account)
    if kind == "person":
        return " ".join(s.name(w) for w in found.split(" "))
    if re.fullmatch(r"[0-9a-f]+", found):
        return s.text(found, "hex", [HEX])
    if re.fullmatch(r"[0-9A-F]+", found):
        return s.text(found, "hex", [HEX.upper()])
    return s.text(found, "secret")


def rewrite_all(column: pa.Array, s: Surrogates) -> list[tuple[str | None, list]]:
    """rewrite() of each text of a column; texts without any mark or name are passed over quickly."""
    marked = kernels.per_doc(_MARKS[(flat := kernels.text_buffers(column))[0]], flat[1]) > 0
    out = []
    for t, m in zip(column.to_pylist(), marked.tolist(), strict=True):
        if t is None:
            out.append((None, []))
        elif m or any(k in t for k in _KEY_STARTS) or next(_HINTS.iter(t), None) is not None:
            out.append(rewrite(t, s))
        else:
            out.append((t, []))
    return out


def rewrite(text: str, s: Surrogates) -> tuple[str, list[tuple[str, int, int, str, str]]]:
    """The text with surrogates, and (type, start, end, canonical form, surrogate) of each entity."""
    out, at, spans = [], 0, []
    for start, end, kind, canon in entities(text):
        new = surrogate(s, kind, text[start:end], canon)
        out += [text[at:start], new]
        spans.append((kind, start, end, canon, new))
        at = end
    return "".join(out) + text[at:] if spans else text, spans


_FOUND_SQL = "doc_id long, type string, start long, end long, canonical string, surrogate string"


def find(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per entity: doc_id, type, start, end (code points), canonical, surrogate."""

    def run(batches):
        s = Surrogates(key)
        for whole in batches:
            for b in kernels.slices(whole, "text"):
                rows = [(i, *e) for i, (_, spans) in zip(b.column(0).to_pylist(), rewrite_all(b.column(1), s), strict=True) for e in spans]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "type", "start", "end", "canonical", "surrogate"]).cast(_FOUND)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND_SQL)


_FOUND = pa.schema([("doc_id", pa.int64()), ("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("canonical", pa.string()), ("surrogate", pa.string())])


def check_collisions(found: DataFrame) -> DataFrame:
    """(type, canonical surrogate) that several entities of a type share; canonical as for the entities themselves."""
    same = F.when(F.col("type").isin("phone", "card"), F.regexp_replace("surrogate", r"\D", "")).when(F.col("type") == "iban", F.regexp_replace("surrogate", " ", "")).when(F.col("type") == "email", F.lower("surrogate")).otherwise(F.col("surrogate"))
    each = found.select("type", "canonical", same.alias("same")).distinct()
    return each.groupBy("type", "same").agg(F.count("*").alias("n")).where("n > 1")


def good_key(docs: DataFrame, key: bytes) -> bytes:
    """key, or the first key derived from it under which no two entities of the corpus share a surrogate."""
    while True:
        if check_collisions(find(docs, key)).isEmpty():
            return key
        key = hashlib.sha256(key).digest()


def surrogate_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """docs, all columns as they came, with surrogates in the texts; n_chars, if there, is counted anew."""
    key = good_key(docs, key)

    def run(batches):
        s = Surrogates(key)
        for whole in batches:
            for b in kernels.slices(whole, "text"):
                at = b.schema.get_field_index("text")
                text = [t for t, _ in rewrite_all(b.column(at), s)]
                b = b.set_column(at, b.schema.field(at), pa.array(text, b.schema.field(at).type))
                n = b.schema.get_field_index("n_chars")
                if n >= 0:
                    counts = pa.array([None if t is None else len(t) for t in text], pa.int64())
                    b = b.set_column(n, b.schema.field(n), pa.compute.if_else(pa.compute.is_valid(counts), counts.cast(b.schema.field(n).type), b.column(n)))
                yield b

    return docs.mapInArrow(run, docs.schema)


def redact(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities, and entities (type, start and end in the
    text as it was, surrogate)."""
    key = good_key(docs, key)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64()), ("entities", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())])))])

    def run(batches):
        s = Surrogates(key)
        for whole in batches:
            for b in kernels.slices(whole, "text"):
                done = rewrite_all(b.column(1), s)
                spans = [[{"type": k, "start": i, "end": j, "surrogate": n} for k, i, j, _, n in x] for _, x in done]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, schema.field("entities").type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, n_entities long, entities array<struct<type string, start long, end long, surrogate string>>")
