"""Personal data behind disguises, with exact source positions.

A text passes through two transducers, each of which records where its output comes from:

1. characters: homoglyphs (Cyrillic, Greek, full-width, mathematical letters, other scripts' digits,
   odd dashes, dots and spaces) become their ASCII likeness; invisible characters vanish;
2. words: runs of three or more spelled digits (English, German, French, Spanish) become digits, and
   "at" / "dot" disguises of addresses become ``@`` and ``.``.

Identifiers are detected in the normal form, and each span is mapped back to the characters of the
source, so redaction cuts exactly what was written. Texts without any trigger are not transformed.

Results of ``detect``: one row for each identifier: ``doc_id, kind, begin, end, value``; begin and end
count characters (code points) of the source, end exclusive; value is the normal form. Kinds: email,
secret, ip, card, ssn, iban, phone, in order of precedence where spans overlap; the check digits of cards and
IBANs must be right. Null, empty and clean
texts and rows without doc_id give nothing; rows that repeat are reported again; an empty table gives
an empty result; further columns are ignored. ``redact`` keeps all rows and columns, and puts the kind
in brackets for each span; a null text stays null.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm import kernel as k
from oriel.ship import map_arrow


def _likenesses() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for pairs in ("аaеeоoрpсcхxуyіiјjѕsһhԁdԛqԝwАAВBЕEКKМMНHОOРPСCТTХXУYІIЈJЅSΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXαaοoνvρpιiυu", "․.。.｡.‐-‑-‒-–-—-―-−-﹣-﹫@"):
        table |= {ord(a): b for a, b in zip(pairs[::2], pairs[1::2], strict=True)}
    for code in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x24B6, 0x24EA), *range(0x2070, 0x208A)]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii() and plain != chr(code):
            table[code] = plain
    for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50):
        table |= {zero + d: str(d) for d in range(10)}
    table |= dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")
    table |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E])
    return table


LIKE = _likenesses()
GONE = {chr(c) for c, to in LIKE.items() if to is None}
ODD = {chr(c) for c in LIKE}
DIGITS = {
    w: str(d)
    for d, words in enumerate(
        ["zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"]
    )
    for w in words.split()
}
#: Words too common to be a number by themselves: a run needs another one.
WEAK = {"un", "uno", "oh"}
STRONG = set(DIGITS) - WEAK
_WORD = "(?:" + "|".join(sorted(DIGITS, key=lambda w: (-len(w), w))) + ")"
SPELLED = re.compile(rf"\b{_WORD}(?:[ ,.-]{{1,2}}(?:{_WORD}|\d+)){{2,}}\b", re.I)
SPELLED_PART = re.compile(rf"{_WORD}|\d+", re.I)
_DOT = r"(?:\s*[\(\[\{<]\s*(?:dot|punkt|point|punto)\s*[\)\]\}>]\s*|\s+(?:dot|punkt|point|punto)\s+)"
_AT = r"(?:\s*[\(\[\{<]\s*(?:at|arroba|@)\s*[\)\]\}>]\s*)"
HOST = rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*"
DISGUISED = re.compile(rf"(?:({_AT})|(\s+at\s+)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_DOT})|@(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_DOT}))(?P<host>{HOST})", re.I)
DOT = re.compile(_DOT, re.I)
LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
DOTTED = LOCAL | {"."}
ALNUM = re.compile("[A-Za-z0-9]")
HINTS = {"dot", "punkt", "point", "punto", "arroba"}
BRACKETED = re.compile(r"[\(\[\{<]\s*(?:at|@)\s*[\)\]\}>]", re.I)
APART = str.maketrans(dict.fromkeys(",.-()[]{}<>;:!?\"'", " "))
#: Last labels that make "x at y dot z", without any brackets, an address.
LAST_LABELS = set("com org net edu gov mil int info biz io ai co me app dev us uk eu de fr es it nl be ch at pl pt se no fi dk ie ca au nz in jp cn br mx ar cl ru".split())

HOST_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
SECRET = re.compile(r"\b(?:token|api[_-]?key|secret|password|passwd)\b\s*[=:]\s*[\"']?([A-Za-z0-9_/+-]{16,})[\"']?", re.I)
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
CARD = re.compile(r"(?<![\w.])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|\d{13,19}|3[47]\d{2}[ -]\d{6}[ -]\d{5})(?!\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)")
LONG_DIGITS = re.compile(r"(?<!\d)\+?\d{7,12}(?!\d)")
DIGIT = re.compile(r"\d")


class Mapped:
    """A transformed text. Piece i begins at ``norm[i]`` and stands for the source from ``left[i]`` to ``right[i]``."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.norm, self.left, self.right, self.exact = [], [], [], [], []
        at = place = 0
        for begin, end, to in [*edits, (len(text), len(text), "")]:
            for a, b, out, exact in ((at, begin, text[at:begin], True), (begin, end, to, False)):
                if out:
                    parts.append(out)
                    self.norm.append(place)
                    self.left.append(a)
                    self.right.append(b)
                    self.exact.append(exact)
                    place += len(out)
            at = end
        self.text = "".join(parts)

    def span(self, begin: int, end: int) -> tuple[int, int]:
        """Source characters of the normal span [begin, end); a replaced piece counts whole."""
        i, j = bisect_right(self.norm, begin) - 1, bisect_right(self.norm, end - 1) - 1
        a = self.left[i] + begin - self.norm[i] if self.exact[i] else self.left[i]
        b = self.left[j] + end - self.norm[j] if self.exact[j] else self.right[j]
        return a, b


def characters(text: str) -> tuple[str, list[int] | None]:
    """The text with likenesses, and the source place of each character where some vanished."""
    if text.isascii() or ODD.isdisjoint(text):
        return text, None
    if any(c in text for c in GONE):
        kept = [i for i, c in enumerate(text) if c not in GONE]
        return text.translate(LIKE), [*kept, len(text)]
    return text.translate(LIKE), None


def _run_left(text: str, end: int, allowed: set[str]) -> int:
    """Where the run of allowed characters that ends at ``end`` begins."""
    while end and text[end - 1] in allowed:
        end -= 1
    return end


def _local_left(text: str, end: int, dots: dict[int, int]) -> int | None:
    """Where the local part that ends at ``end`` begins; ``dots`` has the begin of each spelled dot by its end."""
    begin, at = None, end
    while (left := _run_left(text, at, LOCAL)) < at:
        begin = left
        if left and text[left - 1] == ".":
            at = left - 1
        elif left in dots:
            at = dots[left]
        else:
            break
    return begin


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    dots: dict[int, int] | None = None
    for m in DISGUISED.finditer(text):
        if dots is None:
            dots = {d.end(): d.start() for d in DOT.finditer(text)}
        left = _local_left(text, m.start(), dots)
        if left is None or m.group(2) and re.split(r"[^A-Za-z0-9-]+", m.group("host"))[-1].lower() not in LAST_LABELS:
            continue
        edits += [(d.start(), d.end(), ".") for d in DOT.finditer(text, left, m.start())]
        edits.append((m.start(), m.start("host"), "@"))
        edits += [(d.start() + m.start("host"), d.end() + m.start("host"), ".") for d in DOT.finditer(m.group("host"))]
    return edits


def words(text: str) -> tuple[Mapped | None, list[tuple[int, int]]]:
    """Digits and addresses written out; None where nothing is. And the normal spans of spelled numbers."""
    used = set(text.lower().translate(APART).split())
    edits = _address_edits(text) if not HINTS.isdisjoint(used) or "at" in used and BRACKETED.search(text) or "@" in text and BRACKETED.search(text) else []
    numbers = []
    if not STRONG.isdisjoint(used):
        for m in SPELLED.finditer(text):
            parts = [p.lower() for p in SPELLED_PART.findall(m.group())]
            if not STRONG.isdisjoint(parts):
                numbers.append((m.start(), m.end(), "".join(DIGITS.get(p, p) for p in parts)))
    edits, at = sorted(edits + numbers), 0
    clean = []
    for e in edits:
        if e[0] >= at:
            clean.append(e)
            at = e[1]
    if not clean:
        return None, []
    mapped = Mapped(text, clean)
    spelled, grown = [], 0
    for begin, end, to in clean:
        if to not in ("@", "."):
            spelled.append((begin + grown, begin + grown + len(to)))
        grown += len(to) - (end - begin)
    return mapped, spelled


def luhn(value: str) -> bool:
    """Whether the check digit of a card number is right."""
    d = [int(c) for c in value if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def iban_end(value: str) -> int:
    """The length of the longest beginning of at least 15 characters whose check digits are right, or 0."""
    for end in range(len(value), 14, -1):
        plain = "".join(value[:end].split())
        if len(plain) >= 15 and value[end - 1] != " " and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
    return 0


def identifiers(text: str, spelled: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(begin, end, kind) in a normal text, without overlaps, in order."""
    found: list[tuple[int, int, str]] = []  # in order, without overlaps

    def add(begin: int, end: int, kind: str) -> None:
        i = bisect_left(found, (end,))
        if not i or found[i - 1][1] <= begin:
            found.insert(i, (begin, end, kind))

    at = text.find("@")
    while at >= 0:
        left = ALNUM.search(text, _run_left(text, at, DOTTED), at)
        if left and text[at - 1] != "." and (right := HOST_RIGHT.match(text, at + 1)):
            add(left.start(), right.end(), "email")
        at = text.find("@", at + 1)
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            add(m.start(1), m.end(1), "secret")
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("ssn", SSN), ("iban", IBAN), ("phone", PHONE)):
            for m in pattern.finditer(text):
                end = m.end() if kind != "iban" else m.start() + iban_end(m.group())
                if end > m.start() and (kind != "card" or luhn(m.group())):
                    add(m.start(), end, kind)
        for a, b in spelled:
            for m in LONG_DIGITS.finditer(text, max(0, a - 1), b):
                add(m.start(), m.end(), "phone")
    return found


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, value) of the identifiers of a text, in source characters."""
    plain, places = characters(text)
    mapped, spelled = words(plain)
    normal = mapped.text if mapped else plain
    out = []
    for begin, end, kind in identifiers(normal, spelled):
        a, b = mapped.span(begin, end) if mapped else (begin, end)
        if places:
            a, b = places[a], places[b - 1] + 1
        out.append((a, b, kind, normal[begin:end]))
    return out


def detect(docs: DataFrame) -> DataFrame:
    """All identifiers of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch):
                rows = [(i, *hit) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if text for hit in find(text)]
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[4], pa.string())], ["doc_id", "kind", "begin", "end", "value"]
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return map_arrow(slim, run, "doc_id long, kind string, begin long, end long, value string")


def clean(text: str | None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for begin, end, kind, _ in find(text):
        out += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the identifiers of its texts replaced by their kinds."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch):
                texts = pa.array([clean(t) for t in part.column(place).to_pylist()], part.schema.field(place).type)
                yield part.set_column(place, part.schema.field(place), texts)

    return map_arrow(docs, run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
