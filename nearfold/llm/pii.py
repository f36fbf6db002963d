"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

A proposal starts with its kind's score. A validator (Luhn, mod 97, ranges) may refuse
it; words near it raise or lower the score. Base kinds stay whatever their score; the
others are reported from `threshold` on, and only where no base span lies.

One pass over whole texts in Arrow batches; a row in, a row out, no shuffle. Every
expression is linear in the text's length. Null and empty texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from nearfold.llm.common import id_and_text, portions, ship
from nearfold.llm.spans import ARROW_SPANS, SPANS, Taken

ship(__name__)

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "social", "local_phone", "passport")
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "social": 0.3, "local_phone": 0.3, "passport": 0.2}
THRESHOLD = 0.5
# How far before and after a span context words count, in characters, and what they add.
REACH, RAISE, LOWER = 40, 0.3, 0.3
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "social": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono"),
    "passport": ("passport", "reisepass", "passeport", "pasaporte"),
}
AGAINST = ("order", "invoice", "isbn", "version", "serial", "example", "sample", "test")

# The base patterns, written without needless backtracking.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{7,8}(?![A-Za-z0-9])")
WORD = re.compile(r"[a-zà-ÿ]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    flat = iban.replace(" ", "")
    if not 15 <= len(flat) <= 34:
        return False
    turned = flat[4:] + flat[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def small_part(part: str) -> bool:
    """At most 255, however many zeros stand before."""
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: from each `@` the run of local characters before it and the domain after."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in emails(text):
        yield "email", start, end
    if not DIGIT.search(text):
        return
    if "." in text:
        for m in IP.finditer(text):
            if all(map(small_part, m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def more_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if not DIGIT.search(text):
        return
    for m in IBAN.finditer(text):
        if mod_97(m[0]):
            yield "iban", m.start(), m.end()
    for m in SOCIAL.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield "social", m.start(), m.end()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()
    for m in PASSPORT.finditer(text):
        yield "passport", m.start(), m.end()


def scored(text: str, kind: str, start: int, end: int) -> float:
    near = set(WORD.findall((text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()))
    score = BASE_SCORE[kind] + RAISE * bool(near.intersection(CONTEXT[kind])) - LOWER * bool(near.intersection(AGAINST))
    return round(min(1.0, max(0.0, score)), 3)


def pii_spans(text: str, threshold: float = THRESHOLD) -> list[dict]:
    """All spans, by kind as listed, then by start."""
    def row(kind: str, start: int, end: int) -> dict:
        return {"kind": kind, "start": start, "end": end, "text": text[start:end], "score": scored(text, kind, start, end)}

    found = [row(*s) for s in base_spans(text)]
    taken = Taken(found)
    for s in more_spans(text):
        extra = row(*s)
        if extra["score"] >= threshold and taken.free(*s[1:]):
            taken.take(*s[1:])
            found.append(extra)
    place = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}
    return sorted(found, key=lambda s: (place[s["kind"]], s["start"]))


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and `spans` (kind, start, end, text, score), by kind as listed, then start."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            spans = [pii_spans(t, threshold) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, ARROW_SPANS)], names=["doc_id", "spans"]
            )

    rows = id_and_text(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans {SPANS}")
