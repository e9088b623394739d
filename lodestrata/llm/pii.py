"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are decided by their pattern and their own test alone (parts
up to 255, Luhn, digit counts) and always stay; context only changes their score.  Added kinds
need more: an IBAN passes mod-97, a card of 13 to 15 digits Luhn with an issuer's first digits, an
IPv6 address is one that the standard library reads; these and whole international numbers stand by
themselves, while a secret, an identity number, a phone number without its country and an IPv6
address in its short form are accepted when words near them lift their score over the threshold.
An added span that touches a base span, or an added one before it, is left out.

Positions are code points, the end exclusive.

Defined results
    null text counts as the empty text, without spans; a null id stays null; repeated rows are
    searched each on its own; an empty table gives an empty result; extra columns are kept by
    ``redact`` and ignored by ``find_pii``, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import table, text_or_empty

#: The base kinds in their order, and their patterns.  ``email`` is found from its @.
BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, so the look-behind changes nothing but time.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: A run of digits and separators of 13 to 15 digits, and the first digits of issuers whose cards are that short.
SHORT_CARD = re.compile(r"(?<![0-9-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9]|-[0-9])")
ISSUERS = re.compile(r"(?:4.{12}|(?:30[0-5]|36|38).{11,12}|3[47].{13})")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])")
#: One phone number, where the base pattern runs on into what follows it.
TEL = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}?(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])")

ADDED = ("iban", "short_card", "ipv6", "tel", "secret", "identity", "national")
KINDS = BASE + ADDED
#: Score of a span as its pattern and checksum leave it.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "short_card": 0.7, "ipv6": 0.3, "tel": 0.7, "secret": 0.3, "identity": 0.3, "national": 0.3}
#: Words near a span that raise its score, and how near.
CONTEXT = {
    "email": {"mail", "email", "e-mail", "contact"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta"},
    "secret": {"token", "secret", "password", "passwd", "key", "apikey", "api_key", "bearer", "credential"},
    "identity": {"ssn", "social", "security", "identity", "id", "passport"},
}
CONTEXT |= {"short_card": CONTEXT["card"], "ipv6": CONTEXT["ip"], "tel": CONTEXT["phone"], "national": CONTEXT["phone"]}
#: An IPv6 address with all its groups needs no words.
WHOLE_IPV6 = 0.7
NEAR, LIFT, ACCEPT = 40, 0.4, 0.6
WORD = re.compile(r"[^\W\d]+(?:[-_][^\W\d]+)*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    packed = iban.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", match.end() if match else at + 1)


def _digits(part: str) -> str:
    return "".join(c for c in part if "0" <= c <= "9")


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", *m.span()
    for m in SHORT_CARD.finditer(text):
        if ISSUERS.fullmatch(digits := _digits(m[0])) and luhn(digits):
            yield "short_card", *m.span()
    for m in IPV6.finditer(text) if "::" in text or text.count(":") > 6 else ():
        if _is_ipv6(m[0]):
            yield "ipv6", *m.span()
    for m in TEL.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "tel", *m.span()
    for m in SECRET.finditer(text):
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            yield "secret", *m.span()
    for m in IDENTITY.finditer(text):
        yield "identity", *m.span()
    for m in NATIONAL.finditer(text):
        yield "national", *m.span()


def _is_ipv6(shown: str) -> bool:
    try:
        ipaddress.IPv6Address(shown)
    except ValueError:
        return False
    return shown != "::"


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    words = {w.lower() for w in WORD.findall(near)}
    start_score = WHOLE_IPV6 if kind == "ipv6" and "::" not in text[start:end] else START[kind]
    return min(1.0, start_score + LIFT * bool(words & CONTEXT[kind]))


def spans_of(text: str) -> list[Span]:
    """All spans of a text by kind, then start; the base kinds first."""
    if not HINT.search(text):
        return []
    base = [Span(k, a, b, _score(text, k, a, b)) for k, a, b in _base(text)]
    # Spans that are taken, apart from each other or nearly so: the last to begin before a place is found by bisection.
    starts, reach = [], []
    for a, b in sorted((s.start, s.end) for s in base):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    more: dict[str, list[Span]] = {kind: [] for kind in ADDED}
    taken: list[tuple[int, int]] = []
    for kind, a, b in _added(text):
        k = bisect.bisect_left(starts, b)
        if k and reach[k - 1] > a:
            continue
        k = bisect.bisect_left(taken, (b, -1))
        if k and taken[k - 1][1] > a:
            continue
        if (score := _score(text, kind, a, b)) >= ACCEPT:
            more[kind].append(Span(kind, a, b, score))
            bisect.insort(taken, (a, b))
    return base + [span for kind in ADDED for span in more[kind]]


#: What every span has.
HINT = re.compile("[0-9@:]")


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first."""
    parts, at = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= at:
            parts += [text[at : span.start], f"[{span.kind.upper()}]"]
            at = span.end
        elif span.end > at:
            at = span.end
    return "".join([*parts, text[at:]])


def map_spans(docs: DataFrame, of: Callable[[str, list[Span]], tuple], fields: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each document and what ``of`` makes of its text and spans, in the worker."""
    names = [id_col, *(f.split()[0] for f in fields.split(", "))]
    kinds = [pa.int64() if f.split()[1] == "long" else pa.string() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of(t, spans_of(t)) for t in batch.column(1).to_pylist()]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col).alias(text_col)).mapInArrow(run, f"{id_col} long, {fields}")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per span: id, kind, start, end, score, match (the text of the span)."""
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("match", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() | {"match": t[s.start : s.end]} for s in spans_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    made = rows.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long, score: double, match: string>>")
    return made.select(F.col("id").alias(id_col), F.inline("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text_col`` replaced by their kinds; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t, spans_of(t)) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def _digest(text: str, spans: list[Span]) -> tuple:
    spelled = [f"{s.kind}:{s.start}:{s.end}" for s in spans]
    base = [x for x, s in zip(spelled, spans, strict=True) if s.kind in BASE]
    counts = [sum(s.kind == kind for s in spans) for kind in BASE]
    scores = ",".join(f"{s.score:.2f}" for s in spans)
    return *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spelled), scores, len(spans)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_spans long"
    return map_spans(table(spark, sf_dir, "documents"), _digest, fields)
