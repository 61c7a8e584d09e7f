r"""Operator 7: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs (plain or written out), URL schemes,
and cues of identifiers (``token``, ``iban``, ``account`` ...).  From each anchor a deterministic parser walks
outwards over its character class, and validates what it has: an address needs a local part and a dotted
domain, an account identifier an IBAN check sum or enough digits, a secret enough mixed characters.  Digit
groups need no anchor of their own: their first digit is one.

Base spans follow the four fixed patterns exactly (leftmost, non-overlapping per kind, a match that fails
its check is dropped without retry); their parsers differ from the patterns only in that they never rescan a
run of characters, so texts of any length take linear time.  Added spans: ``url`` (a scheme and what
follows; user names and hosts are often personal), ``account`` (IBANs with valid check digits, digits after
an account cue), ``secret`` (values assigned to a key, token or password cue), and ``email`` for addresses
with written-out signs ("name (at) host (dot) org").  Added spans never overlap a base span of the same kind.

Offsets are in code points, ends exclusive.  Edge cases: null text is empty: no spans, the digest of the
empty string; null ids are kept; repeated rows give repeated rows; an empty table gives no rows; ``mask``
keeps all other columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, table

KINDS = ("email", "ip", "card", "phone", "account", "secret", "url")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'|]+")
SCHEME_START = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}\Z")
ASSIGNED = re.compile(r"[\"']?\s{0,3}(?:[=:]|is\b)\s{0,3}[\"']?")
VALUE = re.compile(r"[A-Za-z0-9_./+=-]++")
LAST_DIGIT = re.compile(r".*[0-9]")
MIN_SECRET = 8
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCOUNT_NUMBER = re.compile(r"\W{0,3}(?:no\.?|number|nr\.?|#)?[\s:#=]{0,3}([0-9](?:[ -]?[0-9]){5,33})(?![0-9])", re.I)
WRITTEN_LEFT = re.compile(r"([A-Za-z0-9._%+-]{1,64})\s?\Z")
WRITTEN_RIGHT = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,63})+")

#: Anchors and the parser that each starts. Cues are looked for in lower case, upper case and capitalised.
CUES = {
    "secret": ("token", "password", "passwd", "api_key", "apikey", "api key", "secret", "access_key"),
    "account": ("iban", "account", "acct", "konto", "cuenta", "compte"),
    "written": ("(at)", "[at]"),
}


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for sign, kind in (("@", "at"), ("://", "url")):
        automaton.add_word(sign, (kind, len(sign)))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def email_at(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign, not reaching before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    host = DOMAIN.match(text, at + 1)
    return (start, host.end()) if host and start < at else None


def ips(text: str) -> list[Span]:
    found = (m.span() for m in IP.finditer(text))
    return [(a, b) for a, b in found if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[a:b].split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and added spans by kind, each in the order of their starts."""
    base: dict[str, list[Span]] = {"email": [], "ip": ips(text), "card": cards(text), "phone": phones(text) if "+" in text else []}
    extra: dict[str, list[Span]] = {k: [] for k in KINDS}
    done = 0
    run, digit = 0, 0  # ends of the last run of value characters and of its last digit: a later value in it is its tail
    for last, (kind, width) in anchors().iter(text):
        start, end = last + 1 - width, last + 1
        if kind == "at":
            if span := email_at(text, start, done):
                base["email"].append(span)
                done = span[1]
        elif kind == "url":
            if extra["url"] and start < extra["url"][-1][1]:
                continue
            scheme = SCHEME_START.search(text[max(0, start - 16) : start])
            if scheme and (rest := URL_REST.match(text, end)):
                extra["url"].append((start - len(scheme.group()), rest.end()))
        elif kind == "written":
            left, right = WRITTEN_LEFT.search(text[max(0, start - 66) : start]), WRITTEN_RIGHT.match(text, end)
            if left and right:
                extra["email"].append((start - len(left.group()), right.end()))
        elif kind == "secret":
            if assigned := ASSIGNED.match(text, end):
                at = assigned.end()
                if at >= run and (value := VALUE.match(text, at)):
                    run = value.end()
                    found = LAST_DIGIT.match(text, at, run)
                    digit = found.end() if found else at
                if run - at >= MIN_SECRET and digit > at:
                    extra["secret"].append((at, run))
        elif value := ACCOUNT_NUMBER.match(text, end):
            extra["account"].append(value.span(1))
    extra["account"] += [m.span() for m in IBAN.finditer(text) if iban_valid(m.group())]
    for k, spans in extra.items():
        kept: list[Span] = []
        for a, b in sorted(set(spans)):
            if (not kept or a >= kept[-1][1]) and not any(a < y and x < b for x, y in base.get(k, ())):
                kept.append((a, b))
        extra[k] = kept
    return base, extra


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, ())))


def merged(base: dict[str, list[Span]], extra: dict[str, list[Span]]) -> dict[str, list[Span]]:
    return {k: sorted([*base.get(k, ()), *extra.get(k, ())]) for k in KINDS}


def masked(text: str) -> str:
    """The text with every span, of whichever kind, replaced by its kind in angle brackets."""
    spans = sorted((a, -b, k) for k, found in merged(*find(text)).items() for a, b in found)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text in b.column("text").to_pylist():
                base, extra = find(text or "")
                row = (*(len(base[k]) for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(merged(base, extra)))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, out, types)], names)

    id_type = dict(docs.dtypes)["doc_id"]
    longs = ", ".join(f"{n} long" for n in names[1:5])
    return arrow_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {id_type}, {longs}, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all other columns as they are, but n_chars, which is counted again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else masked(t) for t in b.column("text").to_pylist()]
            at = b.schema.get_field_index("text")
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    out = arrow_batches(docs).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op7_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
