"""Operator 8, personal data by anchor expansion.

An Aho-Corasick automaton runs over every whole text once and finds anchors: at-signs, plus signs
before a digit, a digit-dot-digit, two digits in a row (with at most one space or hyphen between),
URL schemes, and cue words of accounts.  From each anchor a deterministic local parser expands to the
left and right, decides the boundaries and validates (octets, digit counts, Luhn, IBAN mod 97).

Kinds, in the order they are listed: email, ip, card, phone (the base, with the boundaries of their
defining patterns), then what the method adds: url (scheme, host with a dot or port, path), iban
(checked by mod 97) and account (a cue such as "account no" or "acct", then 6 to 14 digits).
Positions are code points, ends exclusive; matches of one kind never overlap.

Defined cases: a null or empty text has no spans; rows that repeat are scanned each by itself; other
columns pass through, whatever their names; an empty table gives an empty result; a very long text is scanned whole,
and memory is bounded by the longest one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, map_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")
DIGITS = frozenset("0123456789")
ALPHA = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = ALPHA | DIGITS | frozenset("._%+-")
LABEL = ALPHA | DIGITS | {"-"}
PHONE = DIGITS | frozenset(" ().-")
URL = ALPHA | DIGITS | frozenset("-._~:/?#[]@!$&'()*+,;=%")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "a/c", "konto", "compte", "cuenta", "iban", "IBAN", "Account", "Acct", "Konto", "Compte", "Cuenta")
_AFTER_CUE = re.compile(r"(?:\.| ?(?:no|number|nr|num)\b\.?| ?#)?[ ]?[:#=]?[ ]?([0-9](?:[ -]?[0-9]){5,13})(?![0-9])")
_IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_NEXT = re.compile(r" ?[A-Z0-9]")
#: Characters after a cue in which an IBAN can start; its end is not bounded by them.
IBAN_REACH = 60


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    found: dict[str, str] = {"@": "email"}
    ten = "0123456789"
    for a in ten:
        found["+" + a] = "phone"
        for b in ten:
            found[f"{a}.{b}"] = "ip"
            for gap in ("", " ", "-"):
                found[f"{a}{gap}{b}"] = "card"
    found |= dict.fromkeys(SCHEMES, "url") | dict.fromkeys(CUES, "account")
    made = ahocorasick.Automaton()
    for key, kind in found.items():
        made.add_word(key, (kind, len(key)))
    made.make_automaton()
    return made


def _left(text: str, at: int, least: int, member: frozenset) -> int:
    while at > least and text[at - 1] in member:
        at -= 1
    return at


def _right(text: str, at: int, member: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in member:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(text: str) -> bool:
    raw = text.replace(" ", "")
    return 15 <= len(raw) <= 34 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def _iban(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The first valid IBAN that starts within IBAN_REACH characters after `at`: at each country code the longest end
    before a non-alphanumeric character for which mod 97 holds."""
    for m in _IBAN_START.finditer(text, at, min(len(text), at + IBAN_REACH + 6)):
        if m.start() < least or m.start() >= at + IBAN_REACH:
            continue
        ends, end, size = [], m.end(), 4
        while size < 34 and (more := _IBAN_NEXT.match(text, end)):
            end, size = more.end(), size + 1
            if size >= 15 and not text[end : end + 1].isalnum():
                ends.append(end)
        for end in reversed(ends):
            if iban(text[m.start() : end]):
                return m.start(), end
    return None


def _email(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    start = _left(text, at, least, LOCAL)
    end = _right(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dotted = False
    while end < len(text) and text[end] == "." and (more := _right(text, end + 1, LABEL)) > end + 1:
        end, dotted = more, True
    return (start, end, True) if dotted else None


def _ip(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    # The anchor is the first digit.digit of its chain: four runs of digits make a match.
    start = end = _left(text, at, least, DIGITS)
    parts = []
    while len(parts) < 4:
        stop = _right(text, end, DIGITS)
        if stop == end:
            return None
        parts.append(text[end:stop])
        if len(parts) < 4 and text[stop : stop + 1] != ".":
            return None
        end = stop + 1
    return start, end - 1, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _card(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    # The anchor is the first pair of its chain, so the chain starts at it or at digits just before it.
    end, n, digits = at + 1, len(text), [text[at]]
    while end < n:
        c = text[end]
        if c in DIGITS:
            digits.append(c)
            end += 1
        elif (c == " " or c == "-") and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return at, end, 16 <= len(digits) <= 19 and luhn("".join(digits))


def _phone(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    end = _right(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return at, end, 8 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _url(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    host = text.index("://", at) + 3
    end = _right(text, host, URL)
    while end > host and text[end - 1] in ".,;:!?)]'":
        end -= 1
    return at, end, end > host and any(c in ".:" for c in text[host:end])


def _account(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    m = _AFTER_CUE.match(text, at)
    return (m.start(1), m.end(1), True) if m else None


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "account": _account}


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in a text, by kind as listed and start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if at < done[kind] and kind != "account":
            continue  # inside what this kind has used up
        if kind == "account":
            if at and text[at - 1].isalnum():
                continue
            if text[at : last + 1].lower() == "iban" and (found := _iban(text, last + 1, done["iban"])):
                spans["iban"].append(found)
                done["iban"] = found[1]
                continue
            got = _account(text, last + 1, 0)
            if got and got[0] >= done[kind]:
                spans[kind].append(got[:2])
                done[kind] = got[1]
            continue
        got = PARSERS[kind](text, at, done[kind])
        if got is None:
            if kind == "card":
                done[kind] = last
            continue
        done[kind] = got[1]
        if got[2]:
            spans[kind].append(got[:2])
    return [(k, s, e) for k in KINDS for s, e in spans[k]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scrubbed(text: str) -> str:
    """The text redacted until nothing is found: what stands between two spans may become one when they are gone."""
    while spans := find(text):
        text = redacted(text, spans)
    return text


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones joined, named by the first kind) replaced by [KIND]."""
    out, at = [], 0
    for s, e, k in sorted((s, e, KINDS.index(k)) for k, s, e in spans):
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array<struct<kind,start,end>>."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] if t else [] for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def redact_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; all columns stay, n_chars (if there) follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            new = pa.array([scrubbed(t) if t else t for t in b.column(at).to_pylist()], b.schema.field(at).type)
            arrays = list(b.columns)
            arrays[at] = new
            if (n := b.schema.get_field_index("n_chars")) >= 0:
                arrays[n] = pc.if_else(pc.is_null(new), b.column(n), pc.utf8_length(new).cast(b.schema.field(n).type))
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return map_arrow(docs, run, docs.schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_pii(docs)
    of = lambda k: lambda s: s["kind"] == k
    count = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *count, F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def brute(text: str) -> list[tuple[str, int, int]]:
    """The base kinds by their patterns alone (for tests)."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


__all__ = ["KINDS", "brute", "find", "find_pii", "pii_digest", "redact_pii", "redacted", "scrubbed"]
