"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, dots, digits, URL schemes
and cue words for identifiers and credentials. From each anchor a deterministic parser expands to
both sides and validates what it finds, so text is never searched again from every place of a long
run; a dot is the anchor of an IP address, the first digit of a run that of a card number.

Kinds of the fixed patterns: email, ip, card, phone. Added by the method: login (user names before
the host of a URL), iban, account and ssn (numbers that follow a cue) and secret (what is assigned to
a cue such as token, password or api_key). Spans are code points, end exclusive; spans of one kind do
not overlap. Defined cases: null counts as empty; rows with equal ids are searched one by one, so
repeated rows come out repeated; text without an anchor has no spans; an empty table gives no rows;
texts of any length are searched whole, in work that grows with their length; `personal_data` looks
at no other columns, `redact` passes them on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import chunks

KINDS = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "account", "ssn", "secret")
#: Cue words in lower case and the kind each announces.
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account", "ssn": "ssn", "social security": "ssn"}
CUES |= dict.fromkeys("token secret password passwd passphrase pwd api_key api-key apikey access_key private_key auth_key secret_key client_secret credential bearer".split(), "secret")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_REST_OF_IP = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/?#@:]++(?::[^\s/?#@]*+)?(?=@[A-Za-z0-9])")
_GAP = r"[\s:#=.\-]{0,4}(?:(?:no|nr|number|num)\b[\s:#=.\-]{0,4})?"
_AFTER = {
    "iban": re.compile(_GAP + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})", re.I),
    "account": re.compile(_GAP + r"([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.I),
    # a value in quotes, or one of eight letters or more that holds a digit
    "secret": re.compile(r"""["']?\s{0,4}(?:[:=]|=>|:=|\bis\b)\s{0,4}(?:"([^"\s]{4,})"|'([^'\s]{4,})'|((?=[^\s0-9]*+[0-9])[^\s"'<>,;()]{8,}))"""),
    "ssn": re.compile(_GAP + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.I),
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("login", 3))
    a.add_word(".", ("ip", 1))
    for digit in "0123456789":
        a.add_word(digit, ("card", 1))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def _digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _iban_end(text: str, start: int, end: int) -> int:
    """Where the longest valid IBAN in text[start:end] ends, or -1."""
    while end - start >= 15:
        s = text[start:end].replace(" ", "").upper()
        if text[end - 1] != " " and 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            return end
        end -= 1
    return -1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of KINDS and ADDED, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {}
    done = dict.fromkeys((*KINDS, *ADDED), 0)
    for last, (kind, length) in _ANCHORS.iter(text):
        at = last + 1 - length
        if kind == "card":
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                if m.end() - at >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                    found.setdefault("card", []).append(m.span())
        elif kind == "ip":
            start = at
            while start > done["ip"] and "0" <= text[start - 1] <= "9":
                start -= 1
            if start < at and (m := _REST_OF_IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[start : m.end()].split(".")):
                    found.setdefault("ip", []).append((start, m.end()))
        elif kind == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.setdefault("email", []).append((start, m.end()))
                done["email"] = m.end()
        elif kind == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.setdefault("phone", []).append(m.span())
        elif kind == "login":
            if m := _LOGIN.match(text, last + 1):
                found.setdefault("login", []).append(m.span())
        elif last + 1 >= done[kind] and not (at and text[at - 1].isalnum()) and (m := _AFTER[kind].match(text, last + 1)):
            start, end = m.span(m.lastindex)
            if kind == "iban":
                end = _iban_end(text, start, end)
            if end > start:
                found.setdefault(kind, []).append((start, end))
                done[kind] = end
    return [(kind, a, b) for kind in (*KINDS, *ADDED) for a, b in found.get(kind, ())]


def redacted(text: str | None) -> str | None:
    """`text` with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    spans = sorted(((a, b, k) for k, a, b in find_spans(text)), key=lambda s: s[:2])
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return text if not spans else "".join(out) + text[at:]


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (kind, start, end)."""

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in chunks(it, "text"):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "found"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(search, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced by its kind; other columns as they are."""

    def replace(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, "text"):
            at = batch.schema.names.index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([redacted(t) for t in batch.column("text").to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(replace, docs.schema)


def joined(found: str, kinds: tuple[str, ...]) -> F.Column:
    """kind:start:end of the spans of some kinds, comma-joined; they lie in the order of kinds already."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"array_join(transform(filter({found}, s -> s.kind in ({listed})), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
