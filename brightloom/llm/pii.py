"""Personal data by anchor expansion (operator 2).

One Aho-Corasick pass over each whole text finds at-signs, plus signs, schemes, identifier cues, and digits that have a
digit beside them, or beyond a blank, hyphen or dot. Deterministic local parsers expand each anchor to the left and
right, validate it, and give its exact boundaries; anchors inside a stretch that a parser has read are passed over.

Base kinds (leftmost, not overlapping within a kind; a match that fails its check is passed over whole):
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     four numbers with dots between, each at most 255
  card   digits with single blanks or hyphens between, 14 to 19 of them, passing Luhn
  phone  \\+[0-9][\\x20().0-9-]+[0-9] with 10 to 15 digits
Kinds the anchors add:
  url      scheme://… up to a blank, a quote or a bracket, with a host
  mailbox  user at/[at] host dot/[dot] top domain, spelt out
  account  an identifier after a cue (account, iban, ssn, passport, …), with a digit; an IBAN must pass modulo 97
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "mailbox", "account")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://", "mailto:")
CUES = (
    "account", "acct", "iban", "routing", "ssn", "social security", "passport", "driver license", "tax id", "customer id",
    "member id", "patient id", "employee id", "policy", "konto", "compte", "cuenta",
)
SPELT = (" at ", "[at]", "(at)")

_NO_HOST = frozenset(("the", "a", "an", "this", "that", "our", "your", "my"))
_DECIMAL = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>()\[\]{}]+")
_SPELT_HOST = re.compile(r"\s*([A-Za-z0-9-]+)\s?(?:\[dot\]|\(dot\)|\sdot\s)\s?([A-Za-z]{2,12})\b")
_IDENTIFIER = re.compile(r"(?:\s?(?i:number|no|nr|code|id))?[\x20.:#=]{1,3}([A-Z0-9][A-Z0-9-]{4,33})(?![A-Za-z0-9])", re.ASCII)
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    for s in SCHEMES:
        for t in {s, s.upper()}:
            found.add_word(t, ("scheme", len(t)))
    for c in CUES:
        for t in {c, c.capitalize(), c.title(), c.upper()}:
            found.add_word(t, ("cue", len(t)))
    for s in SPELT:
        found.add_word(s, ("spelt", len(s)))
    for a in "0123456789":
        for b in "0123456789":
            found.add_word(f"{a}.{b}", ("dot", 3))
            for between in ("", " ", "-"):
                found.add_word(a + between + b, ("digits", 2 + len(between)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    """The check digits of an international account number."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _ips(run: str, at: int) -> Iterator[tuple[int, int]]:
    """A run of numbers and dots is taken four numbers at a time, as a search from the left does."""
    parts = run.split(".")
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in four):
            yield at, end
        at = end + 1


def _card(run: str) -> bool:
    digits = run.replace(" ", "").replace("-", "") if len(run) >= 14 else ""
    return 14 <= len(digits) <= 19 and luhn(digits)


def _account(text: str, at: int) -> tuple[int, int] | None:
    m = _IDENTIFIER.match(text, at)
    if not m:
        return None
    value = m.group(1)
    digits = sum(c.isdigit() for c in value)
    known = _SSN.fullmatch(value) or iban(value)
    return m.span(1) if known or (digits >= 5 and not re.match(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10}", value)) else None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by start and then by kind; code points, end exclusive."""
    found: list[tuple[str, int, int]] = []
    done = {"email": 0, "phone": 0, "url": 0, "mailbox": 0, "account": 0, "dot": 0, "digits": 0}
    for last, (kind, length) in anchors.iter(text):
        start, end = last - length + 1, last + 1
        if kind == "digits":  # the first of a run stands at its start
            if start >= done["digits"]:
                m = _DIGITS.match(text, start)
                done["digits"] = m.end()
                if _card(m.group()):
                    found.append(("card", *m.span()))
        elif kind == "dot":
            if start >= done["dot"]:
                while start > done["dot"] and text[start - 1] in _DECIMAL:
                    start -= 1
                m = _DOTTED.match(text, start)
                done["dot"] = m.end()
                found += [("ip", a, b) for a, b in _ips(m.group(), start)]
        elif kind == "@":
            m = _DOMAIN.match(text, end)
            if m:
                left = start
                while left > done["email"] and text[left - 1] in _LOCAL:
                    left -= 1
                if left < start:
                    found.append(("email", left, m.end()))
                    done["email"] = m.end()
        elif kind == "+":
            m = _PHONE.match(text, start) if start >= done["phone"] else None
            if m:
                done["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", *m.span()))
        elif kind == "scheme":
            m = _URL.match(text, end) if start >= done["url"] else None
            if m:
                stop = end + len(m.group().rstrip(".,;:!?"))
                if stop > end:
                    found.append(("url", start, stop))
                    done["url"] = stop
        elif kind == "spelt":
            m = _SPELT_HOST.match(text, end)
            if text[start] != " " and start and text[start - 1] == " ":
                start -= 1
            left = start
            while left > done["mailbox"] and text[left - 1] in _LOCAL:
                left -= 1
            if m and left < start and m.group(1).lower() not in _NO_HOST:
                found.append(("mailbox", left, m.end()))
                done["mailbox"] = m.end()
        else:
            span = _account(text, end)
            if span and span[0] >= done["account"]:
                found.append(("account", *span))
                done["account"] = span[1]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row of ``docs`` (doc_id, text; others ignored).

    A null or empty text has no spans, a very long one is read whole. Repeated rows stay repeated, doc_id may be null, an empty
    table gives an empty result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, anchors)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int>>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of each base kind, the digest of the base spans, and all spans as text; nulls, repeats, long
    texts and empty tables as in ``find_personal_data``."""
    def told(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return find_personal_data(docs).select(
        "doc_id", *(count(k) for k in BASE), F.sha2(F.encode(told(base), "UTF-8"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
