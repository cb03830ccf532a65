import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import pii


def brute(text):
    """The base kinds by plain regular expressions."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.BASE.index(s[0])))


def base(text):
    return [s for s in pii.spans(text, pii.automaton()) if s[0] in pii.BASE]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab@.%+-_ 0123456789()é", max_size=60))
def test_base_spans_equal_regular_expressions(text):
    assert base(text) == brute(text)


def test_known_forms():
    text = "Mail joe.x@mail.example.com, +1 (811) 555-3281 or 10.0.0.255; card 4111 1111 1111 1111. IBAN: DE89370400440532013000 https://u:p@h.example/x?"
    kinds = [(k, text[a:b]) for k, a, b in pii.spans(text, pii.automaton())]
    assert ("email", "joe.x@mail.example.com") in kinds
    assert ("phone", "+1 (811) 555-3281") in kinds
    assert ("ip", "10.0.0.255") in kinds
    assert ("card", "4111 1111 1111 1111") in kinds
    assert ("account", "DE89370400440532013000") in kinds
    assert ("url", "https://u:p@h.example/x") in kinds


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.- +", max_size=80))
def test_base_spans_of_digits(text):
    assert base(text) == brute(text)


def test_added_kinds():
    yes = {
        "write to joe at example dot com now": ("mailbox", "joe at example dot com"), "joe.x [at] example [dot] org": ("mailbox", "joe.x [at] example [dot] org"), "ann(at)mail(dot)net": ("mailbox", "ann(at)mail(dot)net"),
        "SSN: 078-05-1120.": ("account", "078-05-1120"), "account number: 00123456789": ("account", "00123456789"), "Passport No. X12345678 of": ("account", "X12345678"), "IBAN GB82WEST12345698765432,": ("account", "GB82WEST12345698765432"),
        "see HTTPS://example.org/a?b=c.": ("url", "HTTPS://example.org/a?b=c"), "(ftp://host/x)": ("url", "ftp://host/x"), "mailto:a@b.example": ("url", "mailto:a@b.example"),
    }
    for text, (kind, value) in yes.items():
        assert [text[a:b] for k, a, b in pii.spans(text, pii.automaton()) if k == kind] == [value], text
    for text in ("meet at the dot com fair", "he was at home dot", "IBAN GB82WEST12345698765433", "account of the year", "policy: none", "http:// nothing", "the passport was lost", "compte rendu"):
        assert not [s for s in pii.spans(text, pii.automaton()) if s[0] not in pii.BASE], text


def test_table(spark):
    rows = [(1, "a@b.c and a@b.c", "x"), (2, None, "x"), (3, "", "x"), (None, "+12345678901", "x"), (3, "", "x"), (4, "1.1.1.1 " * 50_000, "x")]
    out = {r["doc_id"]: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert out[1]["n_email"] == 2 and out[1]["spans"] == "email:0:5,email:10:15"
    assert out[1]["base_sha256"] == hashlib.sha256(b"email:0:5,email:10:15").hexdigest()
    assert out[2]["base_sha256"] == out[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[None]["n_phone"] == 1 and out[4]["n_ip"] == 50_000
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digests(empty).count() == 0
