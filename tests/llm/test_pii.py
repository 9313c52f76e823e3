import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii

from .data import frame, with_clashes


def base(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    return [
        *(("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)),
        *(("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))),
        *(("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))),
        *(("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15),
    ]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ09@.+-_% ()\n41é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE] == base(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def test_context_decides_added_spans():
    assert [x[0] for x in pii.find_spans("pay to GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert [x[0] for x in pii.find_spans("call my phone 555-123-4567 now")] == ["national"] and not pii.find_spans("part 555-123-4567 here")
    assert [x[0] for x in pii.find_spans("his social security number 123-45-6789")] == ["ssn"] and not pii.find_spans("code 123-45-6789")
    assert [x[0] for x in pii.find_spans('token = "24be64439e3e49cf46b2d7c90f3602a3"')] == ["secret"] and not pii.find_spans("24be64439e3e49cf46b2d7c90f3602a3")
    with_word, without = pii.find_spans("card 4111111111111111")[0], pii.find_spans("xx 4111111111111111")[0]
    assert with_word[3] > without[3]


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "AB12" * 80_000, "1 " * 150_000, "a-" * 150_000):
        pii.find_spans(text)


def test_digest_and_mask(spark):
    text = "é mail a.b@c.de, 10.0.0.1 and +1 (222) 333-4444"
    rows = [(1, text, "en", "s", 1), (None, None, "en", "s", 1), (3, "", "en", "s", 1), (3, "", "en", "s", 1)]
    got = sorted(pii.digest(with_clashes(frame(spark, rows), "pii", "spans")).collect(), key=lambda r: -(r["doc_id"] == 1))
    listed = ",".join(":".join(map(str, x)) for x in base(text))
    assert got[0]["spans"] == listed and got[0]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_card"], got[0]["n_phone"]) == (1, 1, 0, 1)
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got[1:]) and len(got) == 4
    masked = pii.redact(frame(spark, rows)).collect()
    assert masked[0]["text"] == "é mail <EMAIL>, <IP> and <PHONE>" and masked[1]["text"] is None
    assert pii.digest(frame(spark, [])).count() == 0
    assert pii.mask("abcdef", [("x", 1, 4, 1.0), ("y", 2, 5, 1.0)]) == "a<X>f"


def test_secrets_of_any_length():
    for n in (24, 200, 201, 4000, 300_000):
        run = ("aB3+d/9x" * (n // 8 + 1))[:n]
        assert [x[:3] for x in pii.find_spans(f"token: {run} end")] == [("secret", 7, 7 + n)], n
    assert not pii.find_spans("token: aB3+d/9xaB3+d/9xaB3+d/9")
    for run in ("aB3-" * 75_000, "-" * 300_000 + "1", "aB3 " * 75_000):
        pii.find_spans(f"token: {run}")
