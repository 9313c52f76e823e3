"""Personal data: regular expressions propose spans, checksums confirm them, and context words adjust their score.

The kinds ``email``, ``ip``, ``card`` and ``phone`` are defined by shape (and Luhn for cards) and are always kept. The
method adds ``iban`` (mod-97), ``ssn``, ``national`` (phone numbers without a country code) and ``secret`` where the
score with context reaches a threshold and no other span overlaps. Every scan below is linear in the text: a run of
digits, dots or letters is read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "national", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+")

#: Words that raise the score of a kind when they stand near a span.
CONTEXT = {
    "email": "email mail contact write",
    "ip": "ip address host server client",
    "card": "card visa mastercard amex credit debit payment",
    "phone": "phone tel telephone mobile call fax cell",
    "iban": "iban account bank transfer konto compte cuenta",
    "ssn": "ssn social security",
    "national": "phone tel telephone mobile call fax cell telefon téléphone teléfono",
    "secret": "token secret password passwd apikey api_key key credential",
}
_CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(v.split()) + r")(?!\w)", re.IGNORECASE) for k, v in CONTEXT.items()}
#: Score by shape and checksum alone, and what a context word adds. Added kinds count from THRESHOLD on.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "national": 0.3, "secret": 0.2}
NEAR, BONUS, THRESHOLD = 40, 0.4, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = ord(x) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(x, 36)) for x in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one @, whose local part is the run of local characters before it (after the last match)."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def addresses(text: str) -> list[tuple[int, int]]:
    """A dotted run of numbers holds a match in each four numbers in turn."""
    out = []
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, at = run.split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]


def _near(text: str, kind: str, start: int, end: int) -> bool:
    find = _CONTEXT[kind].search
    return bool(find(text, max(0, start - NEAR), start) or find(text, end, min(len(text), end + NEAR)))


def _confirmed(kind: str, found: str) -> bool:
    if kind == "iban":
        bare = found.replace(" ", "")
        return 15 <= len(bare) <= 34 and mod97(bare)
    if kind == "secret":
        return sum(map(str.isdigit, found)) >= 4 and sum(map(str.isalpha, found)) >= 4
    return True


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by kind and start; ends are exclusive, places count code points."""
    if not text:
        return []
    out = []
    digits = _HAS_DIGIT(text) is not None
    if "@" in text:
        out += [("email", *x) for x in emails(text)]
    if digits:
        out += [("ip", *x) for x in addresses(text)]
        out += [("card", *x) for x in cards(text)]
        if "+" in text:
            out += [("phone", *x) for x in phones(text)]
    scored = [(k, s, e, round(min(1.0, SCORE[k] + BONUS * _near(text, k, s, e)), 2)) for k, s, e in out]
    if digits:
        taken = sorted((s, e) for _, s, e in out)
        for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("national", _NATIONAL), ("secret", _SECRET)):
            for m in pattern.finditer(text):
                start, end = m.span()
                if not _confirmed(kind, m.group()) or any(s < end and start < e for s, e in taken):
                    continue
                score = SCORE[kind] + BONUS * _near(text, kind, start, end)
                if score >= THRESHOLD:
                    scored.append((kind, start, end, round(min(1.0, score), 2)))
                    taken.append((start, end))
    rank = KINDS.index
    return sorted(scored, key=lambda x: (rank(x[0]), x[1]))


_HAS_DIGIT = re.compile("[0-9]").search


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``, an array of ``(kind, start, end, score)`` structs, in place of such a column.

    A null or empty text has none. Every text is read whole; rows stay as they are, repeated ones too.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def spans(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "score")
        return pd.Series([[dict(zip(names, x)) for x in find_spans(t)] for t in texts], dtype=object)

    return docs.drop("pii").withColumn("pii", spans(F.col(text)))


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span (the longer of overlapping ones) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start < at:
            if end > at:  # what sticks out of the span before goes with it
                at = end
            continue
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text; other columns and all rows stay. A null text stays null."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([mask(t, s) if t and (s := find_spans(t)) else t for t in texts], dtype=object)

    return docs.withColumn(text, masked(F.col(text)))


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts and span lists of the contract: ``n_email, n_ip, n_card, n_phone, base_sha256, spans`` and more."""
    out = annotate(docs.select("doc_id", text), text)

    def listed(spans):
        parts = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
        return F.array_join(parts, ",")

    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    of_kind = lambda kind: F.filter("pii", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    added = F.size(F.filter("pii", lambda x: ~x["kind"].isin(*BASE))).cast("long").alias("n_added")
    mean = F.when(F.size("pii") > 0, F.aggregate("pii", F.lit(0.0), lambda a, x: a + x["score"]) / F.size("pii")).alias("mean_score")
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), added, mean)
