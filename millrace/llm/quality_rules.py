"""Line-first cleaning by quality rules, with DataFrame operations only.

Rules for punctuation, navigation and boilerplate are evaluated for each line. Lines that fail are removed, and a
document that loses too much of its text is rejected. Statistics of whole texts (repeats, symbols) come along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

BLANK = r"[\x20\x09-\x0D]"
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
ENDS = r"[.!?:;…。！？»”’\"')\]}]" + BLANK + r"*$"
NAVIGATION = r"(?:[|»›•>·].*){3}|(?i:^" + BLANK + r"*(?:home|menu|next|previous|back to top|skip to content|share|log ?in|sign ?(?:in|up)|read more|contact us)" + BLANK + r"*$)"
BOILERPLATE = r"(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookies?\b.{0,40}\b(?:policy|accept|settings)|(?:enable|requires?) javascript|copyright (?:©|\(c\))|subscribe to our|lorem ipsum)\b"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: bound to a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Where all are different, the count is zero; else hashes are sorted with
    their places, the places of equal neighbours are the repeated windows, and each covers the words up to the next.
    """
    n = F.size(words)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def same(p: Column) -> Column:
            kept = F.filter(
                F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])),
                lambda x: x.isNotNull(),
            )
            return F.sort_array(kept)

        return _let(pairs, same)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.coalesce(F.least(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(places(h), covered))

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(windows(words), repeated))


def line_fails(line: Column) -> Column:
    """Whether a line with a word is dropped: navigation, boilerplate, symbols, shouting or a stub without an end."""
    length = F.length(line)
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    upper = F.regexp_count(line, F.lit(r"\p{Lu}"))
    words = F.regexp_count(line, F.lit(WORD))
    stub = (words < 3) & ~line.rlike(ENDS)
    return (
        stub
        | (symbols * 10 > length)
        | ((upper * 2 > letters) & (letters >= 20))
        | line.rlike(NAVIGATION)
        | line.rlike(BOILERPLATE)
    )


def rate(docs: DataFrame, min_words: int = 10, max_repeat: int = 20, min_left: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and ``clean_text`` added (in place of such columns).

    Counts: ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word that
    equal an earlier one), ``n_repeat_words``. A document fails the base rules with fewer than ``min_words`` words or
    over ``max_repeat`` percent repeated words; it is kept if it passes them and the lines left by :func:`line_fails`
    hold at least ``min_left`` of its word characters. ``clean_text`` is the text of those lines. A null text has no
    words and fails. Rows stay as they are otherwise, repeated ones too.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(*added, "_words", "_lines", "_left").withColumn("_words", words_of(body))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.aggregate("_words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    out = out.withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("n_repeat_words", _let(F.col("_words"), _repeat_words))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    out = out.withColumn("_left", F.filter("_lines", lambda x: ~line_fails(x)))
    left = F.aggregate("_left", F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x, BLANK + "+", "")))
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= F.lit(min_left) * F.col("word_chars")))
    return out.withColumn("clean_text", F.array_join("_left", "\n")).drop("_words", "_lines", "_left")
