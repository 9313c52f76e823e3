"""Texts to windows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CODE_SIZE, CODE_OVERLAP = 50, 10
DOC_SIZE, DOC_OVERLAP, SECTION_LINES = 60, 10, 120
CODE_BYTES, DOC_BYTES = 64 << 10, 256 << 10
UNDERLINE = r'^\s*[=\-~^*"]{3,}\s*$'


def eligible(path: Column, content: Column, parse_error: Column) -> Column:
    """Whether a file is chunked: parsed, of a known language and not too large."""
    cap = F.when(T.is_doc(path), F.lit(DOC_BYTES)).otherwise(F.lit(CODE_BYTES))
    return ~F.coalesce(parse_error, F.lit(False)) & (T.language(path) != "other") & (F.octet_length(content) <= cap)


def window_starts(n: Column, size: int, step: int) -> Column:
    """Starts (from 0) of windows over ``n`` lines: the last window is the first that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)


def chunk_lines(df: DataFrame, text: str = "text", size: int = CODE_SIZE, overlap: int = CODE_OVERLAP) -> DataFrame:
    """One row ``idx, chunk, line_start, line_end`` for each window of lines; a text without lines gives none."""
    step = max(1, size - overlap)
    rows = df.withColumn("_lines", T.lines(F.col(text))).where(F.size("_lines") > 0)

    def piece(start: Column, idx: Column) -> Column:
        part = F.slice("_lines", start + 1, F.lit(size))
        return F.struct(idx.alias("idx"), F.array_join(part, "\n").alias("chunk"), (start + 1).alias("line_start"), (start + F.size(part)).alias("line_end"))

    return rows.select(*df.columns, F.inline(F.transform(window_starts(F.size("_lines"), size, step), piece)))


def doc_sections(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Sections of documents by headings: ``section, heading, line_start, line_end`` (lines from 1).

    A heading begins with ``#`` (not ``#!``) or stands over a line of three or more underline signs. Lines before the
    first heading belong to no section. A text without headings is one section without a heading.
    """
    rows = df.select(*key, T.lines(F.col(text)).alias("_lines")).where(F.size("_lines") > 0)
    n, line, under = F.size("_lines").alias("_n"), F.col("_p._lines"), F.col("_p._under")
    at = rows.select(*key, n, F.posexplode(F.arrays_zip("_lines", F.slice("_lines", 2, F.size("_lines")).alias("_under"))).alias("_i", "_p"))
    hashed = F.ltrim(line).startswith("#") & ~F.ltrim(line).startswith("#!")
    ruled = F.coalesce(under.rlike(UNDERLINE), F.lit(False)) & (F.trim(line) != "") & ~line.rlike(UNDERLINE)
    heads = at.where(hashed | ruled).select(*key, "_n", "_i", F.trim(line).alias("heading"))
    # A row before the first line of each document: the documents that have no other are one section.
    marks = heads.unionByName(rows.select(*key, n, F.lit(-1).alias("_i"), F.lit("").alias("heading")))
    w = Window.partitionBy(*key).orderBy("_i")
    follow = F.lead("_i").over(w)
    found = marks.select(*key, "_n", "_i", "heading", (F.row_number().over(w) - 2).alias("_s"), follow.alias("_next")).where("_i >= 0 or _next is null")
    return found.select(
        *key,
        F.greatest("_s", F.lit(0)).alias("section"),
        "heading",
        (F.greatest("_i", F.lit(0)) + 1).alias("line_start"),
        F.coalesce("_next", F.col("_n")).cast("int").alias("line_end"),
    )


def chunk_docs(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Chunks of documents by section: short sections whole, long ones in windows led by their heading."""
    step = DOC_SIZE - DOC_OVERLAP
    s = doc_sections(df, key, text).join(df.select(*key, T.lines(F.col(text)).alias("_lines")), key)
    n = F.col("line_end") - F.col("line_start") + 1
    starts = F.when((n <= SECTION_LINES) & (F.col("heading") != ""), F.array(F.lit(0))).otherwise(window_starts(n, DOC_SIZE, step))
    span = F.when((n <= SECTION_LINES) & (F.col("heading") != ""), n).otherwise(F.lit(DOC_SIZE))
    s = s.withColumn("_span", span).select("*", F.posexplode(starts).alias("_k", "_at"))
    first = F.col("line_start") + F.col("_at")
    last = F.least(first + F.col("_span") - 1, F.col("line_end"))
    body = F.array_join(F.slice("_lines", first, last - first + 1), "\n")
    lead = F.when((F.col("_k") > 0) & (F.col("heading") != ""), F.concat(F.col("heading"), F.lit("\n"))).otherwise(F.lit(""))
    order = Window.partitionBy(*key).orderBy("section", "_k")
    return s.select(*key, (F.row_number().over(order) - 1).alias("idx"), F.concat(lead, body).alias("chunk"), first.alias("line_start"), last.alias("line_end"))
