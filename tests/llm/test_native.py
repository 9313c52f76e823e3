"""Mixing, sharding and line rules against brute force."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, quality_rules, sharding

from .data import documents, frame, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, sources, cycle=(1, 2, 3), most=3):
    total = Counter()
    for i, s in sources.items():
        total[s] += sizes[i]
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * total[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = most * total[s]
            left -= out[s]
        free -= over
    return out, total


def test_mix(spark):
    rows = documents()
    sizes, sources = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}, {r[0]: r[3] for r in rows}
    want, total = targets(sizes, sources)
    out = mixing.mix(with_clashes(frame(spark, rows), "size", "target", "key", "copies")).collect()
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in out} == {(r["doc_id"], r["taken"]) for r in again}
    got = Counter()
    for r in out:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["cut_words"]
        got[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(got[s] - t) <= 1


def test_mixed_documents_are_rows(spark):
    rows = documents()
    df = frame(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want, _ = targets({r[0]: len(WORD.findall(r[1] or "")) for r in rows}, {r[0]: r[3] for r in rows})
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert all(abs(got[s] - t) <= 9000 for s, t in want.items())


def test_mix_ties_empty_and_one_source(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = [(5, "a b c", "en", "x", 1)] * 4 + [(None, None, "en", "y", 1)]
    out = mixing.mix(frame(spark, rows)).collect()
    assert sum(r["taken"] for r in out if r["source"] == "x") == 12
    assert [r["taken"] for r in out if r["source"] == "y"] == [0]
    rows = [(5, "a b c", "en", "x", 1)] * 4 + [(6, "a b", "en", "y", 1)] * 9
    out = mixing.mix(frame(spark, rows)).collect()
    assert abs(sum(r["taken"] for r in out if r["source"] == "x") - 10) <= 4


def test_shards(spark):
    rows = documents()
    out = sharding.shard(with_clashes(frame(spark, rows), "size", "shard", "slot", "s"), 7)
    by = {}
    for r in out.collect():
        body = (rows[r["doc_id"]][1] or "").encode()
        assert r["size"] == len(body) + 16 and r["text_crc32"] == zlib.crc32(body)
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(k, [])) for k in range(7)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(frame(spark, rows).repartition(5), 7).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in out.collect()}
    assert sharding.shard(frame(spark, []), 7).count() == 0
    same = sharding.shard(frame(spark, [(None, None, "en", "x", 1)] * 9), 4).collect()
    assert sorted(Counter(r["shard"] for r in same).values()) == [2, 2, 2, 3]


def test_few_rows_move_to_a_new_shard(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard(df, n).collect()} for n in (20, 21))
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a)


def test_flow_is_bounded_and_complete():
    nodes = [(0, 0), (3, 1), (6, 2)]
    runs = sharding.flow({1: 10, 5: 1, 7: 2}, nodes, [5, 4, 4])
    held = Counter()
    for r in runs:
        held[r["shard"]] += r["hi"] - r["lo"]
    assert held == {0: 5, 1: 4, 2: 4}
    with pytest.raises(ValueError):
        sharding.flow({1: 3}, nodes, [1, 1, 0])


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_line_rules(spark):
    rows = documents()
    rows += [(300, "a b c d e a b c d e", "en", "s", 1), (301, "a b c d", "en", "s", 1), (302, "a a a a a a a b", "en", "s", 1), (303, "x y z\x0bq #|", "en", "s", 1)]
    for r in quality_rules.rate(with_clashes(frame(spark, rows), "n_words", "kept", "_words")).collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        want = base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.rate(frame(spark, [])).count() == 0


def test_lines_are_judged_first(spark):
    clean = "A plain sentence about nothing at all, with an end.\n" * 2 + "Another one that says a little more than that."
    menu = "Home | About | Contact | Shop\nREAD ALL ABOUT THIS GREAT OFFER NOW\nAll rights reserved by us here\n### ### ###"
    rows = [(1, clean, "en", "s", 1), (2, clean + "\n" + menu, "en", "s", 1), (3, menu + "\n" + "Short tail that ends.", "en", "s", 1)]
    got = {r["doc_id"]: r for r in quality_rules.rate(frame(spark, rows), max_repeat=100).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == clean
    assert got[2]["clean_text"] == clean and not got[3]["kept"]


def test_quality_rules_sql(spark, tmp_path):
    """The registered query and its SQL give the same rows on whole tables with nulls, repeats and very long texts."""
    duckdb = pytest.importorskip("duckdb")
    from millrace.llm import queries

    lines = "Home | News | Shop | Cart\nShort stub\nThis line is a sentence, and it ends.\nTHIS IS SHOUTING ALL OF THE WAY THROUGH\nAll rights reserved by us\n#$% &|<> **\n"
    odd = [(9001, lines * 3, "en", "a", 1), (9002, "one two three four five six " * 4000, "en", "a", 1), (9002, "é ü　ß \t x\r\n" * 9, None, None, 1), (None, "a b c d e f g h i j.\n\n a", "en", "a", 1)]
    frame(spark, documents() + odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op4_quality_rules"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(queries.oracle_sql()["op4_quality_rules"])
        at = [want.columns.index(x) for x in got.columns]
        want = [tuple(r[k] for k in at) for r in want.fetchall()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in want} == {True, False}
