import random

import numpy as np
import xxhash

from millrace.llm import shingle_links, simhash
from millrace.llm.components import connected_components

from .data import documents, frame, with_clashes


def brute(rows, bits=2):
    prints = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[i] = sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))
    parent = {i: i for i in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (p, find(i)) for i, p in prints.items()}


def test_against_brute_force(spark):
    rows = documents()
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(with_clashes(frame(spark, rows), "fp", "root", "component_id", "n")).collect()}
    assert got == brute(rows)


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [b ^ np.uint64((1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))) for b in base for _ in range(12)]
    fps = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    tile, small = simhash.TILE, simhash.SMALL
    simhash.TILE, simhash.SMALL = 8, 4
    try:
        edges = simhash.links(df, 2).collect()
    finally:
        simhash.TILE, simhash.SMALL = tile, small
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for e in edges:
        a, b = np.array([e["a"], e["b"]]).view(np.uint64)
        assert bin(int(a ^ b)).count("1") <= 2
        parent[find(e["a"])] = find(e["b"])
    for i, a in enumerate(fps):
        for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 2]:
            assert find(int(a.view(np.int64))) == find(int(b.view(np.int64)))


def test_empty_table_nulls_and_repeats(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.deduplicate(frame(spark, [])).count() == 0
    rows = [(None, "alpha beta gamma", "en", "s", 1), (1, "alpha beta gamma", "en", "s", 1), (1, "alpha beta gamma", "en", "s", 1), (None, "other text here now", "en", "s", 1)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 1), (1, 1), (1, 1), (None, None)], key=repr)
    kept = simhash.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r["doc_id"] is None for r in kept.collect())) == [False, True, True]


def test_stage_finds_copies_and_near_copies(spark):
    rows = documents()
    long = rows[10][1]
    changed = long.split(" ")
    changed[100] = "replaced"
    rows += [(500, long + " tail", "en", "s", 1), (501, " ".join(changed), "en", "s", 1)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_by_similarity(frame(spark, rows)).collect()}
    assert got[500] == got[501] == 10 and got[90] == got[91] == got[3] == 2
    alone = [i for i in range(20, 90) if got[i] != i]
    assert not alone


def connected(edges):
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_of_paths_and_hubs(spark):
    rng = np.random.default_rng(4)
    name = rng.permutation(400).tolist()
    edges = [(name[k], name[k + 1]) for k in range(0, 150)] + [(name[200], name[k]) for k in range(201, 300)] + [(name[k], name[k + 50]) for k in range(300, 350)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == connected({e for e in edges if e[0] != e[1]})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(rng, n):
    return [f"w{int(rng.paretovariate(0.7))}" for _ in range(n)]


def edited_pairs():
    """Texts of 30 to 400 words and copies with a tail, changed words or one changed word; some share a long line."""
    rng, rows = random.Random(9), []
    line = words_of(rng, 60)
    for k in range(240):
        n = (30, 60, 150, 400)[k % 4]
        words = words_of(rng, n) + (line if k % 5 == 0 else [])
        copy = list(words)
        if k % 3 == 0:
            copy += words_of(rng, len(words) // 10)
        else:
            for at in rng.sample(range(len(copy)), 1 if k % 3 == 1 else max(1, len(copy) // 50)):
                copy[at] = f"x{k}-{at}"
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join(copy), "en", "s", 1)]
    return rows


def wanted_components(rows, similarity=0.8):
    sets = {}
    for i, t, *_ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    pairs = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
    joined = connected(pairs)
    return {i: joined.get(i, i) for i in ids}, pairs


def test_stage_misses_no_similar_pair(spark):
    rows = edited_pairs()
    wanted, pairs = wanted_components(rows)
    assert len(pairs) > 200
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_by_similarity(frame(spark, rows)).collect()}
    missed = [p for p in pairs if got[p[0]] != got[p[1]]]
    assert not missed, f"{len(missed)} of {len(pairs)} pairs"


def test_any_order_of_shingles_and_tiles_misses_no_pair(spark, monkeypatch):
    """Lists in many tiles and salts, texts whose shingles are all common, and any order of shingles: no pair is missed."""
    rng = random.Random(11)
    base = words_of(rng, 80)
    rows = edited_pairs()[:60]
    for k in range(40):
        copy = list(base)
        for at in rng.sample(range(80), k % 5):
            copy[at] = f"y{k}-{at}"
        rows.append((1000 + k, " ".join(copy), "en", "s", 1))
    wanted, _ = wanted_components(rows)
    for common, tile, listed, unit, ids in ((2, 4, 8, 100, 0), (1000, 3, 4096, 400_000, 10**6), (1, 512, 2, 50, 10**6)):
        for name, value in (("COMMON", common), ("TILE", tile), ("LIST_ROWS", listed), ("UNIT_SHINGLES", unit), ("BROADCAST_ROWS", ids)):
            monkeypatch.setattr(shingle_links, name, value)
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_by_similarity(frame(spark, rows)).collect()}
        assert got == wanted


def test_ids_of_any_kind_and_size(spark):
    """Text ids, and ids above 2^53 beside a null, come back as they were."""
    rows = edited_pairs()[:20]
    wanted, _ = wanted_components(rows)
    named = spark.createDataFrame([(f"d{r[0]:03d}", r[1]) for r in rows], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_by_similarity(named).collect()}
    assert got == {f"d{k:03d}": f"d{v:03d}" for k, v in wanted.items()}
    big = (1 << 60) + 1
    large = spark.createDataFrame([(big + r[0], r[1]) for r in rows] + [(None, rows[0][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_by_similarity(large).collect()}
    assert got == {big + k: big + v for k, v in wanted.items()} | {None: big}
    assert {r["doc_id"] for r in simhash.near_duplicates(large).collect()} == {None, *(big + r[0] for r in rows)}


def test_stage_keeps_unlike_texts_with_a_repeated_line(spark):
    """One line repeated 30 times decides both fingerprints, but the bodies share nothing."""
    rng, rows = random.Random(12), []
    for k in range(20):
        line = " ".join(words_of(rng, 9)) + "\n"
        rows += [(2 * k + i, line * 30 + " ".join(f"b{k}-{i}-{n}" for n in range(150)), "en", "s", 1) for i in (0, 1)]
    wanted, pairs = wanted_components(rows)
    assert not pairs
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert any(near[2 * k] == near[2 * k + 1] for k in range(20))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_by_similarity(frame(spark, rows)).collect()}
    merged = [k for k in range(20) if got[2 * k] == got[2 * k + 1]]
    assert not merged, f"{len(merged)} of 20 pairs"


def test_stage_compares_each_text_of_a_fingerprint(spark):
    """Texts A and B differ but have one fingerprint; C is like B alone and must not be lost with A as their head."""
    rng, rows, triples = random.Random(12), [], []
    for k in range(20):
        line = " ".join(words_of(rng, 9)) + "\n"
        body = [[f"b{k}-{i}-{n}" for n in range(150)] for i in (0, 1)]
        texts = [line * 30 + " ".join(body[0]), line * 30 + " ".join(body[1]), line + " ".join(body[1])]
        if simhash.fingerprint(texts[0]) == simhash.fingerprint(texts[1]):
            triples.append(3 * k)
            rows += [(3 * k + i, x, "en", "s", 1) for i, x in enumerate(texts)]
    assert triples
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_by_similarity(frame(spark, rows)).collect()}
    lost = [k for k in triples if got[k + 1] != got[k + 2]]
    assert not lost, f"{len(lost)} of {len(triples)} links"
    assert all(got[k] == k and got[k + 1] == k + 1 for k in triples)


def test_common_shingles_are_counted_over_all_texts(spark):
    """Passages of 10,000 and of 40 of 20,000 texts: the counts that order shingles and deal out lists are no sample's."""
    passage, rare = [f"p{k}" for k in range(7)], [f"r{k}" for k in range(6)]
    texts = [" ".join([f"u{k}-{j}" for j in range(5)] + (passage if k % 2 else []) + (rare if k % 500 == 0 else [])) for k in range(20_000)]
    wanted = {}
    for text in texts:
        for h in shingle_links.shingle_set(shingle_links.words_of(text), 5).tolist():
            wanted[h] = wanted.get(h, 0) + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes, counts, *_ = shingle_links._common_shingles(docs, 5, "text")
    got = dict(zip(hashes.tolist(), counts.tolist()))
    assert got == {h: wanted[h] for h in got}
    assert hashes.tolist() == sorted(got)
    assert sorted(n for n in got.values() if n >= 40) == [40, 40, 10_000, 10_000, 10_000]


def test_bucket_counts_hold_every_shingle(spark, monkeypatch):
    """More than 255 in a bucket, texts in several tasks, and copies within a task, which count once."""
    monkeypatch.setattr(shingle_links, "MOST_BUCKETS", 4096)
    monkeypatch.setattr(shingle_links, "CHUNK", 1024)
    texts = [f"same five words each time u{k} v{k}" for k in range(3000)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    wanted = np.zeros(4096, dtype=np.int64)
    for text in texts:
        np.add.at(wanted, shingle_links.shingle_set(shingle_links.words_of(text), 5) & 4095, 1)
    assert wanted.max() >= 3000
    assert (shingle_links._bucket_counts(docs.repartition(5), 5, "text") == wanted).all()
    assert (shingle_links._bucket_counts(docs.unionByName(docs).coalesce(1), 5, "text") == wanted).all()
    assert not shingle_links._bucket_counts(docs.limit(0), 5, "text").any()
