import numpy as np

from millrace.llm import embedding_dedup as E

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    v = [None if r[1] is None or r[2] is None or any(x is None or not np.isfinite(x) for x in r[1]) or not any(r[1]) else np.array(r[1], dtype=np.float32).astype(float) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]):
                if v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (links[i], least[find(i)]) for i in range(len(rows))}


def vectors(n=400):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    rows = []
    for i in range(n):
        x = centers[rng.integers(30)] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])
        rows.append((i, [float(np.float32(y)) for y in x], int(rng.integers(3))))
    rows[5] = (5, None, 1)
    rows[6] = (6, [0.0] * 16, 1)
    rows[7] = (7, [float("nan")] * 16, 1)
    rows[8] = (8, rows[9][1], None)
    rows[10] = (10, rows[11][1], rows[11][2])
    rows[12] = (12, [1.0, 2.0], 0)
    rows[13] = (13, [2.0, 4.0], 0)
    rows[14] = (14, [None] + [1.0] * 15, 0)
    rows[15] = (15, [], 0)
    return rows


def test_against_brute_force(spark):
    rows = vectors()
    want = brute(rows)
    tile, E.TILE = E.TILE, 16
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    finally:
        E.TILE = tile
    assert len(got) == len(rows)
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert there > 500 and all(got[i][0] <= want[i][0] for i in got)
    assert found >= 0.95 * there, (found, there)
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.97 * len(rows)
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_copies_empty_and_repeats(spark):
    assert E.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    v = [1.0, 2.0, 3.0]
    rows = [(3, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (9, v, None), (9, v, 2)]
    got = sorted((repr(r["vec_id"]), r["n_links"], r["component_id"]) for r in E.near_duplicates(spark.createDataFrame(rows, KIND)).collect())
    assert got == [("2", 3, 2), ("2", 3, 2), ("3", 3, 2), ("9", 0, 9), ("9", 0, 9), ("None", 3, 2)]


def test_recall_in_a_close_label(spark):
    """A label whose vectors have a mutual cosine of 0.8, with neighbours at 0.94, and another label that is spread."""
    rng = np.random.default_rng(5)
    center = rng.normal(size=48)
    center /= np.linalg.norm(center)

    def away(n):
        x = rng.normal(size=(n, 48))
        x -= (x @ center)[:, None] * center
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    u, r = away(1500), away(1500)
    r -= (r * u).sum(axis=1, keepdims=True) * u
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    rho = (0.94 - 0.8) / 0.2
    close = np.concatenate([u, rho * u + np.sqrt(1 - rho**2) * r])
    close = np.sqrt(0.8) * center + np.sqrt(0.2) * close
    rows = [(i, x.tolist(), 0) for i, x in enumerate(close)] + [(9000 + i, x.tolist(), 1) for i, x in enumerate(away(300))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    there = (np.float32(close).astype(float) @ np.float32(close).astype(float).T >= 0.93).sum(axis=1) - 1
    found = np.array([got[i][0] for i in range(len(close))])
    assert there.sum() >= 3000 and (found <= there).all()
    assert found.sum() >= 0.95 * there.sum(), (found.sum(), there.sum())


def test_prefix_grows_where_vectors_are_close():
    rng = np.random.default_rng(6)
    spread = E._unit(rng.normal(size=(600, 32)))
    close = E._unit(spread * 0.45 + E._unit(rng.normal(size=(1, 32))))
    labels = np.array(["a"] * 600)
    assert E.fit_prefix(close, labels, 0.93, 2) > E.fit_prefix(spread, labels, 0.93, 2) >= 2
    assert E.fit_prefix(spread[:1], labels[:1], 0.93, 2) == 1 and E.fit_prefix(np.zeros((0, 0)), labels[:0], 0.93, 2) == 0


def test_candidates_are_those_that_share_enough():
    rng = np.random.default_rng(7)
    near = np.sort(np.stack([rng.choice(40, 6, replace=False) for _ in range(120)]), axis=1)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(set(near[i]) & set(near[j])) >= 2 and min(set(near[i]) & set(near[j])) == 3}
    mine = np.flatnonzero((near == 3).any(axis=1))
    got = {(int(a), int(b)) for i, j in E._candidates(near, mine, mine, True, 3, 2, rows=16, pairs=8) for a, b in zip(i, j)}
    assert got == want and want


def test_large_ids_beside_null_and_other_columns(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(2**60 + 1, v, 1, "x"), (None, v, 1, None), (2**60 + 3, v, 1, ""), (2**60 + 5, [-0.0, 5.0, 0.0], 1, "y")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(spark.createDataFrame(rows, KIND + ", class string")).collect()}
    assert got[2**60 + 1] == (2, 2**60 + 1) and got[2**60 + 3] == (2, 2**60 + 1) and got[None] == (2, 2**60 + 1) and got[2**60 + 5] == (0, 2**60 + 5)
