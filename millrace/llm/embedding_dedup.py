"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest pivots (a prefix of its permutation of the pivots). Two vectors are candidates if
their prefixes share ``share`` pivots or more, and only the vectors of candidates are multiplied, in double precision.
Pivots are a bounded, documented sample of the vectors, their number grows with the square root of the distinct vectors
of the largest label, and every vector is indexed.

The inverted list of a pivot holds the vectors that have it in their prefix. Two prefixes of length p that share s
pivots share one of the p - s + 1 that come first in any order of the pivots, so a vector enters the lists of its
rarest p - s + 1 pivots alone, and a pair is counted in the list of the first pivot that it shares.

The length of the prefix is fitted: the more pivots there are, and the closer the vectors of a label lie together, the
fewer of the nearest pivots two neighbours share. Each sampled vector is moved, along the difference of two others of
its label, to the threshold's cosine, and the shortest prefix is taken that finds ``RECALL`` of these neighbours in
every label.

Equal vectors of a label are one class, so copies cost one row. Lists are compared in tiles, a hot list as pairs of
its tiles in different tasks. A tile gives the number of partners of each class and a spanning forest of its links,
never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .simhash import _forest

MAX_PIVOTS = 65_536
SHARE, RECALL, LONGEST = 2, 0.98, 64
TILE = 1024
SALTS = 16


def _valid(vector: Column) -> Column:
    """The vector in double precision; null for one that links with nothing."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return F.when((F.size(x) > 0) & finite & F.exists(x, lambda y: y != 0), x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(classes: DataFrame, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``pivots`` vectors of the commonest dimension, chosen by a hash of their content, and their labels."""
    rows = classes.select("label", "vector", F.xxhash64("vector").alias("h")).orderBy("h", "label").limit(pivots).toPandas()
    if not len(rows):
        return np.zeros((0, 0)), np.zeros(0, dtype=object)
    sizes = rows["vector"].map(len)
    right = sizes == sizes.mode().iloc[0]
    return _unit(np.stack([np.asarray(v, float) for v in rows["vector"][right]])), rows["label"][right].to_numpy()


def _nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest pivots of each row, nearest first; ties by number."""
    return np.concatenate([np.argsort(-(x[at : at + 256] @ pivots.T), axis=1, kind="stable")[:, :k] for at in range(0, len(x), 256)])


def fit_prefix(pivots: np.ndarray, labels: np.ndarray, threshold: float, share: int, recall: float = RECALL) -> int:
    """The shortest prefix that finds ``recall`` of neighbours at the threshold's cosine in each label's sample."""
    longest = min(LONGEST, len(pivots))
    rng, best = np.random.default_rng(0), min(share, longest)
    for label in sorted(set(labels)):
        own = pivots[labels == label]
        if len(own) < 8:
            continue
        x = own[:256]
        # Moved along the difference of two others, not along a random direction: neighbours stay within their label.
        a, b = rng.integers(0, len(own), (2, len(x)))
        along = own[a] - own[b]
        along -= (along * x).sum(axis=1, keepdims=True) * x
        size = np.sqrt((along * along).sum(axis=1))
        x, along = x[size > 1e-9], along[size > 1e-9]
        if not len(x):
            continue
        moved = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * _unit(along)
        both = _nearest(x, pivots, longest)[:, :, None] == _nearest(moved, pivots, longest)[:, None, :]
        while best < longest and (both[:, :best, :best].sum(axis=(1, 2)) >= share).mean() < recall:
            best += 1
    return best


def near_duplicates(rows: DataFrame, threshold: float = 0.93, prefix: int | None = None, share: int = SHARE, pivots: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``rows(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine is ``threshold`` or more. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and neither do vectors of different
    lengths. ``n_links`` counts rows, copies included. ``component_id`` is the smallest id reachable, itself included;
    a null id is counted as a partner but names no component. Ids of any type stay as they are. Rows stay as they are,
    repeated ones too; an empty table gives an empty one, and other columns are not read.
    """

    given = rows.select("vec_id", F.col("label").cast("string").alias("label"), _valid(F.col("embedding")).alias("vector"))
    # Copies by content: negative zeros were made positive by Spark's grouping rules only for scalars, so the class is
    # named by a digest of the components as text.
    name = F.when(F.col("label").isNotNull() & F.col("vector").isNotNull(), F.sha2(F.to_json(F.struct("label", "vector")), 256))
    given = materialize(given.withColumn("class", name), "vectors")
    classes = given.where("class is not null").groupBy("class").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    classes = materialize(classes.withColumn("n", F.xxhash64("class")), "vector_classes")
    if pivots is None:
        largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        pivots = int(min(MAX_PIVOTS, max(16, 2 * largest**0.5)))
    context = rows.sparkSession.sparkContext
    points, named = choose_pivots(classes, pivots)
    length = prefix or fit_prefix(points, named, threshold, share)
    table = context.broadcast(points)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Unit vectors with their nearest pivots."""
        p = table.value
        for batch in batches:
            sizes = batch["vector"].map(len)
            for width in sizes.unique():
                part = batch[sizes == width].reset_index(drop=True)
                x = _unit(np.stack([np.asarray(v, float) for v in part["vector"]]))
                # Vectors of another length than the pivots' have one list to themselves.
                near = _nearest(x, p, length) if len(p) and p.shape[1] == width else np.full((len(x), 1), -int(width))
                part["vector"] = pd.Series(list(x), dtype=object)
                part["prefix"] = pd.Series(list(near.astype(np.int32)), dtype=object)
                yield part[["label", "class", "copies", "vector", "prefix"]]

    described = classes.select("label", "class", "copies", "vector").mapInPandas(describe, "label string, class string, copies long, vector array<double>, prefix array<int>")
    described = materialize(described, "described_vectors")
    # One number for each pivot, fewer than MAX_PIVOTS: the order of the lists, rarest first.
    counts = described.select(F.explode("prefix").alias("pivot")).where("pivot >= 0").groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).toPandas()
    place = np.zeros(max(1, len(points)), np.int32)
    place[counts.sort_values(["n", "pivot"])["pivot"].to_numpy(int)] = np.arange(len(counts))
    order = context.broadcast(place)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each vector and list that it enters; pivots by their place in the order."""
        for batch in batches:
            sizes = batch["prefix"].map(len)
            for k in sizes.unique():
                part = batch[sizes == k].reset_index(drop=True)
                near = np.stack(list(part["prefix"]))
                near = np.sort(np.where(near >= 0, order.value[np.maximum(near, 0)], near), axis=1).astype(np.int32)
                into = k - min(share, k) + 1
                at = np.repeat(np.arange(len(part)), into)
                out = part.loc[at, ["label", "class", "copies", "vector"]].reset_index(drop=True)
                out["pivot"] = near[:, :into].reshape(-1)
                lists = list(near)
                out["prefix"] = pd.Series([lists[i] for i in at], dtype=object)
                yield out[["label", "pivot", "class", "copies", "prefix", "vector"]]

    entry = "label string, pivot int, class string, copies long, prefix array<int>, vector array<double>"
    lists = materialize(described.mapInPandas(deal, entry), "pivot_lists")
    sizes = lists.select("label", "pivot").groupBy("label", "pivot").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = materialize(sizes.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).drop("size"), "list_sizes")
    member = lists.join(sizes, ["label", "pivot"]).withColumn("own", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other", "tiles")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        """Partners and links among the classes of one tile or pair of tiles, each pair in its first shared list only."""
        pivot, p, q = int(tile["pivot"].iloc[0]), int(tile["p"].iloc[0]), int(tile["q"].iloc[0])
        x, near = np.stack(list(tile["vector"])), np.stack(list(tile["prefix"]))
        copies, own, names = tile["copies"].to_numpy(np.int64), tile["own"].to_numpy(), tile["class"].tolist()
        left, right = (np.arange(len(x)),) * 2 if p == q else (np.flatnonzero(own == p), np.flatnonzero(own == q))
        partners, a, b = np.zeros(len(x), np.int64), [], []
        for i, j in _candidates(near, left, right, p == q, pivot, share):
            keep = (x[i] * x[j]).sum(axis=1) >= threshold  # one sum of products, however many pairs there are
            i, j = i[keep], j[keep]
            np.add.at(partners, i, copies[j])
            np.add.at(partners, j, copies[i])
            a.append(i)
            b.append(j)
        pairs = list(_forest(len(x), np.concatenate(a), np.concatenate(b))) if a else []
        out = [(names[k], int(partners[k]), None) for k in np.flatnonzero(partners)] + [(names[u], 0, names[v]) for u, v in pairs]
        return pd.DataFrame(out, columns=["class", "partners", "to"])

    found = member.groupBy("label", "pivot", "p", "q").applyInPandas(compare, "class string, partners long, to string")
    found = materialize(found, "vector_links")
    degree = found.groupBy("class").agg(F.sum("partners").alias("partners"))
    groups = connected_components(found.where("to is not null").select(F.col("class").alias("a"), F.col("to").alias("b")))
    of_class = classes.select("class", "first", "copies").join(degree, "class", "left").join(groups.withColumnRenamed("id", "class"), "class", "left")
    # A component may hold a third of all rows: its least id goes to several tasks, and classes without links to none.
    least = of_class.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.when(F.col("component").isNotNull(), F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).otherwise(-1)
    of_class = of_class.withColumn("salt", salt).withColumn("component", F.coalesce("component", "class")).join(least, ["component", "salt"], "left")
    of_class = of_class.select("class", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", "first").alias("least"))
    of_class = materialize(of_class, "vector_groups")
    out = given.select("vec_id", "class").join(of_class, "class", "left")
    component = F.coalesce("least", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _candidates(near: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, pivot: int, share: int, rows: int = 256, pairs: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that share enough pivots and share none before this list's, some thousands at a time; ``near`` are sorted.

    Pivots are first counted in hashed buckets, where the product of two rows is never less than what they share.
    """
    k = near.shape[1]
    enough, width = min(share, k), 64 * k
    held = np.zeros((len(near), width), np.float32)
    np.add.at(held, (np.repeat(np.arange(len(near)), k), near.reshape(-1).astype(np.int64) * 2654435761 % width), 1)
    for at in range(0, len(left), rows):
        some = left[at : at + rows]
        i, j = np.nonzero(held[some] @ held[right].T >= enough)
        i, j = some[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        for lo in range(0, len(i), pairs):
            u, v = i[lo : lo + pairs], j[lo : lo + pairs]
            both = (near[u][:, :, None] == near[v][:, None, :]).any(axis=2)
            keep = both.sum(axis=1) >= enough
            u, v, both = u[keep], v[keep], both[keep]
            keep = np.take_along_axis(near[u], both.argmax(axis=1)[:, None], axis=1)[:, 0] == pivot
            if keep.any():
                yield u[keep], v[keep]
