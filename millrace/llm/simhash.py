"""SimHash near-duplicates through tables of distances to reference fingerprints.

A fingerprint has 64 bits. The reference fingerprints (pivots) are the zero fingerprint and, for each of ``BLOCKS``
disjoint bit blocks, fingerprints supported on that block alone. The difference of two pivot distances,
``d(x, r) - d(x, 0)``, then depends on the bits of one block only, and the table of a block (one coordinate for
each of its references) changes by at most the number of bits in which two fingerprints differ there. Two
fingerprints within ``max_bits`` of one another differ in at most ``max_bits`` blocks, so they have equal tables in
``BLOCKS - max_bits`` blocks or more: their maximum coordinate difference is zero there. The equality of those
coordinates finds candidates exactly, without comparing all pairs; the rest of the table discards candidates by
their maximum coordinate difference, and the survivors are verified by exclusive-or. No link is lost and none is
false.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, slices, small_batches
from .components import connected_components
from .shingle_links import _small, similar_links, word_key, words_of

BLOCKS = 4
#: Rows of a cell that are compared at a time; a larger cell is dealt out as pairs of such tiles.
TILE = 2048
#: Cells of up to so many rows are compared together, by shifting the rows against one another.
SMALL = 64
#: Seeds of general references that discard candidates by the largest coordinate difference.
PIVOTS = np.random.default_rng(20240601).integers(0, 2**64, 16, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, by the definition of :func:`fingerprints`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(width)))]
    ones = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """Fingerprints of many texts; hashes are unpacked in slices of bounded size."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        if not words:
            continue
        width = min(shingle, len(words))
        shingles = map(join, zip(*(words[j:] for j in range(width))))
        hashes = np.array([digest(x, 42) for x in shingles], dtype="<u8")
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for each document; ``fp`` is the fingerprint's 64 bits as a signed long.

    Words are runs of non-blank characters after lower-casing A-Z; shingles of ``shingle`` words count as often as
    they occur. A text with fewer words is one shingle; a null, empty or blank text has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = _fingerprints(batch.column(1).to_pylist(), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, fp long")


def _coordinates(fp: np.ndarray) -> np.ndarray:
    """Distances to the general references, one row for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _close(x: np.ndarray, y: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of x and y within ``max_bits``: discard by maximum coordinate difference, then verify."""
    cx, cy = _coordinates(x), _coordinates(y)
    alive = np.abs(cx[:, None, 0] - cy[None, :, 0]) <= max_bits
    i, j = np.nonzero(alive)
    for k in range(1, len(PIVOTS)):
        if len(i) < 1024:
            break
        keep = np.abs(cx[i, k] - cy[j, k]) <= max_bits
        i, j = i[keep], j[keep]
    if len(i):
        keep = np.abs(cx[i] - cy[j]).max(axis=1) <= max_bits
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(x[i] ^ y[j]) <= max_bits
    return i[keep], j[keep]


def _close_in_cells(fp: np.ndarray, end: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``max_bits`` among the rows of each cell; ``end`` is where a row's cell ends (0: leave it out)."""
    table, left, right = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :2]).astype(np.int8), [], []
    row = np.arange(len(fp))
    for shift in range(1, SMALL):
        row = row[row + shift < end[row]]
        if not len(row):
            break
        i = row[(np.abs(table[row] - table[row + shift]) <= max_bits).all(axis=1)]
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= max_bits]
        left.append(i)
        right.append(i + shift)
    return (np.concatenate(left), np.concatenate(right)) if left else (row, row)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links, so that a dense group yields no more edges than it has members."""
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            yield a, b


def block_references(block: int, blocks: int = BLOCKS) -> list[int]:
    """References supported on one bit block: its single bits."""
    width = 64 // blocks
    return [1 << (block * width + k) for k in range(width)]


def _block_keys(fp: np.ndarray, blocks: int) -> list[np.ndarray]:
    """For each block, its coordinates ``d(x, r) - d(x, 0)`` in one integer.

    For a single-bit reference the coordinate is 1 where the bit is unset and -1 where it is set; the table of a block
    is packed with one digit for each coordinate.
    """
    base = np.bitwise_count(fp).astype(np.int16)
    keys = []
    for b in range(blocks):
        key = np.zeros(len(fp), dtype=np.int64)
        for r in block_references(b, blocks):
            key = key * 2 + (np.bitwise_count(fp ^ np.uint64(r)).astype(np.int16) - base < 0)
        keys.append(key)
    return keys


def links(classes: DataFrame, max_bits: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """Edges ``(a, b)`` of a spanning forest of all links between the distinct fingerprints of ``classes(fp)``."""
    chosen = list(combinations(range(blocks), blocks - max_bits))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            keys = _block_keys(fp, blocks)
            for n, parts in enumerate(chosen):
                key = np.zeros(len(fp), dtype=np.int64)
                for p in parts:
                    key = (key << (64 // blocks)) | keys[p]
                yield pd.DataFrame({"n": np.full(len(fp), n, dtype=np.int32), "key": key, "fp": fp.view(np.int64)})

    cells = materialize(classes.select("fp").mapInPandas(deal, "n int, key long, fp long"), "cells")
    sizes = cells.groupBy("n", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    member = cells.join(sizes, ["n", "key"]).withColumn("tiles", tiles)
    # A cell of one tile is one unit of work; a larger one is a unit for each pair of its tiles.
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    member = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.select("n", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells come sorted, so each is a run of rows; the last run of a batch waits for the next batch."""
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            unit = batch[["n", "key", "p", "q"]].to_numpy(np.int64)
            start = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]).any(axis=1)]) if len(unit) else np.zeros(0, int)
            if not len(start):
                continue
            rest = batch.iloc[start[-1] :]
            yield from found(batch, unit, start)
        if rest is not None:
            unit = rest[["n", "key", "p", "q"]].to_numpy(np.int64)
            yield from found(rest, unit, np.array([0, len(rest)]))

    def found(batch: pd.DataFrame, unit: np.ndarray, start: np.ndarray) -> Iterator[pd.DataFrame]:
        fps, own = batch["fp"].to_numpy(np.int64).view(np.uint64), batch["own"].to_numpy()
        a, b = [], []
        size = np.diff(start)
        end = np.zeros(len(fps), dtype=np.int64)
        end[: start[-1]] = np.repeat(np.where(size <= SMALL, start[1:], 0), size)
        i, j = _close_in_cells(fps, end, max_bits)
        pairs = np.array(list(_forest(len(fps), i, j)), dtype=np.int64).reshape(-1, 2)
        a.append(fps[pairs[:, 0]])
        b.append(fps[pairs[:, 1]])
        for lo, hi in zip(start[:-1][size > SMALL].tolist(), start[1:][size > SMALL].tolist()):
            x, tile = fps[lo:hi], own[lo:hi]
            p, q = unit[lo, 2], unit[lo, 3]
            left, right = (np.arange(hi - lo),) * 2 if p == q else (np.flatnonzero(tile == p), np.flatnonzero(tile == q))
            i, j = [], []
            for at in range(0, len(left), 512):
                u, v = _close(x[left[at : at + 512]], x[right], max_bits)
                u, v = left[at + u], right[v]
                keep = u < v if p == q else u >= 0
                i.append(u[keep])
                j.append(v[keep])
            pairs = list(_forest(hi - lo, np.concatenate(i), np.concatenate(j))) if i else []
            if pairs:
                pairs = np.array(pairs)
                a.append(x[pairs[:, 0]])
                b.append(x[pairs[:, 1]])
        yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    units = member.repartition("n", "key", "p", "q").sortWithinPartitions("n", "key", "p", "q")
    return units.mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    Fingerprints within ``max_bits`` link; ``component_id`` is the smallest id reachable through links, itself
    included. Copies share a fingerprint and are one vertex, so a group of any size costs one row. Repeated rows keep
    their own rows; a null id takes part with its text, is named by others but names none (a component of null ids
    alone has a null name). An empty table gives an empty table; other columns of ``docs`` are ignored.
    """
    return _placed(materialize(fingerprints(docs, shingle, text), "prints"), max_bits)


def _placed(prints: DataFrame, max_bits: int) -> DataFrame:
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = links(classes, max_bits)
    groups = connected_components(edges).withColumnsRenamed({"id": "fp", "component": "root"})
    placed = classes.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = materialize(placed.join(names, "root").select("fp", "component_id"), "of_class")
    return prints.join(of_class, "fp").select(*prints.columns, "component_id")


def _described(docs: DataFrame, shingle: int, text: str) -> DataFrame:
    """``(doc_id, v, fp, words)``: the vertex of each text's sequence of lower-cased words, its fingerprint and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            words = [words_of(x) for x in texts]
            columns = [np.array([word_key(x) for x in words], np.int64), _fingerprints(texts, shingle).view(np.int64), np.array([len(x) for x in words], np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "v", "fp", "words"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, v long, fp long, words long")


def near_duplicates_by_similarity(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 2, text: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` where documents link as copies or by verified similarity.

    Documents of the same words link, and beyond them all pairs whose sets of ``shingle``-word shingles have a Jaccard
    similarity of ``similarity`` or more. The links of fingerprints of such shingles within ``max_bits`` are the first
    candidates, and :mod:`shingle_links` adds all that they miss. Every candidate is verified: a line that texts repeat
    can decide the fingerprints of unlike texts. ``component_id`` is the smallest id reachable, itself included. A null
    id takes part as a copy alone and names nothing (a component of null ids alone has a null name). Rows stay as they
    are, repeated ones too; ids may be of any type that orders.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(_described(docs, shingle, text), "described")
    # Copies are one vertex: the smallest id of each sequence of words stands for its rows.
    heads = prints.where("doc_id is not null").groupBy("v").agg(F.min("doc_id").alias("head"), F.min("fp").alias("fp"), F.min("words").alias("words"))
    heads = scratch.write(heads, "heads")
    of_print = scratch.write(heads.where("words > 0").groupBy("fp").agg(F.min("v").alias("a")), "of_print")
    equal = heads.join(of_print, "fp").where("v <> a").select("a", F.col("v").alias("b"))
    near = links(of_print.select("fp"), max_bits).withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(of_print.withColumnsRenamed({"fp": "x"}), "x").join(of_print.withColumnsRenamed({"fp": "y", "a": "b"}), "y").select("a", "b")
    first = scratch.write(equal.unionByName(near), "near_prints")
    edges, used = similar_links(docs, heads, first, shingle, similarity, text)
    ends = [heads.select(F.col("v").alias(x), F.col("head").alias(f"head_{x}")) for x in ("a", "b")]
    edges = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    merged = connected_components(edges).withColumnRenamed("id", "head")
    used.drop()
    out = prints.join(heads.select("v", "head"), "v", "left").join(merged, "head", "left")
    out = materialize(out.select("doc_id", F.coalesce("component", "head").alias("component_id")), "by_similarity")
    scratch.drop()
    return out


def deduplicate(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents of which one stays for each group of :func:`near_duplicates_by_similarity`: the one whose id
    names the component.

    All columns of ``docs`` stay. Rows that repeat the id of a document that stays are that document again, and one of
    them is kept. Of documents with a null id, one stays for each text. An empty table stays empty.
    """
    placed = near_duplicates_by_similarity(docs, text=text, **how)
    stays = F.col("doc_id") == F.col("component_id")
    n = placed.agg(
        F.count_if(stays).alias("kept"),
        F.count_distinct(F.when(stays, F.col("doc_id"))).alias("ids"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    named = placed.where("doc_id is not null").groupBy("doc_id").agg(F.max(stays).alias("stays"))
    # Texts are not shuffled unless very many go: the ids that go are fewer than those that stay.
    out = docs.where("doc_id is not null").join(_small(named.where("not stays").select("doc_id")), "doc_id", "left_anti")
    if n["kept"] > n["ids"]:
        out = out.dropDuplicates(["doc_id"])
    if n["nulls"]:
        out = out.unionByName(docs.where("doc_id is null").dropDuplicates([text]))
    return out.select(*docs.columns)
