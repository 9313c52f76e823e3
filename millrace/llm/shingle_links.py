"""All pairs of texts whose sets of word shingles have a Jaccard similarity, found through their rarest shingles.

All texts order their shingles alike, rare ones first. Two similar texts share one of the first few of both (the
prefix), so the texts that have a shingle in their prefix are a list, and similar texts meet in a list. Of a list, each
text is first compared with leaders of its lists, at a cost linear in the texts; what these links join is not compared
again. The texts of a list that lie in different components are held against one another by counts of their shingles in
a few buckets, which bound from above what they share, and compared exactly if these leave room. No pair is lost, in
whatever order the shingles stand: the order decides the cost alone.

A vertex is a distinct sequence of lower-cased words, named by a 64-bit hash, so copies are one vertex.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .components import connected_components

#: The least number of texts of a common shingle, and how many common ones are kept.
COMMON, MOST_COMMON = 3, 1 << 17
#: Buckets for each text, and the most, in which all shingles are counted first; buckets that are passed on together.
BUCKETS_A_TEXT, MOST_BUCKETS, CHUNK = 4, 1 << 22, 4096
#: The fullest buckets, as a share, whose shingles are counted one by one.
FULL = 1 / 32
#: Texts of one list that one task gathers: longer lists are dealt out by a hash of the text.
LIST_ROWS = 4096
#: Buckets of shingles whose counts bound how many shingles two texts can share.
BUCKETS = 256
#: Texts on either side that are tested against one another at a time.
TILE = 512
#: Shingles and texts that one unit of verification holds, about.
UNIT_SHINGLES, UNIT_TEXTS = 400_000, 1024
#: Rows of ids that are broadcast to fetch or drop texts; with more, texts are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_key(words: list[bytes]) -> int:
    """The vertex of a text, as a signed 64-bit number."""
    key = xxhash.xxh3_64_intdigest(b" ".join(words))
    return key - (1 << 64) if key >> 63 else key


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; fewer words are one shingle, none give none."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    width = min(shingle, len(words)) or 1
    return np.unique(np.array([digest(x, 7) for x in map(join, zip(*(words[j:] for j in range(width))))], dtype=np.uint64)).view(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[np.ndarray]:
    """The sets of shingles of the texts in the first column, some texts at a time, copies within a task once."""
    seen: set[int] = set()
    for batch in slices(batches, 256):
        sets = []
        for body in batch.column(0).to_pylist():
            words = words_of(body)
            v = word_key(words)
            if words and v not in seen:
                seen.add(v)
                sets.append(shingle_set(words, shingle))
        if sets:
            yield np.concatenate(sets)


def _bucket_counts(docs: DataFrame, shingle: int, text: str) -> np.ndarray:
    """How many shingles of all texts lie in each of some buckets, a power of two that grows with the texts."""
    buckets = max(CHUNK, min(MOST_BUCKETS, 1 << (BUCKETS_A_TEXT * docs.count()).bit_length()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(buckets, dtype=np.uint32)
        for hashes in _hashes(batches, shingle):
            np.add.at(table, hashes & (buckets - 1), 1)
        for at, part in enumerate(table.reshape(-1, CHUNK)):
            if (most := part.max()) > 0:
                part = part.astype(np.uint8) if most < 256 else part
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["at", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(at, np.zeros(CHUNK, dtype=np.int64))
                sums[at] += np.frombuffer(counts, dtype=np.uint8 if len(counts) == CHUNK else np.uint32)
        for at, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["at", "counts"])

    kind = "at int, counts binary"
    found = docs.select(text).mapInArrow(counted, kind).repartition("at").mapInArrow(summed, kind).toArrow()
    table = np.zeros((buckets // CHUNK, CHUNK), dtype=np.int64)
    for at, counts in zip(found["at"].to_pylist(), found["counts"].to_pylist()):
        table[at] = np.frombuffer(counts, dtype=np.int64)
    return table.reshape(-1)


def _common_shingles(docs: DataFrame, shingle: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles in order, and how many of all texts have each (copies in several tasks once in each).

    All shingles are counted in buckets first. A shingle of many texts makes its bucket a full one, so the shingles of
    the full buckets are then counted one by one: no shingle left out has as many texts as the least full bucket has
    shingles, or more than any that is kept.
    """
    table = _bucket_counts(docs, shingle, text)
    least = max(COMMON, int(np.quantile(table, 1 - FULL, method="higher")) + 1)
    full = docs.sparkSession.sparkContext.broadcast(table >= least)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes in _hashes(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[full.value[hashes & (len(full.value) - 1)]])], ["h"])

    counts = docs.select(text).mapInArrow(exploded, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow().sort_by("h")
    return top["h"].to_numpy(), top["n"].to_numpy()


def _prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float, text: str) -> DataFrame:
    """``(h, salt, v, size, at)``: the rarest shingles of each text, as many as two similar texts must share one of.

    Of two sets with a Jaccard similarity ``t``, each of the size ``n`` shares ``ceil(t n)`` or more, so one shared is
    among its first ``n - ceil(t n) + 1``, and the first one shared is in that prefix of both. ``salt`` deals out lists
    that the counts show to be long (else it is -1). Copies within a task give their rows once.
    """
    table = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = table.value
        salts = -(-counts // LIST_ROWS)
        seen: set[int] = set()
        for batch in slices(batches, 512):
            out, keys = [], []
            for body in batch.column(0).to_pylist():
                words = words_of(body)
                v = word_key(words)
                if not words or v in seen:
                    continue
                seen.add(v)
                hashes = shingle_set(words, shingle)
                n = len(hashes)
                often, salt = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
                if len(common):
                    place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                    known = common[place] == hashes
                    often[known] = counts[place[known]]
                    many = np.where(known, salts[place], 0)
                    salt = np.where(many > 1, v % np.maximum(many, 1), -1)
                first = np.lexsort((hashes, often))[: n - math.ceil(similarity * n - 1e-9) + 1]
                out.append(np.stack([hashes[first], salt[first], np.full(len(first), v), np.full(len(first), n), np.arange(len(first))]))
            if out:
                h, salt, v, size, at = np.concatenate(out, axis=1)
                columns = [h, salt.astype(np.int32), v, size.astype(np.int32), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["h", "salt", "v", "size", "at"])

    return docs.select(text).mapInArrow(run, "h long, salt int, v long, size int, at int")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Sorted batches as whole runs of equal keys: columns, and where runs start with the end of the last one."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        if rest is not None:
            now = {k: np.concatenate([rest[k], now[k]]) for k in now}
        change = np.zeros(len(now[keys[0]]), dtype=bool)
        change[0] = True
        for k in keys:
            change[1:] |= now[k][1:] != now[k][:-1]
        start = np.flatnonzero(change)
        if len(start) > 1:
            yield {k: x[: start[-1]] for k, x in now.items()}, start
        rest = {k: x[start[-1] :] for k, x in now.items()}
    if rest is not None:
        yield rest, np.array([0, len(rest[keys[0]])])


def _lists(prefixes: DataFrame) -> DataFrame:
    """``(h, v, size, at)`` of the shingles that more than one text has in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, start in _runs(batches, ["h", "salt"]):
            new = np.ones(len(now["v"]), dtype=bool)  # copies of other tasks stand side by side
            new[1:] = (now["v"][1:] != now["v"][:-1]) | (now["h"][1:] != now["h"][:-1])
            texts = np.add.reduceat(new, start[:-1])
            keep = new & ((np.repeat(texts, np.diff(start)) > 1) | (now["salt"] >= 0))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(now[k][keep]) for k in ("h", "v", "size", "at")], ["h", "v", "size", "at"])

    dealt = prefixes.repartition("h", "salt").sortWithinPartitions("h", "salt", "v")
    return dealt.mapInArrow(run, "h long, v long, size int, at int")


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """Of the lists with the same texts, the one whose shingle is the first in all of them: it leaves the most room."""
    sets = lists.groupBy("h").agg(*(F.bit_xor(F.xxhash64(F.lit(k), "v")).alias(f"x{k}") for k in (1, 2)), F.count(F.lit(1)).alias("k"), F.sum("at").alias("at"))
    kept = sets.groupBy("k", "x1", "x2").agg(F.min(F.struct("at", "h")).alias("first")).select("first.h")
    return lists.join(kept, "h", "left_semi")


def _allowed(size_a, at_a, size_b, at_b, least, similarity: float):
    """Whether sizes and places leave room for the similarity: the first shingle that two texts share is shared with
    all that may follow it, and no more. For columns and arrays alike."""
    return least(size_a - at_a, size_b - at_b) * (1 + similarity) >= similarity * (size_a + size_b) - 1e-6


def _star_pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: each text ``b`` with one leader ``a`` of its lists, by each of two orders of leaders."""
    out = None
    for seed in ("first", "second"):
        order = F.xxhash64(F.lit(seed), "v").alias("r")
        leaders = lists.groupBy("h").agg(F.min(F.struct(order, "v", "size", "at")).alias("l"))
        joined = lists.join(leaders, "h").where("v <> l.v")
        joined = joined.where(_allowed(F.col("size"), F.col("at"), F.col("l.size"), F.col("l.at"), F.least, similarity))
        pairs = joined.groupBy("v").agg(F.min(F.struct("l.r", F.col("l.v").alias("a"))).alias("l")).select("l.a", F.col("v").alias("b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _texts_of(docs: DataFrame, heads: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """``members`` (with a vertex ``v``) and the text of each; rows of the same id with other texts come along."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = members.join(heads.select("v", "head"), "v").select(F.col("head").cast(kind).alias("doc_id"), *members.columns)
    return docs.select("doc_id", text).join(_small(named), "doc_id").select(*members.columns, text)


def _sketches(docs: DataFrame, heads: DataFrame, vertices: DataFrame, shingle: int, text: str) -> DataFrame:
    """``(v, sketch)``: how many distinct shingles of a text lie in each of ``BUCKETS`` buckets, a byte for each.

    A text with 255 or more in one has 255 in all of them, which stands for any number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            for v, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                if word_key(words) == v:
                    counts = np.bincount(shingle_set(words, shingle) & (BUCKETS - 1), minlength=BUCKETS)
                    rows.append((v, np.full(BUCKETS, 255, np.uint8).tobytes() if counts.max() >= 255 else counts.astype(np.uint8).tobytes()))
            v, sketch = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(sketch, pa.binary())], ["v", "sketch"])

    found = _texts_of(docs, heads, vertices.select("v"), text).mapInArrow(run, "v long, sketch binary")
    return found.groupBy("v").agg(F.first("sketch").alias("sketch"))


def _room(size_a: np.ndarray, size_b: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sketches ``a`` and ``b`` leave room for the similarity: texts share at most the lesser count of each bucket."""
    most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return ((a[:, 0] == 255) & (b[:, 0] == 255)) | (most * (1 + similarity) >= similarity * (size_a + size_b) - 1e-6)


def _verified(docs: DataFrame, heads: DataFrame, pairs: DataFrame, shingle: int, similarity: float, text: str) -> DataFrame:
    """Those of the pairs ``(a, b, unit)`` whose sets of shingles have the similarity, as ``(a, b)``.

    A unit gets each of its texts once, however many pairs it is in.
    """
    members = pairs.select("unit", F.col("a").alias("v")).unionByName(pairs.select("unit", F.col("b").alias("v"))).distinct()
    texts = _texts_of(docs, heads, members, text)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            words = [words_of(x) for x in batch.column(2).to_pylist()]
            # An id may be on rows of other texts too.
            keep = [k for k, (w, v) in enumerate(zip(words, batch.column(1).to_pylist())) if word_key(w) == v]
            sets = [shingle_set(words[k], shingle) for k in keep]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), hashes], ["unit", "v", "hashes"])

    def compare(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        sets = sets.combine_chunks()
        column = sets["hashes"].chunk(0) if sets.num_rows else None
        place, flat, offset = {}, None, None
        if column is not None:
            flat, offset = column.values.to_numpy(), column.offsets.to_numpy()
            place = dict(zip(sets["v"].to_pylist(), range(sets.num_rows)))
        keep = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            x, y = (flat[offset[k] : offset[k + 1]] for k in (place[a], place[b]))
            n, m = len(x), len(y)
            shared = len(np.intersect1d(x, y, assume_unique=True)) if min(n, m) >= similarity * max(n, m) else 0
            keep.append(n + m > 0 and shared >= similarity * (n + m - shared))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = texts.mapInArrow(hashed, "unit long, v long, hashes array<long>")
    return sets.groupBy("unit").cogroup(pairs.groupBy("unit")).applyInArrow(compare, "a long, b long")


def _small(rows: DataFrame) -> DataFrame:
    """Rows to broadcast where a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _parts(shingles: Column, texts: Column) -> Column:
    """In how many parts texts are dealt, so that a part stays within the bounds of a unit."""
    return F.ceil(F.greatest(shingles / UNIT_SHINGLES, texts / UNIT_TEXTS))


def _hub_units(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pairs`` with the unit in which they are verified: a leader with some of its texts."""
    sized = pairs.join(sizes.select(F.col("v").alias("b"), "words"), "b")
    parts = sized.groupBy("a").agg(_parts(F.sum("words"), F.count(F.lit(1))).alias("parts"))
    chunk = F.pmod(F.xxhash64("b"), F.greatest("parts", F.lit(1)))
    return sized.join(parts, "a").select("a", "b", F.xxhash64("a", chunk).alias("unit"))


def _rest_pairs(docs: DataFrame, heads: DataFrame, lists: DataFrame, labels: DataFrame, shingle: int, similarity: float, text: str, scratch: Scratch) -> DataFrame:
    """``(a, b, unit)``: the pairs of a list whose texts lie in different components ``labels(v, c)`` and whose sizes,
    places and sketches leave room for the similarity.

    The texts of a list outside its largest component are held against all its texts, in tiles of both.
    """
    placed = lists.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    parts = placed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    parts = parts.groupBy("h").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.sum("n").alias("k"), F.max("n").alias("most"), F.sum("s").alias("s"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    mixed = parts.where("k > most").select("h", "main", tiles(F.col("k") - F.col("most")).alias("ta"), tiles(F.col("k")).alias("tb"), _parts(F.col("s"), F.col("k")).alias("parts"))
    each = scratch.write(placed.join(mixed, "h"), "mixed_lists")
    sketches = scratch.write(_sketches(docs, heads, each.select("v").distinct(), shingle, text), "sketches")
    each = each.join(sketches, "v").withColumn("hash", F.xxhash64(F.lit("tile"), "v"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["h", "p", "q", "rest", "v", "c", "size", "at", "parts", "sketch"]
    rest = each.where("c <> main").withColumn("p", F.pmod("hash", "ta").cast("int")).withColumn("q", every("tb")).withColumn("rest", F.lit(True))
    whole = each.withColumn("q", F.pmod("hash", "tb").cast("int")).withColumn("p", every("ta")).withColumn("rest", F.lit(False))
    members = rest.select(columns).unionByName(whole.select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, start in _runs(batches, ["h", "p", "q"]):
            v, c, size, at = now["v"], now["c"], now["size"].astype(np.int64), now["at"].astype(np.int64)
            a, b, h, parts = [], [], [], []
            for lo, hi in zip(start[:-1].tolist(), start[1:].tolist()):
                rest = lo + np.flatnonzero(now["rest"][lo:hi])
                whole = lo + np.flatnonzero(~now["rest"][lo:hi])
                x, y = rest[:, None], whole[None, :]
                i, j = np.nonzero((c[x] != c[y]) & _allowed(size[x], at[x], size[y], at[y], np.minimum, similarity))
                i, j = rest[i], whole[j]
                if len(i):
                    counts = np.frombuffer(b"".join(now["sketch"][lo:hi]), dtype=np.uint8).reshape(-1, BUCKETS)
                    room = [_room(size[m], size[n], counts[m - lo], counts[n - lo], similarity) for m, n in ((i[z : z + 8192], j[z : z + 8192]) for z in range(0, len(i), 8192))]
                    i, j = i[keep := np.concatenate(room)], j[keep]
                i, j = v[i], v[j]
                a.append(np.minimum(i, j))
                b.append(np.maximum(i, j))
                h.append(np.full(len(i), now["h"][lo]))
                parts.append(np.full(len(i), now["parts"][lo]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (a, b, h, parts)], ["a", "b", "h", "parts"])

    found = members.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")
    found = found.mapInArrow(run, "a long, b long, h long, parts long").groupBy("a", "b").agg(F.min(F.struct("h", "parts")).alias("of"))
    part = lambda x: F.pmod(F.xxhash64(x), F.col("of.parts"))
    return scratch.write(found.select("a", "b", F.xxhash64("of.h", part("a"), part("b")).alias("unit")), "rest_pairs")


def similar_links(docs: DataFrame, heads: DataFrame, first: DataFrame | None = None, shingle: int = 5, similarity: float = 0.8, text: str = "text") -> tuple[DataFrame, Scratch]:
    """Edges ``(a, b)`` between vertices whose components are those of all pairs of texts whose sets of shingles have
    at least that Jaccard similarity, and the scratch tables to drop once they are read.

    ``heads(v, head, words)`` names for each vertex a row's id and its number of words; ``first(a, b)`` are pairs to
    verify besides the leaders'. Texts without words, and those of null ids, are in no pair. An empty table has none.
    """
    scratch = Scratch(docs.sparkSession)
    given = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text)
    lists = scratch.write(_lists(_prefixes(given, _common_shingles(given, shingle, text), shingle, similarity, text)), "lists")
    lists = scratch.write(_distinct_lists(lists), "lists")
    pairs = _star_pairs(lists, similarity)
    if first is not None:
        pairs = pairs.unionByName(first)
    pairs = pairs.where("a <> b").distinct()
    pairs = scratch.write(_hub_units(pairs, heads), "star_pairs")
    links = scratch.write(_verified(given, heads, pairs, shingle, similarity, text), "star_links")
    labels = connected_components(links).select(F.col("id").alias("v"), F.col("component").alias("c"))
    rest = _rest_pairs(given, heads, lists, labels, shingle, similarity, text, scratch)
    more = scratch.write(_verified(given, heads, rest, shingle, similarity, text), "rest_links")
    scratch.drop("lists", "star_pairs", "mixed_lists", "sketches", "rest_pairs")
    return links.unionByName(more), scratch
