"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Only the histogram of piece lengths (at most ``capacity`` numbers) decides the packing, so the plan is made on the
driver in bounded memory whatever the number of documents: a greedy best-fit bin whose smallest document is replaced
by two unpacked ones that fit its expanded gap more tightly. A bin's pattern is repeated until one of its lengths runs
out, so there are about as many patterns as lengths. The cluster then numbers the pieces of each length and deals
them to the slots of the plan; no task holds all pieces of a length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

#: Runs of letters or signs kept in each of two generations of a worker's cache of token ids; longer ones aren't cached.
CACHE, LONGEST = 160_000, 64
#: Pieces of one length that one task numbers, about.
RANK_ROWS = 20_000


#: Python's split also breaks at four control characters that are no white space to the tokenizer.
_CONTROLS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split_words(text: str) -> list[str]:
    return [x for x in _BLANKS.split(text) if x] if _CONTROLS.search(text) else text.split()


#: Texts whose runs can be looked up one by one: ASCII and the letters of Latin-1. These have no other normal form and
#: lower case is one to one. ``_RUNS`` cuts such a lower-cased text as the tokenizer does.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\\s]+").findall


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in prints]
    return {x: chr(x) for x in prints} | {x: chr(256 + k) for k, x in enumerate(rest)}


_LETTER = _byte_letters()
_MAPPED = {x: "".join(_LETTER[b] for b in chr(x).encode()) for x in range(0xC0, 0x100)}


class Runs(dict):
    """Token ids (little-endian 32-bit bytes) of runs of letters, digits or signs, as the vocabulary merges them.

    Of a full cache the newer half stays: it becomes the older generation, from which runs in use come back.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.older = self.tokenizer.model, {}

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            mapped = run if run.isascii() else run.translate(_MAPPED)
            tokens = self.model.tokenize(mapped)
            ids = struct.pack(f"<{len(tokens)}I", *(x.id for x in tokens))
        if len(run) <= LONGEST:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text.

        The tokenizer drops white space and neither its normalizer nor its splitting looks across it, so a text's ids
        are those of its words in turn. Words with other signs go to the whole tokenizer. A test compares this with
        whole texts.
        """
        if _PLAIN(text):
            return b"".join(map(self.__getitem__, _RUNS(text.lower())))
        out = []
        for word in split_words(text):
            if _PLAIN(word):
                out += map(self.__getitem__, _RUNS(word.lower()))
            else:
                out.append(np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes())
        return b"".join(out)


_worker: dict[str, Runs] = {}


def _runs_of(path: str) -> Runs:
    """The cache of this Python worker, kept from task to task."""
    if path not in _worker:
        _worker.clear()
        _worker[path] = Runs(path)
    return _worker[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, text: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for each piece of each document.

    A document is its token ids and then one id 0. It is cut into pieces of ``capacity`` ids, the last of which may be
    shorter, only if it is longer than that. A null or empty text is the id 0 alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, end, step = _runs_of(tokenizer), bytes(4), 4 * capacity
        for batch in slices(batches):
            owner, rows = [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                ids = runs.encode(body) + end if body else end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    owner.append(row)
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            numbers = np.array(rows, dtype=np.int64).reshape(-1, 4).T
            # Ids stay Arrow columns: a null beside them changes none.
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(numbers[0].astype(np.int32)), *map(pa.array, numbers[1:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Bins as ``(repeats, lengths)`` that use every piece of ``histogram`` (length: count) exactly once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] += n
    bins: list[tuple[int, list[int]]] = []

    def largest(most: int) -> int:
        at = np.flatnonzero(left[1 : most + 1])
        return int(at[-1]) + 1 if len(at) else 0

    def best_pair(most: int, least: int) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is largest within (least, most]."""
        sizes = np.flatnonzero(left[: most + 1])
        if len(sizes) == 0:
            return None
        at = np.searchsorted(sizes, most - sizes, side="right") - 1
        ok = at >= 0
        a, b = sizes[ok], sizes[at[ok]]
        single = (a == b) & (left[a] < 2)
        lower = np.where(at[ok] > 0, sizes[np.maximum(at[ok] - 1, 0)], 0)
        b = np.where(single, lower, b)
        total = np.where(b > 0, a + b, 0)
        k = int(np.argmax(total)) if len(total) else 0
        return (int(a[k]), int(b[k])) if len(total) and total[k] > least else None

    while left.any():
        content: list[int] = []
        gap = capacity
        while gap and (size := largest(gap)):
            left[size] -= 1
            content.append(size)
            gap -= size
        while gap and content:
            smallest = content[-1]
            pair = best_pair(gap + smallest, smallest)
            if pair is None:
                break
            left[smallest] += 1
            content.pop()
            for size in pair:
                left[size] -= 1
            content = sorted([*content, *pair], reverse=True)
            gap += smallest - sum(pair)
        sizes, need = np.unique(content, return_counts=True)
        more = int((left[sizes] // need).min())
        left[sizes] -= more * need
        bins.append((1 + more, content))
    return bins


def _slots(bins: list[tuple[int, list[int]]]) -> list[dict]:
    """For each run of equal slots, which ranks among the pieces of its length it takes."""
    used: dict[int, int] = {}
    first, out = 0, []
    for repeats, content in bins:
        offset = 0
        sizes, counts = np.unique(content, return_counts=True)
        for size, n in zip(sizes.tolist()[::-1], counts.tolist()[::-1]):
            lo = used.get(size, 0)
            used[size] = lo + n * repeats
            out.append({"length": size, "lo": lo, "hi": lo + n * repeats, "n": n, "first": first, "at": offset})
            offset += size * n
        first += repeats
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, text: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece of each document.

    Pieces of one length are interchangeable: they are numbered by a hash of their content and then by it, so reruns
    agree up to rows that are equal in every column. An empty table has no sequences. Columns of ``docs`` other than
    ``doc_id`` and ``text`` are ignored; null ids are kept.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, text), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(best_two_fit(histogram, capacity))
    parts = max(1, -(-max(histogram.values(), default=1) // RANK_ROWS))
    # Rank within a length: numbered within parts of its hash range, after the sizes of the parts before.
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    keyed = cut.withColumn("_h", order).withColumn("_part", F.pmod(F.col("_h"), F.lit(parts)).cast("int"))
    before = keyed.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(before.select("length", "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")), "before")
    inside = Window.partitionBy("length", "_part").orderBy("_h", "doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("_row", F.row_number().over(inside) - 1).join(before, ["length", "_part"])
    ranked = ranked.withColumn("rank", F.col("_row") + F.col("_before"))
    # The slots of a length, in order of rank. There are at most capacity lengths and about as many patterns.
    kind = "array<struct<length:bigint,lo:bigint,hi:bigint,n:bigint,first:bigint,at:bigint>>"
    text_plan = json.dumps(slots)
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(text_plan), kind)))
    plan = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "n", "first", "at"))).alias("runs"))
    plan = materialize(plan, "plan")
    slot = F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]
    placed = ranked.join(F.broadcast(plan), "length").withColumn("_slot", slot)
    k = F.col("rank") - F.col("_slot.lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_slot.first") + F.floor(k / F.col("_slot.n"))).alias("sequence_id"),
        (F.col("_slot.at") + k % F.col("_slot.n") * F.col("length")).alias("offset"),
    )
