"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Documents of a source are ranges of that key; the words before a key are a
distributed prefix sum: first over 256 ranges of the key, then over 256 ranges within the one where the budget runs
out, and last over the documents of that small range alone. The cut found so is applied to every document by its key
in the same scan, so neither texts nor whole sources are sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

FAN = 256


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _targets(totals: DataFrame, cycle: tuple[int, ...], most: float, budget: float) -> DataFrame:
    """Targets of the sources: shares by weight, none above ``most`` times its source, the excess shared anew.

    That is ``min(most * size, level * weight)`` for one level: sources are full in order of ``most * size / weight``,
    and the level is the first at which those not yet full take what the full ones leave. There is one row for each
    source here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(x)) for x in cycle))
    s = totals.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("full_at", F.col("cap") / F.col("weight"))
    in_turn = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    s = s.withColumn("_caps", F.coalesce(F.sum("cap").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("weight").over(in_turn.rowsBetween(0, Window.unboundedFollowing)))
    total = F.sum("source_size").over(all_rows) * F.lit(float(budget))
    s = s.withColumn("_level", (total - F.col("_caps")) / F.col("_rest"))
    s = s.withColumn("_turn", F.row_number().over(in_turn))
    level = F.min(F.when(F.col("_level") <= F.col("full_at"), F.struct("_turn", "_level"))).over(all_rows)["_level"]
    s = s.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return s.select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0, budget: float = 1.0, text: str = "text") -> DataFrame:
    """``docs`` with ``size, source_size, weight, target, key, copies, cut_words, taken`` added (in place of such columns).

    Sources in order of code points (null last) have the weights of ``cycle`` in turn and share ``budget`` times all
    words. A source whose target is above its size is repeated: ``copies`` counts the whole passes over a document.
    The document at the cut gives ``cut_words`` of its words, so that a source meets its target to the word; documents
    with equal keys there (repeated rows) share it evenly. ``taken`` is the sum of both. Null ids and texts are
    allowed; a null source is a source. An empty table gives an empty table.
    """
    added = ("size", "source_size", "weight", "target", "key", "copies", "cut_words", "taken")
    own = ("_s", "_epochs", "_cut_key", "_tied", "_left")
    sized = docs.drop(*added, *own).withColumn("size", word_count(text))
    # The id and the text's checksum: two documents with one id are still two documents.
    checksum = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), checksum)
    sized = sized.withColumn("key", key)
    light = materialize(sized.select("source", "size", "key"), "sizes")
    totals = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    cut = materialize(_targets(totals, cycle, most, budget), "targets")
    words = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cut = cut.withColumn("epochs", whole).withColumn("rest", words - whole * F.col("source_size"))
    for level, shift in ((1, 56), (2, 48)):
        # Ranges of the key in signed order.
        part = F.shiftright("key", shift) if level == 1 else F.shiftright("key", shift) - F.shiftleft(F.col("part1").cast("long"), 8)
        within = light.join(cut.select("source", *(["part1"] if level == 2 else [])).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        if level == 2:
            within = within.where(F.shiftright("key", 56) == F.col("part1"))
        sums = within.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
        here = sums.withColumnsRenamed({"source": "_s"}).join(cut, F.col("_s").eqNullSafe(F.col("source")))
        here = here.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        here = here.select("_s", F.col("part").alias(f"part{level}"), F.col("before").alias("_b"))
        cut = cut.join(here, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        cut = materialize(cut.withColumn("rest", F.col("rest") - F.coalesce("_b", F.lit(0))).drop("_b"), f"cut{level}")
    small = light.withColumnsRenamed({"source": "_s"}).join(cut, F.col("_s").eqNullSafe(F.col("source")))
    small = small.where((F.shiftright("key", 56) == F.col("part1")) & (F.shiftright("key", 48) - F.shiftleft(F.col("part1").cast("long"), 8) == F.col("part2")))
    small = small.groupBy("_s", "key", "rest").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("_s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    small = small.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    small = small.select("_s", F.col("key").alias("cut_key"), F.col("words").alias("tied"), (F.col("rest") - F.col("before")).alias("left"))
    plan = cut.join(small, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = plan.select(F.col("source").alias("_s"), "source_size", "weight", "target", *(F.col(x[1:]).alias(x) for x in own[1:]))
    plan = materialize(plan, "mix_plan")
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    out = out.withColumn("copies", F.col("_epochs") + F.when(F.col("key") < F.col("_cut_key"), 1).otherwise(0))
    share = F.floor(F.col("size") * F.col("_left") / F.col("_tied")).cast("long")
    out = out.withColumn("cut_words", F.when(F.col("key") == F.col("_cut_key"), share).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("cut_words")).drop(*own)


def mixed_documents(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Only whole documents are given here: the one at a source's cut is taken once more if at least half of it fits.
    """
    # The user's columns travel in one struct, so that none of them is taken for a column of the mix.
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "source", F.col(text).alias("text"))
    mixed = mix(kept, text="text", **how)
    times = F.col("copies") + F.when(F.col("cut_words") * 2 >= F.greatest("size", F.lit(1)), 1).otherwise(0)
    out = mixed.select("_row", times.alias("_times")).where("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_row.*")
