"""Snapshots, changes and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: str = "path", hash: str = "hash") -> DataFrame:
    """``(key, change)`` with added, deleted or modified; equal rows are left out."""
    p, c = prev.select(F.col(key), F.col(hash).alias("_p"), F.lit(1).alias("_inp")), cur.select(F.col(key), F.col(hash).alias("_c"), F.lit(1).alias("_inc"))
    both = p.join(c, key, "full_outer")
    change = F.when(F.col("_inp").isNull(), "added").when(F.col("_inc").isNull(), "deleted").when(~F.col("_p").eqNullSafe(F.col("_c")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def to_index(changes: DataFrame, key: str = "path") -> DataFrame:
    return changes.where("change <> 'deleted'").select(key).distinct()


def parse_name_status(df: DataFrame, stream: str = "stream") -> DataFrame:
    """``(path, change)`` from a NUL-separated name-status stream; renames and copies delete the old path (renames
    only) and add the new one."""
    parts = F.filter(F.split(stream, "\x00"), lambda x: x != "")
    status = r"^[AMDT]$|^[RC]\d*$"

    def step(acc: Column, tok: Column) -> Column:
        out, wait, old = acc["out"], acc["wait"], acc["old"]
        add = lambda path, change: F.struct(path.alias("path"), F.lit(change).alias("change"))
        none = F.lit(None).cast("string")
        letter = F.substring(wait, 1, 1)
        return (
            F.when(wait.isNull() & tok.rlike(status), F.struct(out.alias("out"), tok.alias("wait"), none.alias("old")))
            .when(letter.isin("R", "C") & old.isNull(), F.struct(out.alias("out"), wait.alias("wait"), tok.alias("old")))
            .when(letter == "R", F.struct(F.concat(out, F.array(add(old, "deleted"), add(tok, "added"))).alias("out"), none.alias("wait"), none.alias("old")))
            .when(letter == "C", F.struct(F.concat(out, F.array(add(tok, "added"))).alias("out"), none.alias("wait"), none.alias("old")))
            .when(letter == "A", F.struct(F.concat(out, F.array(add(tok, "added"))).alias("out"), none.alias("wait"), none.alias("old")))
            .when(letter == "D", F.struct(F.concat(out, F.array(add(tok, "deleted"))).alias("out"), none.alias("wait"), none.alias("old")))
            .otherwise(F.struct(F.concat(out, F.array(add(tok, "modified"))).alias("out"), none.alias("wait"), none.alias("old")))
        )

    kind = "struct<out:array<struct<path:string,change:string>>,wait:string,old:string>"
    start = F.from_json(F.lit('{"out":[]}'), kind)
    return df.select(F.inline(F.aggregate(parts, start, step, lambda a: a["out"])))


def upsert(old: DataFrame, new: DataFrame, key: list[str], create_only: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key, others stay; ``create_only`` columns keep old values."""
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    if create_only:
        before = old.select(*key, *(F.col(c).alias(f"_{c}") for c in create_only))
        new = new.join(before, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in create_only else F.col(c) for c in new.columns))
    return kept.unionByName(new.select(*old.columns))


def partial_update(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Only ``columns`` change, where ``new`` has a value; keys that ``old`` lacks are not created."""
    change = new.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(change, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def prune(old: DataFrame, current: DataFrame, key: list[str], touched: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Rows of ``old`` whose key is among the current ones; with ``touched`` only rows of touched parents can go."""
    if touched is None:
        return old.join(current.select(*key).distinct(), key, "left_semi")
    flagged = old.join(touched.select(*on).distinct().withColumn("_t", F.lit(True)), on, "left")
    flagged = flagged.join(current.select(*key).distinct().withColumn("_c", F.lit(True)), key, "left")
    return flagged.where("_t is null or _c").select(*old.columns)


def replace_partition(old: DataFrame, new: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The table with the groups of ``new`` replaced, and counts of what went."""
    gone = old.join(new.select(by).distinct(), by, "left_semi")
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new), gone.groupBy(by).agg(F.count(F.lit(1)).alias("pruned"))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], removed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows whose parent column is among the removed keys."""
    gone = removed.select(F.col(key).alias("_gone")).distinct()
    return {n: t.join(gone, t[c] == F.col("_gone"), "left_anti") for n, (t, c) in tables.items()}


def last_write(events: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key, by one aggregate of a struct and no window."""
    rest = [c for c in events.columns if c not in key]
    best = events.groupBy(*key).agg(F.max(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_b"))
    return best.select(*key, *(F.col(f"_b._row.{c}").alias(c) for c in rest))


def change_mode(git_changed: Column, has_snapshot: Column) -> Column:
    """git where the head moved, else a snapshot comparison, else a cold start."""
    return F.when(git_changed, "git").when(has_snapshot, "merkle").otherwise("cold")


def streaks(df: DataFrame, by: list[str], order: list[Column], failed: Column) -> DataFrame:
    """``streak``: how many rows in a row have failed up to this one, zero after a success."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_f", failed).withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    inner = Window.partitionBy(*by, "_g").orderBy(*order)
    return d.withColumn("streak", F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(inner)).drop("_f", "_g")


def backoff_seconds(streak: Column, first: int = 15, most: int = 300) -> Column:
    return F.when(streak <= 0, F.lit(0.0)).otherwise(F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), streak - 1)))


def breaker_trips(df: DataFrame, by: list[str], order: list[Column], failed: Column, limit: int) -> DataFrame:
    """``errors`` in the last max(8, 2 limit) rows and ``tripped`` at ``limit`` or more."""
    width = max(8, 2 * limit)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - width, 0)
    d = df.withColumn("errors", F.sum(F.when(failed, 1).otherwise(0)).over(w))
    return d.withColumn("tripped", F.col("errors") >= limit)


def due(df: DataFrame, now: Column, last_run: str = "last_run", interval: str = "interval_s") -> DataFrame:
    return df.where(now >= F.col(last_run) + F.col(interval))


def tick_timeout(n_files: Column, floor: int = 1800, most: int = 14400, per_file: float = 2.0) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(floor), (n_files * per_file).cast("int")))
