"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word for all operators here: a run of anything but the six ASCII blanks (Java syntax).
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only in local mode, where driver and executors are one
    process, a folder of our own is used and set if that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file:///tmp/checkpoints/millrace-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone; the folder is scratch space
            continue


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts lineage (a lost executor costs no recomputation), lets later plans see the true size of the table, and
    keeps a costly step from running once per use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, each deleted as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`materialize`, under a name for :meth:`drop`; a table of that name before it is deleted afterwards."""
        out = materialize(df, name)
        before = self.paths.get(name)
        self.paths[name] = _written[-1]
        if before:
            self._delete(before)
        return out

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, by default all."""
        for name in names or list(self.paths):
            if name in self.paths:
                self._delete(self.paths.pop(name))

    def _delete(self, entry: tuple[SparkSession, str]) -> None:
        delete_path(*entry)
        _written.remove(entry)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the rows of an Arrow batch to ``rows`` for this session unless they are fewer.

    Whole texts cross to Python and back in these batches, and some texts are very long: the default of 10,000 rows
    takes hundreds of MB beside the heap of an executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows, so that what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordCache(dict):
    """Word to value. Of a full cache the newer half stays, as an older generation from which words in use come back."""

    ROWS, LONGEST = 80_000, 64

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.ROWS:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


_caches: dict[str, WordCache] = {}


def worker_cache(name: str, make: Callable) -> WordCache:
    """A cache that this Python worker keeps from task to task; one of another name takes its place."""
    if name not in _caches:
        _caches.clear()
        _caches[name] = WordCache(make)
    return _caches[name]


def is_held_out(doc_id: str = "doc_id"):
    """Rows from which labels are never learnt: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """Texts of at most about ``max_rows`` labelled rows outside the held-out fold, chosen by a hash of their id.

    The label table is reduced to one row for each id (the largest label). ``max_rows`` bounds what is broadcast to
    find the texts; the bound is met in expectation, because ids are chosen by a hash threshold.
    """
    grades = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .where(~is_held_out())
        .groupBy("doc_id")
        .agg(F.max(column).alias("grade"))
    )
    n = grades.count()
    if n > max_rows:
        grades = grades.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(grades), "doc_id").select("doc_id", "grade", "text")
