"""WARC archives: a deterministic writer of range-sorted shards that roll by compressed size, and a reader.

Records are dealt to shards by ranges of their key; the boundaries come from a hash-chosen sample of keys, so the same
rows give the same shards. A shard is sorted and written as gzip members, and a new file begins when the current one
would grow beyond the roll size. Headers and digests are made anew for each record. A file is written under a
temporary name of its attempt and then renamed; as content and names depend on the rows alone, a repeated task
replaces a file by an equal one. The manifest is a table that Spark commits, and an archive is complete when its
marker names that manifest: readers read what the manifest lists and nothing else.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

MANIFEST = "shard int, file string, records long, bytes long, sha256 string, first_key string, last_key string"
ROLL, SHARD_ROWS, BOUNDARY_SAMPLE = 16 << 20, 4_000, 20_000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6a1f0d0e-6f1c-5c0e-9d57-0c7d0ffb8f11")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{key}/{digest}')}>"


def _line(value: str | None) -> str:
    """A header's value: white space and controls are percent-encoded, so that a value stays on its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value or "")


def record(key: str, url: str | None, payload: bytes, refers_to: str | None, refers_url: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's headers alone."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(key, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Profile: {REVISIT}",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"WARC-Refers-To-Target-URI: {_line(refers_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"Millrace-Refers-To-Key: {refers_to}",
        ]
    head += [f"Millrace-Key: {key}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member whose bytes depend on the data alone."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, compresslevel=6, mtime=0) as z:
        z.write(data)
    return out.getvalue()


def _store(path: str):
    """The file system of a folder and the folder's place there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Roll:
    """The file that is being written for a shard."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = _store(folder)
        self.shard, self.roll, self.n, self.done, self.out = shard, roll, 0, [], None

    def add(self, key: str, data: bytes) -> None:
        if self.out is not None and self.size and self.size + len(data) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.temp = f"{self.root}/.tmp-{self.name}-{uuid.uuid4().hex}"
            self.out, self.size, self.rows, self.first, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, key, hashlib.sha256()
            info = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(self.name, 'info')}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 28\r\n\r\nformat: WARC File Format 1.1\r\n\r\n".encode())
            self._write(info)
            self.size = 0
        self._write(data)
        self.rows, self.last = self.rows + 1, key

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        size = self.out.tell()
        self.out.close()
        self.fs.move(self.temp, f"{self.root}/{self.name}")
        self.done.append((self.shard, self.name, self.rows, size, self.sha.hexdigest(), self.first, self.last))
        self.out, self.n = None, self.n + 1


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll: int = ROLL, shard_rows: int = SHARD_ROWS) -> str:
    """Write ``pages(page_id, url, html)`` to ``folder`` and return the path of the manifest.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of ``min_revisit_bytes`` bytes or
    more the one with the smallest id is a response and the others revisit it; rows that repeat that id are the same
    record and responses too. Null ids sort first and, having no id to be referred to, revisit where their payload has
    an id, else they are responses. Other columns are ignored; no rows give an archive without files.
    """
    spark = pages.sparkSession
    key = F.col("page_id").cast("long")
    rows = pages.select(key.alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256))
    light = materialize(rows.select("page_id", "url", "sha", F.octet_length("html").alias("n")), "warc_keys")
    # The smallest id of each payload with its url: combined before the shuffle, however many copies there are.
    first = light.where(F.col("n") >= min_revisit_bytes).where("page_id is not null").groupBy("sha")
    first = first.agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n_rows"))
    nulls = light.where("page_id is null").select("sha").distinct().withColumn("has_null", F.lit(True))
    first = first.join(nulls, "sha", "left").where("n_rows > 1 or has_null").select("sha", "first")
    first = materialize(first, "warc_first")
    n = light.count()
    shards = max(1, -(-n // shard_rows))
    # Boundaries of the ranges: quantiles of a sample of ids, chosen by their hash; at least eight for each shard.
    ids = light.select("page_id").where("page_id is not null")
    share = min(1.0, max(BOUNDARY_SAMPLE, 8 * shards) / max(n, 1))
    chosen = ids.where(F.pmod(F.xxhash64(F.lit("range"), "page_id"), F.lit(1 << 30)) < int(share * (1 << 30))).toPandas()
    sample = np.sort(chosen["page_id"].to_numpy(np.int64))
    cuts = np.unique(sample[np.linspace(0, len(sample), shards + 1)[1:-1].astype(int)]) if len(sample) and shards > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    joined = rows.join(first, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    joined = joined.select(
        "page_id",
        "url",
        "html",
        F.when(revisit, F.col("first.page_id")).alias("to"),
        F.when(revisit, F.col("first.url")).alias("to_url"),
        place(F.coalesce("page_id", F.lit(-(2**63)).cast("long"))).alias("shard"),
    )
    dealt = joined.repartitionById(len(cuts) + 1, F.col("shard")) if hasattr(joined, "repartitionById") else joined.repartition(len(cuts) + 1, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "url", F.md5("html"))

    # As text from here: beside a null pandas would hold a long as a floating point number.
    dealt = dealt.withColumns({c: F.col(c).cast("string") for c in ("page_id", "to")})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            done: list[tuple] = []
            for shard, page, url, html, to, to_url in zip(batch["shard"], batch["page_id"], batch["url"], batch["html"], batch["to"], batch["to_url"]):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.close()
                        done += now.done
                    now = _Roll(folder, int(shard), roll)
                name = page or ""
                data = record(name, url, html.encode("utf-8", "surrogatepass"), to, to_url)
                now.add(name, _member(data))
            if done:
                yield pd.DataFrame(done, columns=[x.split()[0] for x in MANIFEST.split(", ")])
        if now is not None:
            now.close()
            yield pd.DataFrame(now.done, columns=[x.split()[0] for x in MANIFEST.split(", ")])

    files, root = _store(folder)
    files.create_dir(root, recursive=True)
    manifest = f"{folder}/manifest-{uuid.uuid4().hex}"
    dealt.mapInPandas(write, MANIFEST).write.parquet(manifest)
    temp = f"{root}/.tmp-complete-{uuid.uuid4().hex}"
    with files.open_output_stream(temp) as out:
        out.write(json.dumps({"manifest": manifest.rsplit("/", 1)[-1]}).encode())
    files.move(temp, f"{root}/_COMPLETE.json")
    return manifest


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    data, z, out = stream.read(1 << 20), zlib.decompressobj(31), []
    while data:
        out.append(z.decompress(data))
        if z.eof:
            yield b"".join(out)
            data, z, out = z.unused_data or stream.read(1 << 20), zlib.decompressobj(31), []
        else:
            data = stream.read(1 << 20)
    if out and any(out):
        raise ValueError("the archive ends inside a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html, file)`` of a complete archive.

    Each file that the manifest lists is streamed by one task; digests of blocks and payloads are verified, and a
    wrong one or a missing record is an error. A revisit's size and digest are those of the full payload; its html is
    null.
    """
    files, root = _store(folder)
    with files.open_input_stream(f"{root}/_COMPLETE.json") as marker:
        manifest = f"{folder}/{json.loads(marker.read())['manifest']}"
    listed = spark.read.schema(MANIFEST).parquet(manifest)
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html", "file"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        for batch in batches:
            for name, records in zip(batch["file"], batch["records"]):
                rows, held, n = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        fields, block = parse(member)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        n += 1
                        if fields["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
                            raise ValueError(f"{name}: a block differs from its digest")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (size != len(payload) or payload_digest(payload) != digest):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        key, to = fields["Millrace-Key"], fields.get("Millrace-Refers-To-Key")
                        html = payload.decode("utf-8", "surrogatepass") if kind == "response" else None
                        rows.append((key or None, fields["WARC-Target-URI"], size, digest, kind, to or None, html, name))
                        held += len(payload)
                        if held > 4 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if n != records:
                    raise ValueError(f"{name}: {n} records of {records}")
                yield pd.DataFrame(rows, columns=columns)

    dealt = listed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    out = dealt.mapInPandas(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string, file string")
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/millrace/warc-{uuid.uuid4().hex}"
