"""Keyed tables as Parquet snapshots.

A write makes a new snapshot folder and then moves a small pointer file to it, so readers see the old or the new
table whole, and a failed write leaves the old one. One earlier snapshot is kept for readers still at work. Everything goes through Hadoop's file system layer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta

SCHEMAS = {
    "repo": "name string, path string, lang_primary string, build_cmd string, test_cmd string, lint_cmd string, run_cmd string, portforward_cmds array<string>, conventions_md string, runbook_md string, last_pack_sha string, head_sha string, branch string, default_branch string, remote_url string, dirty boolean, last_indexed_at timestamp, schema_version string",
    "service": "repo string, name string, description string, role string, tech_stack array<string>, port int, source string, schema_version string",
    "service_file": "repo string, service string, path string",
    "file": "repo string, path string, hash string, lang string, lines int, parse_error boolean, indexed_at timestamp, summary string, purpose_tags array<string>, skipped_reason string",
    "symbol": "repo string, fqname string, kind string, file_path string, signature string, doc_first_line string, line_start int, line_end int, visibility string, modifiers array<string>, return_type string, params_json string, deprecated boolean, summary string, summary_at timestamp",
    "import_edge": "repo string, from_path string, to_path string",
    "call_edge": "repo string, caller string, callee string, confidence double",
    "chunk": "id string, repo string, file_path string, idx int, text string, embed_vec array<float>, token_count int, line_start int, line_end int",
    "memory": "id string, repo string, label string, title string, body string, text string, rationale string, status string, kind string, url string, source_kind string, author string, session_id string, tags array<string>, tags_text string, embed_vec array<float>, embed_model string, created_at timestamp, updated_at timestamp, fetched_at timestamp",
    "mentions": "node string, repo string, kind string, target string",
    "supersedes": "new_id string, old_id string",
    "repo_edge": "src string, dst string, via string, evidence array<string>, confidence double, created_at timestamp, updated_at timestamp",
    "merkle_repo": "repo string, pack_sha string, last_packed timestamp",
    "merkle_files": "repo string, path string, hash string, last_indexed timestamp",
    "git_state": "repo string, head_sha string, branch string, last_seen timestamp",
}
KEYS = {
    "repo": ["name"], "service": ["repo", "name"], "service_file": ["repo", "service", "path"], "file": ["repo", "path"], "symbol": ["repo", "fqname"],
    "import_edge": ["repo", "from_path", "to_path"], "call_edge": ["repo", "caller", "callee"], "chunk": ["id"], "memory": ["id"],
    "mentions": ["node", "target"], "supersedes": ["new_id", "old_id"], "repo_edge": ["src", "dst", "via"], "merkle_repo": ["repo"],
    "merkle_files": ["repo", "path"], "git_state": ["repo"],
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self, table: str) -> str | None:
        fs, p = self._fs(f"{self.root}/{table}/_CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        """The table's rows; a table that was never written is empty."""
        name = self._current(table)
        if name is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/{name}")

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace the table: missing columns become null, other columns are dropped."""
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        old, name = self._current(table), f"snapshot-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{table}/{name}")
        temp_fs, temp = self._fs(f"{self.root}/{table}/.tmp-{uuid.uuid4().hex}")
        out = temp_fs.create(temp)
        out.write(bytearray(name.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        _, current = self._fs(f"{self.root}/{table}/_CURRENT")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(temp, current, options)
        fs, p = self._fs(f"{self.root}/{table}")
        for s in fs.listStatus(p):  # readers of the last snapshot may still be at work; older ones go
            found = s.getPath().getName()
            if found.startswith("snapshot-") and found not in (name, old):
                fs.delete(s.getPath(), True)

    def scratch(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written beside the tables and read again, in place of the ones of an earlier call."""
        path = f"{self.root}/_scratch/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def upsert(self, table: str, rows: DataFrame, create_only: tuple[str, ...] = ()) -> None:
        old = self.read(table)
        schema = old.schema
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        self.write(table, delta.upsert(old, rows, KEYS[table], create_only))

    def replace(self, table: str, rows: DataFrame, where: str) -> None:
        """Rows that match ``where`` go and ``rows`` come."""
        old = self.read(table)
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema))
        self.write(table, old.where(f"not coalesce({where}, false)").unionByName(rows))

    def purge(self, repo: str) -> dict[str, int]:
        """Delete a project from every table; counts of what went."""
        counts = {}
        for table in SCHEMAS:
            rows = self.read(table)
            mine = F.col("name") == repo if table == "repo" else (F.col("src") == repo) | (F.col("dst") == repo) if table == "repo_edge" else F.col("repo") == repo if "repo" in rows.columns else F.lit(False)
            counts[table] = rows.where(mine).count()
            if counts[table]:
                self.write(table, rows.where(~mine))
        return counts
