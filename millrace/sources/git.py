"""Version-control facts of one working copy, read on the driver (a handful of commands for each repository)."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

META = "repo string, head_sha string, branch string, default_branch string, remote_url string, dirty boolean"


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def meta(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """One row; fields that cannot be read are null. Untracked files do not make a copy dirty."""
    head = _git(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD")
    default = head.rsplit("/", 1)[-1] if head else next((b for b in ("main", "master") if _git(root, "rev-parse", "--verify", "--quiet", b)), None)
    status = _git(root, "status", "--porcelain", "--untracked-files=no")
    row = (repo, _git(root, "rev-parse", "HEAD"), _git(root, "rev-parse", "--abbrev-ref", "HEAD"), default, _git(root, "remote", "get-url", "origin"), None if status is None else bool(status))
    return spark.createDataFrame([row], META)


def name_status(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """The raw change stream between two commits, for ``operators.delta.parse_name_status``."""
    return spark.createDataFrame([(_git(root, "diff", "--name-status", "-z", base, head) or "",)], "stream string")


def ignored(spark: SparkSession, root: str) -> DataFrame:
    found = _git(root, "ls-files", "--others", "--ignored", "--exclude-standard", "-z") or ""
    return spark.createDataFrame([(p,) for p in found.split("\0") if p], "path string")


def fetch_outcome(behind: int | None, dirty: bool, on_default: bool, pull: bool) -> str:
    """What a scheduled fetch should do next."""
    if behind is None:
        return "fetch_failed"
    if behind == 0:
        return "up_to_date"
    if not pull:
        return "behind"
    return "blocked_dirty" if dirty else "pull_fast_forward" if on_default else "blocked_branch"
