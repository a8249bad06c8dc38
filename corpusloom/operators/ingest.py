"""Files and what is recorded of them: classification, hashes, the difference of both, incremental commits and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: groups by file pattern, tried in this order; what is excluded comes first
EXCLUDED = r"(?:^|/)(?:node_modules|target|build|dist|\.git)/"
GROUPS = {"java": r"\.java$", "python": r"\.py$", "typescript": r"\.tsx?$", "javascript": r"\.jsx?$", "go": r"\.go$", "maven": r"(?:^|/)pom\.xml$", "yaml": r"\.ya?ml$", "json": r"\.json$", "sql": r"\.sql$", "shell": r"\.sh$", "docs": r"\.md$"}


def classify(path: Column) -> Column:
    """The first group whose pattern fits, 'excluded' before all, null for none."""
    c = F.when(path.rlike(EXCLUDED), "excluded")
    for name, pattern in GROUPS.items():
        c = c.when(path.rlike(pattern), name)
    return c


def clean(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/{2,}", "/"), r"^(?:\./|/)+", "")


def coverage(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """(repo, path, status): ok, changed, unrecorded or deleted, by a full outer join of disk and record on repository and path.

    files and recorded: (repo, path, sha256), one row a key.
    """
    j = files.select("repo", "path", F.col("sha256").alias("now"), F.lit(True).alias("d")).join(recorded.select("repo", "path", F.col("sha256").alias("then"), F.lit(True).alias("r")), ["repo", "path"], "full_outer")
    status = F.when(F.col("d").isNull(), "deleted").when(F.col("r").isNull(), "unrecorded").when(F.col("now").eqNullSafe(F.col("then")), "ok").otherwise("changed")
    return j.select("repo", "path", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with the new rows of equal keys over them: a new value counts unless it is null."""
    cols = [c for c in old.columns if c != key]
    j = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return j.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in cols])


def commit(old: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Chunks after an incremental commit: those of changed and deleted (repo, path) leave, the changed files' new ones come. Equal hashes were left out of ``changed`` before."""
    keys = ["repo", "path"]
    gone = changed.select(*keys).unionByName(deleted.select(*keys)).distinct()
    return old.join(gone, keys, "left_anti").unionByName(changed.select(*old.columns))


def last_runs(runs: DataFrame) -> DataFrame:
    """(repository_id, run_id, status, chunks_written, change): each repository's last run and its chunks relative to the run before."""
    w = Window.partitionBy("repository_id").orderBy("started_at", "id")
    r = runs.where("repository_id IS NOT NULL AND started_at IS NOT NULL").select("repository_id", "id", F.lower(F.trim("status")).alias("status"), "chunks_written", F.lag("chunks_written").over(w).alias("before"), F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("started_at"), F.desc("id"))).alias("rn"))
    return r.where("rn = 1").select("repository_id", F.col("id").alias("run_id"), "status", "chunks_written", F.round((F.col("chunks_written") - F.col("before")) / F.col("before"), 6).alias("change"))
