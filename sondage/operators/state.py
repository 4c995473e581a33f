"""Keyed and scoped writes, run states and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.session import shared_folder

# Allowed moves of a run, and its last states.
MOVES = {
    "queued": {"running", "cancelled", "failed"},
    "running": {"paused", "completed", "completed_with_warnings", "failed", "cancelled", "terminated"},
    "paused": {"running", "terminated", "cancelled"},
}
TERMINAL = ["completed", "completed_with_warnings", "failed", "cancelled", "terminated"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key: one pass over both, no join."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"))
    return both.withColumn("__n", F.rank().over(w)).filter("__n = 1").drop("__new", "__n")


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """``old`` without any row of the scopes that ``new`` writes, and ``new``."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def replace_keeping(old: DataFrame, new: DataFrame, scope: list[str], key: list[str], kept: list[str]) -> DataFrame:
    """As ``replace_scope``, but columns that people filled (``kept``) stay as they were on rows whose key was there before."""
    before = old.select(*scope, *key, F.struct(*kept).alias("__kept"))
    joined = new.join(before, [*scope, *key], "left")
    carried = joined.select(*(F.when(F.col("__kept").isNotNull(), F.col(f"__kept.{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in new.columns))
    return replace_scope(old, carried, scope)


def write_scope(new: DataFrame, path: str, scope: list[str]) -> None:
    """The same as a sink: only the partitions of the scopes written are replaced, in one commit."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def append(new: DataFrame, path: str) -> None:
    new.write.mode("append").parquet(path)


def moved(status: Column, to: str) -> Column:
    """The state after a move, or an error where it is not allowed."""
    allowed = [a for a, bs in MOVES.items() if to in bs]
    return F.when(status.isin(allowed), F.lit(to)).otherwise(F.raise_error(F.concat(F.lit(f"no move to {to} from "), status)))


def completed_at(status: Column, before: Column, now: Column) -> Column:
    """Set once a run ends, kept while it stays ended, cleared when it starts again."""
    return F.when(status.isin(TERMINAL), F.coalesce(before, now))


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.filter(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def stale(runs: DataFrame, note: str) -> DataFrame:
    """Runs found active after a restart fail."""
    active = F.col("status").isin("queued", "running")
    return runs.withColumn("error", F.when(active, F.lit(note)).otherwise(F.col("error"))).withColumn("status", F.when(active, "failed").otherwise(F.col("status")))


def job_status(pages: DataFrame) -> DataFrame:
    """job_id, status from page states: all failed, some trouble, or completed."""
    bad = F.count_if(F.col("status") == "failed")
    trouble = F.count_if(F.col("status").isin("failed", "warning"))
    return pages.groupBy("job_id").agg(F.when(bad == F.count("*"), "failed").when(trouble > 0, "completed_with_warnings").otherwise("completed").alias("status"))
