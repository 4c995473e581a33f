"""Re-matching: differences between two sets of links, protection of reviewed ones, and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.operators.verify import confidence_bucket

# Columns whose change makes a link changed, in the detail list and in the report.
DETAIL = ["source_region_id", "target_region_id", "relation_type", "score", "method"]
REPORT = ["method", "score"]


def diff(old: DataFrame, new: DataFrame, key: str = "id", compared: list[str] | None = None, keep_unchanged: bool = False) -> DataFrame:
    """key, change, before, after by a full outer join on the key: added, removed or changed; unchanged links are left out
    unless asked for."""
    compared = compared or DETAIL
    a = old.select(key, F.struct(*compared).alias("before"))
    b = new.select(key, F.struct(*compared).alias("after"))
    same = reduce(Column.__and__, (F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")) for c in compared))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    out = a.join(b, key, "full_outer").select(key, change.alias("change"), "before", "after")
    return out if keep_unchanged else out.filter("change <> 'unchanged'")


def protect(old: DataFrame, new: DataFrame) -> DataFrame:
    """The candidate set after human decisions: accepted and manual links stay as they are, links that were rejected (same
    ends and type) do not come back, and a kept link replaces the new one with its id."""
    kept = old.filter("review_status = 'accepted' OR method = 'manual'")
    rejected = old.filter("review_status = 'rejected'").select("source_region_id", "target_region_id", "relation_type")
    fresh = new.join(rejected.distinct(), ["source_region_id", "target_region_id", "relation_type"], "left_anti").join(kept.select("id"), "id", "left_anti")
    return kept.select(*new.columns).withColumn("protected", F.lit(True)).unionByName(fresh.withColumn("protected", F.lit(False)))


def guarded_records(records: DataFrame, baseline: DataFrame, columns: list[str]) -> DataFrame:
    """Records that a human passed keep the baseline's link columns unless their signature changed."""
    base = baseline.select("record_id", F.col("signature").alias("__sig"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = records.join(base, "record_id", "left")
    safe = F.coalesce((F.col("human") == "passed") & (F.col("signature") == F.col("__sig")), F.lit(False))
    return joined.select(*[c for c in records.columns if c not in columns], safe.alias("protected"), *(F.when(safe, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def report(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One row: sizes of the difference, confidence buckets, markers in methods and protection. Markers overlap, so this is
    one aggregate and no grouping."""
    changes = diff(old, new, key, REPORT, keep_unchanged=True)
    sizes = changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "unchanged")))
    bucket = confidence_bucket(F.col("score"))
    links = new.agg(*(F.count_if(bucket == b).alias(f"confidence_{b}") for b in ("high", "medium", "low")), *(F.count_if(F.contains("method", F.lit(m))).alias(f"method_{m}") for m in ("ocr", "fallback", "directional", "spatial")))
    return sizes.crossJoin(links)  # two single rows


def preview_report(records: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: how many records are linked, partly linked and not, and how many have a complete chain: a drawing and a caption or a
    number among their regions. ``records``: record_id, fusion_status, region_ids."""
    own = records.select("record_id", F.explode("region_ids").alias("id")).join(regions.select("id", "kind"), "id")
    chains = own.groupBy("record_id").agg((F.bool_or(F.col("kind") == "artifact") & F.bool_or(F.col("kind").isin("caption", "number"))).alias("chain")).agg(F.count_if("chain").alias("complete_chains"))
    states = records.agg(F.count("*").alias("total_records"), *(F.count_if(F.col("fusion_status") == s).alias(f"{s}_records") for s in ("linked", "partial", "unlinked")))
    return states.crossJoin(chains)  # two single rows


def supersede(links: DataFrame, old_id: str, new_target: str, new_id: str, reviewer: str) -> DataFrame:
    """A rebind: the old link is rejected and points to a new accepted one."""
    hit = F.col("id") == old_id
    old = links.withColumn("review_status", F.when(hit, "rejected").otherwise(F.col("review_status"))).withColumn("superseded_by", F.when(hit, F.lit(new_id)).otherwise(F.col("superseded_by")))
    new = links.filter(hit).withColumn("id", F.lit(new_id)).withColumn("target_region_id", F.lit(new_target)).withColumn("review_status", F.lit("accepted")).withColumn("method", F.lit("manual")).withColumn("supersedes", F.lit(old_id)).withColumn("reviewer", F.lit(reviewer))
    return old.unionByName(new)


def rebind_array(ids: Column, old: Column, new: Column) -> Column:
    return F.array_union(F.array_remove(ids, old), F.array(new))


def cleaned(records: DataFrame, derived: list[str]) -> DataFrame:
    """Records as they were before matching: no derived columns, no link arrays in their evidence."""
    out = records.drop(*derived)
    if "evidence" in out.columns:
        out = out.withColumn("evidence", F.transform("evidence", lambda e: e.dropFields("region_ids", "relation_ids")))
    return out
