"""Read side: page scopes, evidence context, primary pages and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_relations(relations: DataFrame, regions: DataFrame, page: int) -> DataFrame:
    """Relations with either end on the page: two semi joins, each row once."""
    here = regions.filter(F.col("page") == page).select("job_id", F.col("id").alias("__id"))
    hit = lambda c: relations.join(here, (relations["job_id"] == here["job_id"]) & (F.col(c) == F.col("__id")), "left_semi")
    return hit("source_region_id").unionByName(hit("target_region_id")).dropDuplicates(["job_id", "id"])


def primary_pages(weights: DataFrame) -> DataFrame:
    """record_id, page, score: the page with the largest sum of field weights, each (record, field, page) once; pages that
    are no colour plate first, then score, fields, the selected page, and the smaller number."""
    each = weights.groupBy("record_id", "field", "page").agg(F.max("weight").alias("weight"), F.bool_or("is_color").alias("is_color"), F.bool_or("is_selected").alias("is_selected"))
    per = each.groupBy("record_id", "page").agg(F.sum("weight").alias("score"), F.count("*").alias("fields"), F.bool_or("is_color").alias("is_color"), F.bool_or("is_selected").alias("is_selected"))
    rank = F.struct((~F.col("is_color")).alias("a"), "score", "fields", "is_selected", (-F.col("page")).alias("p"))
    best = per.groupBy("record_id").agg(F.max_by(F.struct("page", "score"), rank).alias("b"))
    return best.select("record_id", F.col("b.page").alias("page"), F.col("b.score").alias("score"))


def restored(records: DataFrame, relations: DataFrame, regions: DataFrame, keep: list[int] | None = None, drop: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Partial outputs: to be kept a record must lie on kept pages alone; to be dropped it need only touch a dropped page.
    Relations stay where both ends do."""
    if keep is not None:
        own = F.forall("source_pages", lambda p: p.isin(keep))
        page = F.col("page").isin(keep)
    else:
        own = ~F.exists("source_pages", lambda p: p.isin(drop or [-1]))
        page = ~F.col("page").isin(drop or [-1])
    regions = regions.filter(page)
    ids = regions.select(F.col("id").alias("__id"))
    left = relations
    for c in ("source_region_id", "target_region_id"):
        left = left.join(ids, F.col(c) == F.col("__id"), "left_semi")
    return records.filter(own), left, regions


def context(record_ids: DataFrame, records: DataFrame, relations: DataFrame, regions: DataFrame) -> dict[str, DataFrame]:
    """Records asked for and their entity's siblings, with the regions and relations that they touch."""
    asked = records.join(record_ids, "record_id", "left_semi")
    siblings = records.join(asked.select("entity_id").filter("entity_id IS NOT NULL").distinct(), "entity_id", "left_semi")
    every = asked.unionByName(siblings).dropDuplicates(["record_id"])
    own = every.select(F.explode("region_ids").alias("id")).distinct()
    touching = relations.join(every.select(F.explode("relation_ids").alias("id")).distinct(), "id", "left_semi")
    ends = touching.select(F.explode(F.array("source_region_id", "target_region_id")).alias("id"))
    return {"records": every, "relations": touching, "regions": regions.join(own.unionByName(ends).distinct(), "id", "left_semi")}


def annotations(evidence: DataFrame, regions: DataFrame) -> DataFrame:
    """Boxes to draw: evidence with its region's box where there is one, and the page's pictures nobody refers to."""
    joined = evidence.join(regions.select(F.col("id").alias("region_id"), F.col("bbox").alias("region_box"), "page"), ["region_id", "page"], "left")
    shown = joined.select("page", "region_id", F.coalesce("region_box", "bbox").alias("bbox"), F.lit("evidence").alias("origin")).filter("bbox IS NOT NULL")
    free = regions.filter(F.col("kind").isin("artifact", "line_drawing", "color_plate")).join(evidence.select(F.col("region_id").alias("id")).filter("id IS NOT NULL").distinct(), "id", "left_anti")
    return shown.unionByName(free.select("page", F.col("id").alias("region_id"), "bbox", F.lit("unreferenced").alias("origin")))
