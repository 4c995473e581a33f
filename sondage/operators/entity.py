"""Entity resolution: records that share identity tokens are one entity.

Phase one joins records over artifact tokens alone: connected components of a bipartite graph, by large-star and
small-star rounds over joins. Phase two attaches over figure and plate tokens, but never merges two components that both have artifact tokens and
share none; that step depends on order and runs in a grouped function on each set of components that such tokens connect.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import entity_id_text, nfkc, stable_hash
from sondage.operators.assign import per_group
from sondage.operators.state import cut_lineage

# How sure a link is, by the strongest token, and the kinds that can be shown.
CONFIDENCE = {"artifact": 0.98, "reference": 0.92, "none": 0.45}
LINKED_FROM = 0.85
VISUAL = ["artifact", "line_drawing", "color_plate", "grave_drawing"]
KIND_RANK = {"artifact": 0, "line_drawing": 1, "color_plate": 2, "grave_drawing": 3}


def plain(c: Column, normal: bool = False) -> Column:
    """Letters and digits of a reference part, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c if normal else nfkc(c), F.lit(""))), r"[^\p{L}\p{N}]+", "")


def record_tokens(ids: Column, figure: Column, figure_item: Column, plate: Column, plate_item: Column, normal: bool = False) -> Column:
    """Sorted distinct tokens of a record: artifact:id, figure:n:i, plate:n:i. ``ids`` is an array of raw identifiers."""
    own = F.transform(ids, lambda v: entity_id_text(v, True)) if normal else ids
    artifacts = F.transform(F.filter(own, lambda v: v != ""), lambda v: F.concat(F.lit("artifact:"), v))

    def pair(kind: str, no: Column, item: Column) -> Column:
        a, b = plain(no, normal), plain(item, normal)
        return F.when((a != "") & (b != ""), F.concat_ws(":", F.lit(kind), a, b))

    return F.array_sort(F.array_distinct(F.concat(artifacts, F.array_compact(F.array(pair("figure", figure, figure_item), pair("plate", plate, plate_item))))))


# A reference with its item, as hints write it.
COMBINED = r"(?U)^(.+?)[\s:\x{FF1A}\-\x{2013}\x{2014}]+([A-Za-z0-9]+)$"


def hint_tokens(figures: Column, plates: Column, normal: bool = False) -> Column:
    """Tokens of a record's hints: references that name an item, of figures and of plates."""

    def of(kind: str, refs: Column) -> Column:
        split = F.filter(F.transform(F.coalesce(refs, F.array().cast("array<string>")), F.trim), lambda r: r.rlike(COMBINED))
        parts = F.transform(split, lambda r: F.struct(plain(F.regexp_extract(r, COMBINED, 1), True).alias("a"), plain(F.regexp_extract(r, COMBINED, 2), True).alias("b")))
        return F.transform(F.filter(parts, lambda p: (p["a"] != "") & (p["b"] != "")), lambda p: F.concat_ws(":", F.lit(kind), p["a"], p["b"]))

    return F.array_sort(F.array_distinct(F.concat(of("figure", figures), of("plate", plates))))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) over undirected links (a, b). Large-star and small-star steps by turns until
    the links stay as they are, however long a chain is; the plan is cut by a checkpoint."""
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    nodes = cut_lineage(ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct())
    now = cut_lineage(ends.filter("a <> b"))
    signature = lambda: tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, after = None, signature()
    while before != after and after[0]:
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut_lineage(around.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut_lineage(large.join(low, "a").select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, after = after, signature()
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))


def resolve(records: DataFrame) -> DataFrame:
    """job_id, record_id, ord, tokens -> the same rows with ``group``: the record that stands for the entity.

    Records without tokens stay alone. Tokens are taken in sorted order, records by ``ord``. Parts that no figure or plate token
    joins never meet, so phase two runs on each connected set of parts by itself, not on a job; parts without such tokens are
    done after phase one.
    """
    keyed = records.select("job_id", "record_id", "ord", F.explode("tokens").alias("token"))
    key = lambda *c: F.concat_ws("\x1f", *c)
    exact = keyed.filter(F.col("token").startswith("artifact:")).select(key("job_id", F.lit("r"), "record_id").alias("a"), key("job_id", F.lit("t"), "token").alias("b"))
    roots = components(exact)
    own = key("job_id", F.lit("r"), "record_id")
    tagged = cut_lineage(records.join(roots.withColumnRenamed("root", "part"), own == F.col("node"), "left").withColumn("part", F.coalesce("part", own)).select("job_id", "record_id", "ord", "tokens", "part"))
    refers = tagged.select("job_id", "part", F.explode("tokens").alias("token")).filter(~F.col("token").startswith("artifact:"))
    sets = components(refers.select(F.col("part").alias("a"), key("job_id", F.lit("t"), "token").alias("b"))).select(F.col("node").alias("part"), F.col("root").alias("set"))
    joined = tagged.join(sets, "part", "left")
    alone = joined.filter("set IS NULL")
    first = alone.groupBy("part").agg(F.min_by("record_id", F.struct("ord", "record_id")).alias("group"))
    done = alone.join(first, "part").select("job_id", "record_id", "ord", "tokens", "group")

    def attach(rows: dict[str, np.ndarray]) -> list[tuple]:
        parent: dict[str, str] = {}
        ids: dict[str, set] = {}

        def find(x: str) -> str:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for part, tokens in zip(rows["part"], rows["tokens"], strict=True):
            ids.setdefault(part, set()).update(t for t in tokens if t.startswith("artifact:"))
        owner: dict[str, str] = {}
        for part, tokens in zip(rows["part"], rows["tokens"], strict=True):
            for token in sorted(t for t in tokens if not t.startswith("artifact:")):
                a, b = find(part), find(owner.setdefault(token, part))
                if a != b and not (ids[a] and ids[b] and ids[a].isdisjoint(ids[b])):
                    parent[b] = a
                    ids[a] |= ids[b]
        group = [find(p) for p in rows["part"]]
        first: dict[str, str] = {}
        for g, record in zip(group, rows["record_id"], strict=True):
            first.setdefault(g, record)
        return [(job, record, int(n), list(tokens), first[g]) for job, record, n, tokens, g in zip(rows["job_id"], rows["record_id"], rows["ord"], rows["tokens"], group, strict=True)]

    more = per_group(joined.filter("set IS NOT NULL").select("set", "job_id", "record_id", "ord", "tokens", "part"), ["set"], ["ord", "record_id"], attach, "job_id string, record_id string, ord long, tokens array<string>, group string")
    return done.unionByName(more)


def entities(resolved: DataFrame, visuals: DataFrame | None = None) -> DataFrame:
    """Per entity: id from its tokens (or records), members, confidence and link status. ``visuals``: record_id, region_id."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    rows = resolved.groupBy("job_id", "group").agg(union("tokens").alias("match_keys"), F.array_sort(F.collect_set("record_id")).alias("record_ids"))
    if visuals is not None:
        shown = resolved.join(visuals, "record_id").groupBy("job_id", "group").agg(F.array_sort(F.collect_set("region_id")).alias("visual_ids"))
        rows = rows.join(shown, ["job_id", "group"], "left")
    else:
        rows = rows.withColumn("visual_ids", F.array().cast("array<string>"))
    rows = rows.withColumn("visual_ids", F.coalesce("visual_ids", F.array().cast("array<string>")))
    marker = F.when(F.size("match_keys") > 0, F.array_join("match_keys", "|")).otherwise(F.array_join("record_ids", "|"))
    return rows.select("job_id", stable_hash("ent", F.col("job_id"), marker).alias("entity_id"), "match_keys", "record_ids", "visual_ids", *link_quality(F.col("match_keys"), F.col("visual_ids")))


def owned_columns(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Per entity the columns that linking owns on its records: all pages, sorted, the canonical identifier (of the first record that
    has one, in upper case), and why they belong together. ``records``: job_id, record_id, pages, artifact_id."""
    rows = resolved.join(records, ["job_id", "record_id"])
    some = F.nullif(F.upper(F.trim("artifact_id")), F.lit(""))
    return rows.groupBy("job_id", "group").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("associated_pages"), F.min_by(some, F.when(some.isNotNull(), F.struct("ord", "record_id"))).alias("canonical_artifact_id"), F.array_sort(F.collect_set(F.when(F.size("tokens") > 0, F.split(F.col("tokens")[0], ":")[0]))).alias("link_reasons"))


def link_quality(keys: Column, visuals: Column) -> list[Column]:
    some = lambda p: F.exists(keys, lambda k: k.startswith(p))
    sure = F.when(some("artifact:"), CONFIDENCE["artifact"]).when(some("figure:") | some("plate:"), CONFIDENCE["reference"]).otherwise(CONFIDENCE["none"])
    seen = F.size(visuals) > 0
    return [sure.alias("confidence"), F.when(seen & (sure >= LINKED_FROM), "linked").when(seen | (F.size(keys) > 0), "needs_review").otherwise("unlinked").alias("link_status")]


def thumbnail(regions: DataFrame, by: list[str]) -> DataFrame:
    """The region to show per group: with a crop, on a preferred page, of the better kind, with the smaller id.
    ``regions``: the group's columns, region_id, has_crop, preferred, kind_rank."""
    rank = F.struct((~F.col("has_crop")).alias("a"), (~F.col("preferred")).alias("b"), "kind_rank", "region_id")
    return regions.groupBy(*by).agg(F.min_by("region_id", rank).alias("thumbnail_region_id"))
