"""Evidence fusion: hints to regions, plate references, primary links, neighbourhoods and ownership."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions import geometry as g
from sondage.functions.text import fuzzy_score
from sondage.operators.assign import optimal, per_group

# Weights of hints, the page window, floors and strong scores.
HINTS = {"figure_refs": 1.0, "figure_item_nos": 1.0, "caption_texts": 0.98, "plate_refs": 0.98, "artifact_ids": 0.96, "aliases": 0.86}
WINDOW, HINT_FLOOR, STRONG, SPATIAL_FLOOR, NEAREST_FLOOR = 3, 0.62, 0.94, 0.2, 0.25
EDGES = ["contains", "caption_of_group", "caption_to_number", "number_of", "caption_of", "color_plate_of"]


def hint_weight(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in HINTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def hint_score(text: Column, page_gap: Column, weight: Column) -> Column:
    return (0.9 * text + 0.1 * F.greatest(F.lit(0.0), 1 - page_gap / (WINDOW + 1))) * weight


def banded(hints: DataFrame, regions: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs of one job within ``window`` pages: each hint is copied to the pages around its own, so the band is an equi join
    on (job, page) and not a nested loop."""
    near = hints.withColumn("page", F.explode(F.sequence(F.col("hint_page") - window, F.col("hint_page") + window)))
    return near.join(regions, ["job_id", "page"]).withColumn("page_gap", F.abs(F.col("page") - F.col("hint_page")))


def hint_matches(hints: DataFrame, regions: DataFrame, text_score: Column | None = None) -> DataFrame:
    """The best region per (record, kind), and all regions that a strong hint names wherever they are, once each.

    ``hints``: job_id, record_id, hint_kind, hint, hint_page; ``regions``: job_id, region_id, page, kind, text. ``text_score`` reads
    hint and text alone.

    Records with the same hints are one class, regions with the same pages and texts another. Pairs are scored between classes, a
    pair of texts once, and what a class gets is dealt out to its records and regions: equal texts cost no pair of rows.
    """
    sets = lambda own, of: F.array_sort(F.collect_set(F.struct(*of))).alias(own)
    said = hints.groupBy("job_id", "record_id").agg(sets("said", ["hint_kind", "hint", "hint_page"]))
    shown = regions.groupBy("job_id", "kind", "region_id").agg(sets("shown", ["page", "text"]))
    asking = said.select("job_id", "said").distinct().select("job_id", "said", F.inline("said"))
    places = shown.groupBy("job_id", "kind", "shown").agg(F.max("region_id").alias("last")).select("job_id", "kind", "shown", "last", F.inline("shown"))
    near = banded(asking, places)
    far = asking.filter(F.col("hint_kind").isin("artifact_ids", "plate_refs")).join(places, (asking["job_id"] == places["job_id"]) & (F.col("hint") == F.col("text"))).drop(places["job_id"])
    far = far.withColumn("page_gap", F.abs(F.col("page") - F.col("hint_page"))).filter(F.col("page_gap") > WINDOW)
    columns = ["job_id", "said", "hint_kind", "hint", "kind", "shown", "last", "page_gap", "text"]
    pairs = near.select(*columns).unionByName(far.select(*columns))
    score = text_score if text_score is not None else fuzzy_score(F.col("hint"), F.col("text"))
    texts = pairs.select("hint", "text").distinct().withColumn("text_score", score)
    scored = pairs.join(texts, ["hint", "text"]).withColumn("score", hint_score(F.col("text_score"), F.col("page_gap"), hint_weight(F.col("hint_kind")))).filter(F.col("score") >= HINT_FLOOR)
    top = scored.groupBy("job_id", "said", "kind").agg(F.max_by(F.struct(F.col("last").alias("region_id"), "score", "hint_kind"), F.struct("score", "last")).alias("b"))
    strong = scored.filter(F.col("text_score") >= STRONG).groupBy("job_id", "said", "kind", "shown").agg(F.max(F.struct("score", "hint_kind")).alias("s"))
    # the best region of a class goes out once, with the best score, whether strong or not
    named = strong.join(top.select("job_id", "said", "kind", F.col("b.region_id").alias("best")), ["job_id", "said", "kind"])
    out = ["job_id", "record_id", "kind", "region_id", "score", "hint_kind"]
    first = said.join(top, ["job_id", "said"]).select("job_id", "record_id", "kind", "b.*").select(*out)
    rest = said.join(named, ["job_id", "said"]).join(shown, ["job_id", "kind", "shown"]).filter("region_id <> best")
    return first.unionByName(rest.select("job_id", "record_id", "kind", "region_id", "s.score", "s.hint_kind").select(*out))


def spatial_evidence(evidence: DataFrame, regions: DataFrame) -> DataFrame:
    """One-to-one evidence and regions of one page and kind. ``evidence``: job_id, page, kind, evidence_id, bbox."""
    pairs = evidence.join(regions.select("job_id", "page", "kind", "region_id", F.col("bbox").alias("rb")), ["job_id", "page", "kind"]).withColumn("score", g.evidence_score(F.col("bbox"), F.col("rb")))
    return grouped_assignment(pairs, ["job_id", "page", "kind"], "evidence_id", "region_id", SPATIAL_FLOOR)


def nearest_visuals(records: DataFrame, regions: DataFrame) -> DataFrame:
    """Records without a picture and the crops within the page window, one to one within a job."""
    pairs = banded(records, regions).withColumn("score", g.nearest_score(g.distance(F.col("record_box"), F.col("bbox")), F.col("page_gap"), F.col("bbox.b") <= F.col("record_box.t"), F.col("id_match")))
    return grouped_assignment(pairs, ["job_id"], "record_id", "region_id", NEAREST_FLOOR, connected=True)


def grouped_assignment(pairs: DataFrame, by: list[str], left: str, right: str, least: float, connected: bool = False) -> DataFrame:
    """Optimal pairs within each group. Pairs below ``least`` are never assigned, so they are dropped before the shuffle, and what
    is left falls apart into sets that pairs connect. Where a group may be large (``connected``) the sets are found by joins and
    each is a group of its own; else within the group's call."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    fine = pairs.filter(F.col("score") >= least).select(*by, left, right, "score")
    keys = by
    if connected:
        from sondage.operators.entity import components
        from sondage.operators.state import cut_lineage

        fine, name = cut_lineage(fine), lambda side, c: F.concat_ws("\x1f", *by, F.lit(side), F.col(c).cast("string"))
        sets = components(fine.select(name("l", left).alias("a"), name("r", right).alias("b"))).select(F.col("node").alias("__l"), F.col("root").alias("__set"))
        fine, keys = fine.join(sets, name("l", left) == F.col("__l")).drop("__l"), ["__set"]

    def each(rows: dict[str, np.ndarray]) -> list[tuple]:
        lo, hi = (np.unique(rows[c], return_inverse=True) for c in (left, right))
        part = list(range(len(lo[0]) + len(hi[0])))

        def find(x: int) -> int:
            while part[x] != x:
                part[x] = part[part[x]]
                x = part[x]
            return x

        for a, b in zip(lo[1].tolist(), hi[1].tolist(), strict=True):
            part[find(a)] = find(len(lo[0]) + b)
        roots = np.array([find(a) for a in lo[1].tolist()])
        out, head = [], [rows[c][0] for c in by]
        for root in np.unique(roots):
            own = roots == root
            (ln, li), (rn, ri) = (np.unique(x[1][own], return_inverse=True) for x in (lo, hi))
            scores = np.zeros((len(ln), len(rn)))
            scores[li, ri] = rows["score"][own]
            out += [(*head, lo[0][ln[i]], hi[0][rn[j]], float(scores[i, j])) for i, j in optimal(scores, least)]
        return [tuple(x.item() if isinstance(x, np.generic) else x for x in row) for row in out]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, left, right]) + ", score double"
    return per_group(fine, keys, [left, right], each, schema)


def plate_references(records: DataFrame, labels: DataFrame) -> DataFrame:
    """record_id, region_id, score: the plate region a record's (plate, item) numbers point to. Candidates that name another
    artifact are out; among the rest an equal artifact, then the surer, then the smaller id wins."""
    number = ["job_id", "plate_no", "item_no"]
    rank = F.struct("confidence", (-F.col("region_ord")).alias("o"))
    # of labels that say the same only the best can win, and records that say the same get the same: one row each meets
    labels = labels.withColumn("named", F.coalesce("label_artifact", F.lit(""))).groupBy(*number, "named").agg(F.max_by(F.struct("region_id", "confidence", "region_ord"), rank).alias("l")).select(*number, "named", "l.*")
    said = records.select(*number, "artifact_id").distinct()
    named = F.col("named") != ""
    fine = said.join(labels, number).withColumn("exact", named & (F.col("named") == F.col("artifact_id"))).filter(~named | F.col("exact") | (F.coalesce("artifact_id", F.lit("")) == ""))
    order = lambda: F.struct("exact", "confidence", (-F.col("region_ord")).alias("o"))
    best = fine.groupBy(*number, F.col("artifact_id").alias("own")).agg(F.max_by(F.struct("region_id", "exact", "confidence", "region_ord"), order()).alias("b"))
    met = records.join(best, number).filter(F.col("artifact_id").eqNullSafe(F.col("own"))).select("job_id", "record_id", "b.*")
    best = met.groupBy("job_id", "record_id").agg(F.max_by(F.struct("region_id", "exact"), order()).alias("b"))
    return best.select("job_id", "record_id", F.col("b.region_id").alias("region_id"), F.when(F.col("b.exact"), 0.99).otherwise(0.96).alias("score"))


def primary_edges(edges: DataFrame) -> DataFrame:
    """The edge that shows a record best: equal id, accepted, score, owned, near its pages, first in order; the larger id if even that is equal."""
    rank = F.struct("id_match", "accepted", "score", "owned", (-F.col("page_gap")).alias("p"), (-F.col("ord")).alias("o"), "edge_id")
    return edges.groupBy("record_id").agg(F.max_by(F.struct("edge_id", "score"), rank).alias("b")).select("record_id", F.col("b.edge_id").alias("edge_id"), F.col("b.score").alias("score"))


def two_hops(seeds: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """seed, node, hops of everything within two undirected edges: two joins, the least number of hops wins. With ``types`` only
    edges of those relation types are walked."""
    edges = edges.filter(F.col("relation_type").isin(types)) if types else edges
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    one = seeds.select(F.col("seed"), F.col("seed").alias("a")).join(both, "a").select("seed", F.col("b").alias("node"))
    two = one.withColumnRenamed("node", "a").join(both, "a").select("seed", F.col("b").alias("node"))
    every = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")).unionByName(one.withColumn("hops", F.lit(1))).unionByName(two.withColumn("hops", F.lit(2)))
    return every.groupBy("seed", "node").agg(F.min("hops").alias("hops"))


def absorb(owners: DataFrame, captions: DataFrame) -> DataFrame:
    """Caption-only records go to the richest record of their artifact: record_id, owner_id (null for orphans)."""
    best = owners.groupBy("job_id", "artifact_id").agg(F.max_by("record_id", F.struct("richness", (-F.col("ord")).alias("o"))).alias("owner_id"))
    return captions.join(best, ["job_id", "artifact_id"], "left").select("job_id", "record_id", "artifact_id", "owner_id")


def recover_orphans(orphans: DataFrame, texts: DataFrame, shortest: int = 24) -> DataFrame:
    """The body text that names an orphan: most signals, then length up to 200, then the earlier page; a text without signals
    must have ``shortest`` characters. ``texts``: job_id, artifact_id, region_id, page, signals, text."""
    fine = texts.filter((F.col("signals") > 0) | (F.length("text") >= shortest))
    rank = F.struct("signals", F.least(F.length("text"), F.lit(200)).alias("n"), (-F.col("page")).alias("p"))
    best = fine.groupBy("job_id", "artifact_id").agg(F.max_by("region_id", rank).alias("region_id"))
    return orphans.join(best, ["job_id", "artifact_id"])


def merge_fragments(blocks: DataFrame, gap: float = 0.03) -> DataFrame:
    """job_id, page, block_id, owner_id: a block without an id joins the nearest owner above within ``gap`` unless the owner's
    text ends a sentence; the owner's span grows. One call per page, in reading order."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        owners: list[dict] = []
        out = []
        for row in pdf.sort_values(["t", "l", "block_id"], kind="stable").itertuples():
            if row.artifact_id:
                owners.append({"id": row.block_id, "b": row.b, "text": row.text or ""})
                out.append((row.job_id, row.page, row.block_id, row.block_id))
                continue
            near = [o for o in owners if 0 <= row.t - o["b"] + gap and row.t - o["b"] <= gap and not o["text"].rstrip().endswith(("。", ".", "！", "？", "；"))]
            own = max(near, key=lambda o: o["b"], default=None)
            if own:
                own["b"], own["text"] = max(own["b"], row.b), own["text"] + (row.text or "")
            out.append((row.job_id, row.page, row.block_id, own["id"] if own else None))
        return pd.DataFrame(out, columns=["job_id", "page", "block_id", "owner_id"])

    return blocks.groupBy("job_id", "page").applyInPandas(each, "job_id string, page int, block_id string, owner_id string")


def next_lines(lines: DataFrame) -> DataFrame:
    """For each line the next one below: smallest gap, then largest overlap, then the first."""
    a = lines.select("job_id", "page", F.col("line_id").alias("a_id"), F.col("bbox").alias("a"))
    b = lines.select("job_id", "page", F.col("line_id").alias("b_id"), F.col("bbox").alias("b"), F.col("ord").alias("b_ord"))
    pairs = a.join(b, ["job_id", "page"]).filter((F.col("a_id") != F.col("b_id")) & (F.col("b.t") >= F.col("a.b")))
    overlap = g.axis_overlap(F.col("a.l"), F.col("a.r"), F.col("b.l"), F.col("b.r"))
    rank = F.struct((F.col("b.t") - F.col("a.b")).alias("gap"), (-overlap).alias("o"), "b_ord")
    return pairs.withColumn("rank", rank).filter(overlap > 0).groupBy("job_id", "page", "a_id").agg(F.min_by("b_id", "rank").alias("next_id"))


def local_evidence(records: DataFrame, relations: DataFrame, core_types: list[str]) -> DataFrame:
    """record_id, id of the relations that a record's view shows: those it names itself, and of those whose ends touch one of its core
    pictures the structural ones. ``records``: record_id, relation_ids, core_ids."""
    named = records.select("record_id", F.explode("relation_ids").alias("id")).join(relations.select("id"), "id").select("record_id", "id")
    core = records.select("record_id", F.explode("core_ids").alias("end"))
    ends = relations.filter(F.col("relation_type").isin(core_types)).select("id", F.explode(F.array_distinct(F.array("source_region_id", "target_region_id"))).alias("end"))
    return named.unionByName(core.join(ends, "end").select("record_id", "id")).distinct()


def fusion_status(matched: Column, expected: Column) -> Column:
    return F.when(matched == 0, "unlinked").when(matched >= expected, "linked").otherwise("partial")


def caption_anchor(scores: DataFrame) -> DataFrame:
    """Per record the number its caption anchors: by priority, then .55 caption + .45 item, then order."""
    w = Window.partitionBy("record_id").orderBy(F.desc("priority"), F.desc(0.55 * F.col("caption_score") + 0.45 * F.col("item_score")), "ord")
    return scores.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def prefer_near_exact(candidates: DataFrame) -> DataFrame:
    """Where a record has an exact candidate nearby, only such candidates stay."""
    w = Window.partitionBy("record_id")
    return candidates.withColumn("__any", F.max(F.col("near_exact").cast("int")).over(w)).filter("__any = 0 OR near_exact").drop("__any")


def prune_foreign(evidence: DataFrame, owners: DataFrame) -> DataFrame:
    """Evidence on a region that belongs to another artifact goes."""
    foreign = evidence.join(owners, "region_id").filter(F.col("owner_artifact_id") != F.col("artifact_id")).select("record_id", "region_id")
    return evidence.join(foreign, ["record_id", "region_id"], "left_anti")
