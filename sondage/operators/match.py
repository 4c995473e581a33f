"""Relations between the regions of a page: containment, caption scopes, and assignment of labels to drawings.

Scores and item numbers are column expressions over page-local pairs; only the assignments run in Python, all of a page in
one go and many pages to an Arrow batch. Their input is bounded by what fits on a page.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions import geometry as g
from sondage.functions.numerals import label_number_column
from sondage.functions.text import SPACE, nfkc, stable_hash
from sondage.operators.assign import greedy, optimal, per_group
from sondage.operators.state import cut_lineage

# Relation rules (source kind, target kind, relation), kinds that a group can hold, and the version written.
RULES = [("number", "artifact", "number_of"), ("caption", "artifact", "caption_of"), ("color_plate", "artifact", "color_plate_of"), ("line_drawing", "artifact", "drawing_of")]
CONTAINABLE = ["artifact", "number", "caption", "grave_drawing", "line_drawing", "color_plate"]
VERSION = "6"

# Shapes of item numbers in captions, and digits and what OCR takes for them in cropped labels.
ITEM_RANGE = r"(?U)(?<![A-Za-z0-9])(?<start>\d{1,3})(?:\s*[-–—~～至]\s*(?<end>\d{1,3}))?\s*(?=[.．、]|(?:为|是))"
ITEM_NUMERAL = r"(?U)(?<![一二三四五六七八九十百])([一二三四五六七八九十]{1,3})\s*[.．、]"
ITEM_OF_FIGURE = r"(?iU)(?:图|fig(?:ure)?\.?)[\s第]*[0-9一二三四五六七八九十百]+(?:\s*[-–—]\s*[0-9一二三四五六七八九十百]+)*\s*[:：]\s*(\d{1,3})"
LABEL = r"^[0-9OoIl|]{1,4}$"
LOOK_ALIKES = ("OoIl|", "00111")
#: The longest range that is spelled out.
LONGEST_RANGE = 100


def _numbers(text: Column, shape: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(shape), F.lit(group)), lambda x: x.try_cast("int"))


def caption_items(c: Column, normal: bool = False) -> Column:
    """array<int>: the item numbers that a caption lists, each once. A range counts from end to end if it rises by at most
    ``LONGEST_RANGE``, else its two ends; numerals, and the item behind a figure's number, count as well."""
    text = c if normal else nfkc(c)
    spans = F.arrays_zip(_numbers(text, ITEM_RANGE, 1).alias("a"), _numbers(text, ITEM_RANGE, 2).alias("b"))
    spelled = lambda x: F.when(x["b"].isNull(), F.array(x["a"])).when(x["b"].between(x["a"], x["a"] + LONGEST_RANGE), F.sequence(x["a"], x["b"])).otherwise(F.array(x["a"], x["b"]))
    numerals = F.transform(F.regexp_extract_all(text, F.lit(ITEM_NUMERAL), F.lit(1)), label_number_column)
    return F.array_compact(F.array_distinct(F.concat(F.flatten(F.transform(spans, spelled)), numerals, _numbers(text, ITEM_OF_FIGURE))))


def label_items(c: Column, normal: bool = False) -> Column:
    """array<int>: what a cropped sequence label may say. Digits and their look-alikes alone are one number; else every run of
    digits is, and the numeral that the whole label is."""
    text = c if normal else nfkc(c)
    tight = F.regexp_replace(text, SPACE, "")
    loose = F.concat(_numbers(text, r"(\d{1,3})"), F.array(label_number_column(tight)))
    return F.array_compact(F.array_distinct(F.when(tight.rlike(LABEL), F.array(F.translate(tight, *LOOK_ALIKES).cast("int"))).otherwise(loose)))


def items_agree(caption_items: Column, label_items: Column) -> Column:
    """1 or 0 where a caption and a label both name items, else null."""
    both = (F.size(caption_items) > 0) & (F.size(label_items) > 0)
    return F.when(both, F.arrays_overlap(caption_items, label_items).cast("double"))


def relation(kind: str | Column, method: str | Column) -> list[Column]:
    """Columns of a relation row, from source_id, target_id and score."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    method = F.lit(method) if isinstance(method, str) else method
    return ["job_id", "page", stable_hash("rel", F.col("job_id"), kind, F.col("source_id"), F.col("target_id")).alias("id"), F.col("source_id").alias("source_region_id"), F.col("target_id").alias("target_region_id"), kind.alias("relation_type"), F.round("score", 6).alias("score"), method.alias("method"), F.lit(VERSION).alias("version"), F.lit("unreviewed").alias("review_status")]


def page_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of regions of one page: structs s and t."""
    s = a.select("job_id", "page", F.struct(*a.columns).alias("s"))
    t = b.select("job_id", "page", F.struct(*b.columns).alias("t"))
    return s.join(t, ["job_id", "page"])


def best_groups(regions: DataFrame, least: float = g.CONTAINMENT) -> DataFrame:
    """job_id, page, region_id, group_id, score: the group that holds most of each region; the first on ties."""
    pairs = page_pairs(regions.filter(F.col("kind").isin(CONTAINABLE)), regions.filter("kind = 'group'"))
    scored = pairs.withColumn("score", g.containment(F.col("s.bbox"), F.col("t.bbox")))
    best = scored.groupBy("job_id", "page", F.col("s.id").alias("region_id")).agg(F.max_by(F.struct(F.col("t.id").alias("group_id"), "score"), F.struct("score", (-F.col("t.ord")).alias("o"))).alias("b"))
    return best.select("job_id", "page", "region_id", F.col("b.group_id").alias("group_id"), F.col("b.score").alias("score")).filter(F.col("score") >= least)


def with_items(regions: DataFrame) -> DataFrame:
    """``regions`` with ``items``: the item numbers that a caption or a number names, null for other kinds."""
    text = F.trim(F.coalesce("text", F.lit("")))
    normal = nfkc(F.when(F.col("kind").isin("caption", "number"), text))
    return regions.withColumn("items", F.when(F.col("kind") == "caption", caption_items(normal, True)).when(F.col("kind") == "number", label_items(normal, True)))


def caption_scopes(regions: DataFrame, least: float = g.MIN_SCORE) -> DataFrame:
    """job_id, page, region_id, caption_id, score, agrees: the caption in whose scope a number or artifact lies. ``regions``
    need items."""
    pairs = page_pairs(regions.filter("kind = 'caption'"), regions.filter(F.col("kind").isin("number", "artifact")))
    layout = g.caption_score(F.col("s.bbox"), F.col("t.bbox"), F.col("s.confidence"), F.col("t.confidence"))
    agrees = F.when(F.col("t.kind") == "number", items_agree(F.col("s.items"), F.col("t.items")))
    scored = pairs.withColumn("agrees", agrees).withColumn("score", g.caption_with_text(layout, F.col("agrees")))
    best = scored.groupBy("job_id", "page", F.col("t.id").alias("region_id")).agg(F.max_by(F.struct(F.col("s.id").alias("caption_id"), "score", "agrees"), F.struct("score", (-F.col("s.ord")).alias("o"))).alias("b"))
    return best.select("job_id", "page", "region_id", "b.*").filter(F.col("score") >= max(0.35, least * 0.8))


def _matched(rows: dict[str, np.ndarray], own: np.ndarray, least: float) -> list[tuple[str, str, float]]:
    """The optimal one-to-one pairs (source, target, score) among the pairs ``own``; ends in the order of their lists."""
    ids = [rows[f"{end}_id"][own] for end in ("source", "target")]
    left, right = (sorted(set(zip(rows[f"{end}_ord"][own], x, strict=True))) for end, x in zip(("source", "target"), ids, strict=True))
    left, right = [x[1] for x in left], [x[1] for x in right]
    at = [{v: i for i, v in enumerate(x)} for x in (left, right)]
    scores = np.zeros((len(left), len(right)))
    scores[[at[0][x] for x in ids[0]], [at[1][x] for x in ids[1]]] = rows["score"][own]
    return [(left[i], right[j], float(scores[i, j])) for i, j in optimal(scores, least)]


def match_pages(regions: DataFrame, least: float = g.MIN_SCORE) -> DataFrame:
    """Relation rows of all pages. ``regions``: job_id, page, id, kind, bbox, text, confidence, ord (place in its list).

    In order: containment in groups; captions of groups; caption scopes and the numbers in them; numbers to artifacts,
    first inside one caption's scope, then what is left inside one group or outside all groups; then the other rules inside
    each group. Regions without a valid box are left out; an empty table gives no rows.
    """
    fine = with_items(regions.filter(g.valid(F.col("bbox"))))
    inside = best_groups(fine)
    scopes = caption_scopes(fine, least)
    out = [inside.select("job_id", "page", F.col("group_id").alias("source_id"), F.col("region_id").alias("target_id"), "score").select(*relation("contains", "spatial_containment"))]
    key = ["job_id", "page", "id"]
    # read by all that follows, and small: no texts
    tagged = cut_lineage(fine.join(inside.select("job_id", "page", F.col("region_id").alias("id"), "group_id"), key, "left").join(scopes.select("job_id", "page", F.col("region_id").alias("id"), "caption_id", F.col("score").alias("scope_score"), "agrees"), key, "left").drop("text", "items"))
    linked = tagged.filter("kind = 'number' AND caption_id IS NOT NULL").select("job_id", "page", F.col("caption_id").alias("source_id"), F.col("id").alias("target_id"), F.col("scope_score").alias("score"), "agrees")
    out.append(linked.select(*relation("caption_to_number", F.when(F.col("agrees") == 1, "caption_ocr_scope").otherwise("caption_scope_fallback"))))

    a, b = F.col("s.bbox"), F.col("t.bbox")
    sure = F.col("s.confidence"), F.col("t.confidence")
    same = F.coalesce("s.group_id", F.lit("")) == F.coalesce("t.group_id", F.lit(""))
    between = lambda source, target: (F.col("s.kind") == source) & (F.col("t.kind") == target)
    rules = [(between("caption", "group"), "caption_of_group", g.caption_score(a, b, *sure)), (between("number", "artifact"), "number_of", g.number_score(a, b, *sure))]
    rules += [(between(source, target) & same, kind, g.pair_score(a, b, *sure, F.lit(source in ("number", "caption")))) for source, target, kind in RULES[1:]]
    kind, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for met, name, value in rules:
        kind, score = F.when(met, name).otherwise(kind), F.when(met, value).otherwise(score)
    pairs = page_pairs(tagged.filter(F.col("kind").isin("caption", *(r[0] for r in RULES))), tagged.filter(F.col("kind").isin("group", *(r[1] for r in RULES)))).filter(F.col("s.id") != F.col("t.id"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    scored = pairs.withColumn("relation", kind).filter("relation IS NOT NULL").select("job_id", "page", "relation", F.col("s.id").alias("source_id"), F.col("t.id").alias("target_id"), F.col("s.ord").alias("source_ord"), F.col("t.ord").alias("target_ord"), *(blank(F.col(f"{e}.{c}")).alias(f"{e}_{c}") for e in "st" for c in ("group_id", "caption_id")), score.alias("score"))

    def each(rows: dict[str, np.ndarray]) -> list[tuple]:
        """All assignments of a page: (job, page, relation, method, source, target, score)."""
        found: list[tuple] = []
        of = lambda name: rows["relation"] == name
        scope, group = rows["s_caption_id"], rows["s_group_id"]

        def take(own: np.ndarray, bucket: np.ndarray | None, name: str, method: str, grouped: str) -> None:
            for value in sorted(set(bucket[own])) if bucket is not None else [""]:
                part = own & (bucket == value) if bucket is not None else own
                if part.any():
                    found.extend((rows["job_id"][0], int(rows["page"][0]), name, grouped if value else method, *x) for x in _matched(rows, part, least))

        take(of("caption_of_group"), None, "caption_of_group", "caption_group_assignment", "")
        numbers, one = of("number_of"), (scope != "") & (scope == rows["t_caption_id"])
        take(numbers & one, scope, "number_of", "caption_scoped_assignment", "caption_scoped_assignment")
        used = [{x[k] for x in found if x[2] == "number_of"} for k in (4, 5)]
        free = np.array([s not in used[0] and t not in used[1] for s, t in zip(rows["source_id"], rows["target_id"], strict=True)], dtype=bool)
        apart = (scope != "") & (rows["t_caption_id"] != "") & ~one
        take(numbers & free & ~apart & (group == rows["t_group_id"]), group, "number_of", "directional_assignment", "directional_assignment_grouped")
        for _, _, name in RULES[1:]:
            if name != "caption_of" or not of("caption_of_group").any():  # a page with groups links captions to groups alone
                take(of(name), group, name, "spatial_assignment", "spatial_assignment_grouped")
        return found

    assigned = per_group(scored, ["job_id", "page"], ["relation", "source_ord", "target_ord"], each, "job_id string, page int, relation string, how string, source_id string, target_id string, score double")
    out.append(assigned.select("job_id", "page", "source_id", "target_id", "score", "relation", "how").select(*relation(F.col("relation"), F.col("how"))))
    return reduce(DataFrame.unionByName, out)


def iou_pairs(predicted: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """kind, page, pred_ord, gold_ord, iou of boxes of one kind and page that overlap enough."""
    p = predicted.select("kind", "page", F.col("ord").alias("pred_ord"), F.col("bbox").alias("pb"))
    t = gold.select("kind", "page", F.col("ord").alias("gold_ord"), F.col("bbox").alias("gb"))
    return p.join(t, ["kind", "page"]).withColumn("iou", g.iou(F.col("pb"), F.col("gb"))).filter(F.col("iou") >= least).drop("pb", "gb")


def detection_metrics(predicted: DataFrame, gold: DataFrame, kinds: list[str], least: float = 0.5) -> DataFrame:
    """Per kind predicted, gold and matched counts, precision, recall, f1, mean_iou; greedy pairs within each page."""

    def each(rows: dict[str, np.ndarray]) -> list[tuple]:
        return [(rows["kind"][0], float(x[0])) for x in greedy(list(zip(rows["iou"], rows["pred_ord"], rows["gold_ord"], strict=True)))]

    matched = per_group(iou_pairs(predicted, gold, least), ["kind", "page"], ["pred_ord", "gold_ord"], each, "kind string, iou double")
    base = predicted.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counts = base
    for df, name in ((predicted, "predicted_count"), (gold, "gold_count")):
        counts = counts.join(F.broadcast(df.groupBy("kind").agg(F.count("*").alias(name)).filter(F.col("kind").isin(kinds))), "kind", "left")
    ious = matched.groupBy("kind").agg(F.count("*").alias("matched_count"), F.sum("iou").alias("iou_sum"))
    n = counts.join(F.broadcast(ious), "kind", "left").na.fill(0)
    return metric_columns(n)


def metric_columns(n: DataFrame) -> DataFrame:
    """Precision, recall, f1 and mean IoU from counts; both sides empty count as perfect."""
    p, t, m = F.col("predicted_count"), F.col("gold_count"), F.col("matched_count")
    precision = F.when(p > 0, m / p).otherwise(F.when(t == 0, 1.0).otherwise(0.0))
    recall = F.when(t > 0, m / t).otherwise(F.when(p == 0, 1.0).otherwise(0.0))
    n = n.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return n.withColumn("f1", f1).withColumn("mean_iou", F.when(m > 0, F.col("iou_sum") / m).otherwise(0.0)).drop("iou_sum")


def page_labels(anchors: DataFrame) -> DataFrame:
    """Labels from above a number: per number the text line that overlaps its column and ends just above it."""
    w = Window.partitionBy("job_id", "page", "number_id").orderBy(F.desc("score"), "text_ord")
    return anchors.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
