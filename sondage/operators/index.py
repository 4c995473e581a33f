"""Page index: references, recall, page classes, runs, text chunks and context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.numerals import reference_number_column
from sondage.functions.text import NUMERALS, SPACE, nfkc

# Titles of reference lists, entry lines, and page locators.
INDEX_TITLE = r"(?i)(?:插图|附图|图版|彩图|彩版|图片|图表|照片)\s*(?:目录|目次|索引)|(?:list|table)\s+of\s+(?:figures|plates|illustrations)|(?:figure|plate|illustration)\s+index"
INDEX_ENTRY = rf"(?i)^\s*(?:附?图|彩图|彩版|图版|fig(?:ure)?\.?|plate|illustration)\s*[{NUMERALS}\d]+(?:\s*[-–—:：.]\s*[A-Za-z{NUMERALS}\d]+)*"
LOCATOR = rf"^[\s.·…\-–—]*(?:\d{{1,4}}|[{NUMERALS}]{{1,8}})[\s.·…]*$"
VISUAL = ["artifact", "line_drawing", "grave_drawing", "color_plate", "group"]
# Thresholds of page classes.
COLOR_RATIO, CHROMA, TILE, RUN = 0.035, 18.0, 0.08, 3
TYPE_BONUS = {"color_plate": 0.35, "color_visual": 0.3, "monochrome_visual": 0.25, "mixed_visual": 0.2}
# References to objects, figures and plates.
ARTIFACT = r"(?U)(?<![A-Za-z0-9])([A-Za-z]{1,5}\s*\d+[A-Za-z]?(?:\s*[:：]\s*[A-Za-z0-9]+)+)"
FIGURE = r"(?iU)(?:图|圖|fig(?:ure)?)\s*([一二三四五六七八九十百零〇两兩0-9]+)(?:\s*[-—–:：]\s*([A-Za-z0-9一二三四五六七八九十]+))?"
PLATE = r"(?iU)(?:彩版|彩图|彩圖|图版|圖版|plate)\s*([一二三四五六七八九十百零〇两兩0-9]+)(?:\s*[-—–:：]\s*([A-Za-z0-9一二三四五六七八九十]+))?"
# Page types on which a figure or plate can be.
PICTURED = ["color_plate", "color_visual", "monochrome_visual", "mixed_visual"]


def is_index_title(raw: Column, normal: bool = False) -> Column:
    text = raw if normal else nfkc(raw)
    return text.rlike(INDEX_TITLE) | F.regexp_replace(text, SPACE, "").rlike(INDEX_TITLE)


def is_index_text(text: Column, entries: int = 8, longest: int = 120, normal: bool = False) -> Column:
    """A reference list: by its title, or by enough short entry lines. ``normal`` promises normalised text."""
    short = F.filter(F.split(text, "\n"), lambda x: x.rlike(INDEX_ENTRY) & (F.length(F.trim(x)) <= longest))
    return F.coalesce(is_index_title(text, normal) | (F.size(short) >= entries), F.lit(False))


def index_pages(regions: DataFrame) -> DataFrame:
    """Pages that are reference lists by their regions: a title, or six entries and three locators on the right and no
    picture. ``regions``: document_id, page, kind, text, bbox."""
    text = F.trim(F.coalesce("text", F.lit("")))
    agg = regions.groupBy("document_id", "page").agg(F.bool_or(is_index_title(text)).alias("title"), F.count_if(text.rlike(INDEX_ENTRY)).alias("entries"), F.count_if(text.rlike(LOCATOR) & (F.col("bbox.l") >= 0.72)).alias("locators"), F.count_if(F.col("kind").isin(VISUAL)).alias("visuals"))
    return agg.filter("title OR (entries >= 6 AND locators >= 3 AND visuals = 0)").select("document_id", "page")


def without_index_pages(rows: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    return rows.join(pages.withColumnRenamed("page", "__p"), (rows["document_id"] == pages["document_id"]) & (F.col(page) == F.col("__p")), "left_anti")


def records_off_index_pages(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Records none of whose source pages is a reference list."""
    hit = records.select("document_id", "record_id", F.explode("source_pages").alias("page")).join(pages, ["document_id", "page"], "left_semi")
    return records.join(hit, ["document_id", "record_id"], "left_anti")


def references(rows: DataFrame, text: str, normal: bool = False) -> DataFrame:
    """The rows with ``references``: sorted distinct artifact:x, figure:n[:i], plate:n[:i]. Numerals are numbers; an item that is
    none counts by its letters and digits. ``normal`` promises normalised text."""
    t = F.coalesce(F.col(text), F.lit(""))
    t = t if normal else nfkc(t)
    bare = lambda v: F.lower(F.regexp_replace(v, r"[^\p{L}\p{N}]", ""))
    number = lambda v: F.coalesce(reference_number_column(v).cast("string"), bare(v))
    artifacts = F.filter(F.transform(F.regexp_extract_all(t, F.lit(ARTIFACT), F.lit(1)), bare), lambda v: F.length(v) >= 3)

    def family(kind: str, pattern: str) -> Column:
        found = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("i"))
        return F.transform(found, lambda x: F.concat(F.lit(f"{kind}:"), number(x["n"]), F.when(bare(x["i"]) != "", F.concat(F.lit(":"), number(x["i"]))).otherwise("")))

    each = F.concat(F.transform(artifacts, lambda v: F.concat(F.lit("artifact:"), v)), family("figure", FIGURE), family("plate", PLATE))
    return rows.withColumn("references", F.array_sort(F.array_distinct(each)))


def exploded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per reference: family, number, item (null if absent)."""
    each = rows.select(*keys, F.explode("references").alias("reference"))
    part = F.split("reference", ":")
    return each.select(*keys, "reference", part[0].alias("family"), part[1].alias("number"), F.when(F.size(part) > 2, F.get(part, F.lit(2))).alias("item"))


def compatible(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """Pairs of requested and page references of one family and number whose items are equal or absent on one side;
    artifacts must be equal. An equi join on (family, number); the rest is a filter."""
    r = requested.select(F.col("reference").alias("requested"), "family", "number", F.col("item").alias("ri"))
    p = pages.withColumnRenamed("item", "pi")
    fits = F.when(F.col("family") == "artifact", F.col("requested") == F.col("reference")).otherwise(F.col("ri").isNull() | F.col("pi").isNull() | (F.col("ri") == F.col("pi")))
    return r.join(p, ["family", "number"]).filter(fits)


def recall(requested: DataFrame, pages: DataFrame, requested_pages: list[int], limit: int) -> DataFrame:
    """document_id, page, score, matches of the pages to read: a point per reference matched, half a point more for exact
    ones, and the bonus of the page's type; figures and plates are looked for on pages with pictures only. ``pages``:
    document_id, page, page_type, references."""
    own = pages.filter(~F.col("page").isin(requested_pages)) if requested_pages else pages
    met = compatible(exploded(requested, []), exploded(own, ["document_id", "page", "page_type"])).filter((F.col("family") == "artifact") | F.col("page_type").isin(PICTURED))
    per = met.groupBy("document_id", "page", "page_type", "requested").agg(F.bool_or(F.col("requested") == F.col("reference")).alias("exact"))
    bonus = F.lit(0.0)
    for kind, value in TYPE_BONUS.items():
        bonus = F.when(F.col("page_type") == kind, value).otherwise(bonus)
    scored = per.groupBy("document_id", "page", "page_type").agg((F.count("*") + F.count_if("exact") * 0.5 + F.first(bonus)).alias("score"), F.array_sort(F.collect_set("requested")).alias("matches"))
    return scored.orderBy(F.desc("score"), "page").limit(limit)


def unresolved(requested: DataFrame, pages: DataFrame) -> DataFrame:
    met = compatible(exploded(requested, []), exploded(pages, ["page", "page_type"])).filter((F.col("family") == "artifact") | F.col("page_type").isin(PICTURED)).select(F.col("requested").alias("reference")).distinct()
    return exploded(requested, []).select("reference").distinct().join(met, "reference", "left_anti")


def scaled_limit(pages: int, configured: int, share: float, most: int = 200) -> int:
    """A budget that grows with long documents."""
    return min(most, max(configured, -int(-(share * pages) // 1)))


def page_class(p: dict[str, Column]) -> Column:
    """struct<page_type, confidence, reason> from features: text_length, plate, figure (booleans), images, color, foreground,
    tile, chroma, dark, edge."""
    chromatic = (p["color"] >= COLOR_RATIO) & ((p["tile"] >= TILE) | (p["foreground"] >= 0.10) | (p["chroma"] >= CHROMA * 1.5))
    margin = F.least(p["color"] / COLOR_RATIO, F.greatest(p["tile"] / TILE, p["foreground"] / 0.10))
    sure = F.least(F.lit(0.99), 0.68 + F.greatest(F.lit(0.0), margin - 1) * 0.12)
    out = lambda kind, c, why: F.struct(F.lit(kind).alias("page_type"), (F.lit(c) if isinstance(c, float) else c).alias("confidence"), F.lit(why).alias("reason"))
    has_image, no_text = p["images"] > 0, p["text_length"] == 0
    return (
        F.when(chromatic & p["plate"], out("color_plate", sure, "plate_reference_and_chromatic_content"))
        .when(chromatic & (p["text_length"] >= 500), out("mixed_visual", sure, "dense_text_with_chromatic_content"))
        .when(chromatic, out("color_visual", sure, "distributed_chromatic_content"))
        .when(p["plate"] & has_image, out("mixed_visual", 0.72, "plate_reference_with_embedded_image"))
        .when(p["figure"] & (has_image | ((p["text_length"] <= 400) & (p["edge"] >= 0.025))), out("mixed_visual", 0.72, "figure_reference_with_visual_content"))
        .when(has_image & no_text & (p["dark"] >= 0.004), out("monochrome_visual", 0.78, "image_only_non_chromatic_page"))
        .when((p["dark"] >= 0.004) & (p["edge"] >= 0.018), out("monochrome_visual", 0.7, "edge_dense_non_chromatic_content"))
        .when(no_text & (p["dark"] < 0.004), out("blank", 0.98, "near_empty_page"))
        .otherwise(out("document", 0.68, "textual_page"))
    )


def promoted_runs(pages: DataFrame, by: list[str], order: list[str], member: Column, least: int = RUN) -> DataFrame:
    """Adds run_length, the length of the run of neighbours for which ``member`` holds (0 outside): islands are told apart
    by the difference of two row numbers."""
    w = Window.partitionBy(*by).orderBy(*order)
    island = F.row_number().over(w) - F.sum(F.when(member, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = pages.withColumn("__in", F.coalesce(member, F.lit(False))).withColumn("__island", island)
    length = F.count_if(F.col("__in")).over(Window.partitionBy(*by, "__island"))
    return marked.withColumn("run_length", F.when(F.col("__in"), length).otherwise(0)).withColumn("promoted", F.col("run_length") >= least).drop("__in", "__island")


def equal_runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of neighbours with one value: by, value, run (from 1), length, first and last of the order."""
    w = Window.partitionBy(*by).orderBy(*order)
    start = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("run", F.sum(start).over(w))
    return numbered.groupBy(*by, "run", value).agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def text_chunks(blocks: DataFrame, by: str, order: str, starts: Column) -> DataFrame:
    """Chunks without a size cap: a chunk begins at every block that starts one. A running sum numbers them."""
    w = Window.partitionBy(by).orderBy(order)
    numbered = blocks.withColumn("chunk", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "\n")
    return numbered.groupBy(by, "chunk").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("blocks"), joined.alias("text")).withColumn("content_hash", F.sha2("text", 256))


def capped_chunks(blocks: DataFrame, most_chars: int = 8000, cross_page: int = 8) -> DataFrame:
    """document_id, chunk, ids, first_page, last_page, text of blocks (document_id, page, ord, text, ids).

    A block with ids of its own starts a chunk and its ids hold until the next; without active ids a chunk ends with its page;
    with them it may go on over ``cross_page`` page breaks. A block that would make it outgrow ``most_chars`` starts the next
    chunk, which inherits the ids. The caps reset the state, so a document is read in order by one grouped call.
    """

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        now: dict | None = None
        for row in pdf.sort_values("ord", kind="stable").itertuples():
            ids, size = list(row.ids) if row.ids is not None else [], len(row.text) + 1
            fresh = now is None or bool(ids)
            if not fresh:
                turned = row.page != now["last_page"]
                now["turns"] += turned
                if turned and (not now["ids"] or now["turns"] > cross_page):
                    fresh = True
                elif now["size"] + size > most_chars:
                    fresh, ids = True, now["ids"]
            if fresh:
                now = {"document_id": row.document_id, "chunk": len(out), "ids": ids, "first_page": row.page, "last_page": row.page, "texts": [], "size": 0, "turns": 0}
                out.append(now)
            now["texts"].append(row.text)
            now["size"] += size
            now["last_page"] = row.page
        for c in out:
            c["text"] = "\n".join(c.pop("texts"))
        return pd.DataFrame(out, columns=["document_id", "chunk", "ids", "first_page", "last_page", "text"])

    return blocks.groupBy("document_id").applyInPandas(scan, "document_id string, chunk int, ids array<string>, first_page int, last_page int, text string")


def nearest_context(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str) -> DataFrame:
    """Pairs of equal key at the smallest distance of two positions, with all ties. The minimum is an aggregate that the
    pairs are joined to, so a hot key is no window partition."""
    pairs = left.join(right, key).withColumn("distance", F.abs(F.col(at_left) - F.col(at_right)))
    least = pairs.groupBy(key, at_left).agg(F.min("distance").alias("distance"))
    return pairs.join(least, [key, at_left, "distance"]).select(*pairs.columns)


def visual_features(pixels, width: int, height: int) -> dict[str, float]:
    """Features of an RGB page image: shares of coloured, coloured foreground and dark pixels, edges, coloured tiles of a
    6 x 8 grid, and the nearest-rank 95th percentile of chroma."""
    import numpy as np

    rgb = np.asarray(pixels, dtype=np.int32).reshape(height, width, 3)
    top, low = rgb.max(2), rgb.min(2)
    chroma, light = top - low, rgb.mean(2)
    coloured = (chroma >= CHROMA) & (chroma >= 0.12 * np.maximum(top, 1))
    front = light < 235
    flat = np.sort(chroma.ravel())
    edge = (np.abs(np.diff(light, axis=1))[:-1] + np.abs(np.diff(light, axis=0))[:, :-1]) > 36 if min(width, height) > 1 else np.zeros((1, 1), bool)
    tiles = [t.mean() >= 0.1 for rows in np.array_split(coloured, 8) for t in np.array_split(rows, 6, axis=1) if t.size]
    return {"color": float(coloured.mean()), "foreground": float((coloured & front).sum() / max(1, front.sum())), "dark": float((light < 96).mean()), "edge": float(edge.mean()), "tile": float(np.mean(tiles)), "chroma": float(flat[min(flat.size - 1, int(flat.size * 0.95))])}
