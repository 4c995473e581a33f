"""Queries: identifiers and links, records and pages, sources and sinks over the whole driver tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.functions import geometry as g
from sondage.operators import catalog, entity, evaluate, evidence, extraction, fuse, index, linkage, reading, records, rematch, state, verify
from sondage.plans.cases import cases
from sondage.plans.adapters import lines
from sondage.plans.registry import keyed_query as query
from sondage.session import shared_folder, table
from sondage.sources import files

Frame = DataFrame
text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
named = lambda prefix, c: F.concat(F.lit(prefix), text(c))

# --- identifiers and hints ---------------------------------------------------------------------------------------------

cases("fusion_id", ["string"], "VARCHAR", [(" m13 : 9", "M13:9"), ("仲M4:3", "M4:3"), ("BI(M5：1)", "M5:1"), ("T0302(2:34", "T03022:34"), ("T03022):34", "T03022:34"), ("M1:2 M1:3", "M1:2M1:3"), (None, "")], linkage.fusion_id, "SF8.")
cases("line_id", ["string"], "VARCHAR", [("MI:6 bowl", "M1:6"), ("M1:6 bowl", "M1:6"), ("10302:5", "T0302:5"), ("(bowl) M1:6", "M1:6"), ("no number", ""), ("M|2:l", "")], linkage.line_id, "SF11, SF12: digits read as letters, a leading T read as 1.")
cases("id_score", ["string", "string"], "DOUBLE", [("M1:6", "MI：6", 1.0), ("M02:2", "M022", 1.0), ("M13:9", "M139", 0.0), ("M1:5", "M1:59", 0.0), ("T03021:01", "T0302:01", 1.0), ("M3:4", "M3:11", 0.0), ("M3:4", "see M3:4 and M3:5", 1.0), ("pot", "pot", 0.0)], linkage.id_score, "SF15: identifiers agree or they do not.")
cases("hint_text_score", ["string", "string", "string"], "DOUBLE", [
    ("figure_item_nos", "3", "13", 0.0), ("figure_item_nos", "3", "3.", 1.0), ("artifact_ids", "M1:5", "M1:59", 0.0), ("artifact_ids", "M1:5", "MI:5", 1.0), ("figure_refs", "图3-1", "见 图 3-1 处", 0.96), ("figure_refs", "图3-1", "图3-12", 0.94),
    ("caption_texts", "灰陶罐", "灰 陶 罐", 1.0), ("aliases", "abcd", "bcde", 0.75), ("plate_refs", "abcd", "bcde", 0.75),
], linkage.hint_text_score, "SF17: by the kind of hint.")
cases("strong_hints", ["string", "string"], "BOOLEAN", [("artifact_ids", "M1:5", True), ("artifact_ids", "M", False), ("figure_refs", "图３-1", True), ("plate_refs", "彩版 x 2", True), ("figure_refs", "图", False), ("aliases", "M1:5", False)], linkage.strong_hint, "PR33.")
cases("hint_methods", ["string", "int", "boolean"], "VARCHAR", [("number", 1, True, "caption_item_identifier_fusion"), ("number", 4, True, "global_caption_item_fusion"), ("number", 4, False, "global_identifier_fusion"), ("caption", 0, None, "caption_first_identifier_fusion"), ("artifact", 3, False, "identifier_evidence_fusion")], linkage.hint_method, "PR33.")
cases("crop_compatibility", ["string", "array<string>", "boolean"], "BOOLEAN", [("M1:5", ["M1:5"], False, True), ("M1:5", ["M1:6"], False, False), ("M1:5", [], True, False), ("M1:5", [], False, None), ("", ["M1:6"], False, False), (None, [], True, False), ("pot", [], False, None), ("T0302:1", ["T03021:1"], True, True)], linkage.crop_compatibility, "PR32: yes, no, or nothing tells.")
cases("ordered_union", ["array<string>", "array<string>"], "VARCHAR[]", [(["b", "a"], ["a", "c"], ["b", "a", "c"]), (None, ["x", "x"], ["x"]), ([], [], [])], linkage.ordered_union, "ST4.")
cases("category_lead", ["string"], "VARCHAR", [("：陶尊。敞口", "陶尊"), ("，玉珠，白", "玉珠"), ("敞口 平底", ""), ("罐", "罐")], linkage.category_lead, "SF34.")
cases("texture_phrase", ["string"], "VARCHAR", [("罐，泥质灰陶，轮制", "泥质灰陶"), ("夹砂陶", "夹砂陶"), ("白玉", "白玉"), ("round", "")], linkage.texture_phrase, "SF34.")
cases("cache_keys", ["string", "string"], "VARCHAR", [("a", 'x"y', hashlib.sha256(b'{"page": "x\\"y", "schema": "a"}').hexdigest()), ("罐", "1", hashlib.sha256('{"page": "1", "schema": "罐"}'.encode()).hexdigest())], lambda a, b: linkage.cache_key({"schema": a, "page": b}), "SF47: digest of sorted-key JSON.")
cases("duration_seconds", ["string"], "DOUBLE", [("1m30.5s", 90.5), ("2h", 7200.0), ("12.5", 12.5), ("soon", None), (None, None), ("1D", 86400.0)], linkage.duration_seconds, "ML10.")
cases("retry_delays", ["string", "string", "int"], "DOUBLE", [("7", None, 0, 7.0), (None, "1m30s", 1, 60.0), (None, None, 3, 4.0), (None, None, 9, 60.0), ("0.01", None, 0, 0.1)], linkage.retry_delay, "ML10.")
cases("output_tokens", ["int", "int"], "INTEGER", [(0, 10, 780), (1, 3, 768), (5, 10, 2620), (99, 10, 4096)], lambda n, k: linkage.output_tokens(n, k, 4096), "ML8.")
cases("record_limits", ["int"], "INTEGER", [(10, 8), (40, 2), (400, 1), (1, 10)], lambda k: linkage.record_limit(k, 4096, 10), "ML8.")


def _machine(i: int) -> tuple[int, float, bool, str]:
    return [(16, 32.0, True, "PP-OCRv5_medium"), (16, 32.0, True, "small"), (4, 8.0, False, "medium"), (64, 8.0, False, "v4"), (2, 2.0, False, "")][i]


_PLANS = [(2, 7, 2, 8), (8, 1, 4, 16), (1, 3, 1, 8), (4, 8, 4, 16), (1, 2, 1, 8)]


@query("SELECT p_partkey AS name, " + ", ".join(f"CASE p_partkey % 5 {' '.join(f'WHEN {i} THEN {p[j]}' for i, p in enumerate(_PLANS))} END AS {c}" for j, c in enumerate(("workers", "threads", "discovery", "batch"))) + " FROM part")
def worker_plans(spark: SparkSession, sf: str) -> Frame:
    """ML13."""
    pick = lambda j: F.element_at(F.array(*(F.lit(_machine(i)[j]) for i in range(5))), (F.col("p_partkey") % 5 + 1).cast("int"))
    machines = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), pick(0).alias("cpus"), pick(1).alias("memory_gb"), pick(2).alias("cuda"), pick(3).alias("model"))
    return linkage.worker_plan(machines)


@query("""WITH h AS (SELECT p_partkey AS record_id, unnest([1, 2, 3, 4]) AS n, p_size, p_brand, p_type FROM part),
k AS (SELECT record_id, CASE n WHEN 1 THEN 'figure_refs' WHEN 2 THEN 'caption_texts' WHEN 3 THEN 'artifact_ids' ELSE 'aliases' END AS kind, CASE n WHEN 1 THEN 'Fig ' || p_size WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_type END WHEN 3 THEN p_brand ELSE 'a' END AS hint, n FROM h)
SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY n) - 1)::INTEGER AS pos, kind, hint FROM k WHERE trim(hint) <> ''""")
def record_hints(spark: SparkSession, sf: str) -> Frame:
    """PR33: hints in the order they are tried; blank ones are none."""
    s = F.col("p_size")
    one = lambda c: F.array(c)
    hints = F.create_map(F.lit("aliases"), one(F.lit("a")), F.lit("artifact_ids"), one(F.col("p_brand")), F.lit("caption_texts"), one(F.when(s % 2 == 0, " ").otherwise(F.col("p_type"))), F.lit("figure_refs"), one(named("Fig ", s)))
    return linkage.record_hints(table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), hints.alias("hints")))


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 4 IN (0, 1) THEN NULL WHEN o_custkey % 4 = 2 THEN 'r' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey END AS thumbnail_region_id FROM orders""")
def shown_thumbnails(spark: SparkSession, sf: str) -> Frame:
    """PR28: none, unknown, plain, and approximate ones with and without a crop."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf, "orders")
    rows = orders.select(k.alias("record_id"), F.when(c % 4 == 1, named("gone", k)).when(c % 4 > 1, named("r", k)).alias("thumbnail_region_id"))
    regions = orders.select(named("r", k).alias("id"), (c % 4 == 3).alias("approximate"), F.when(k % 2 == 0, "crop").alias("crop_object_key"))
    return linkage.shown_thumbnails(rows, regions)


@query("""WITH f AS (SELECT p_partkey AS record_id, unnest(['morphological_description', 'category', 'texture']) AS key, p_size FROM part)
SELECT record_id, key, CASE key WHEN 'category' THEN 'new' WHEN 'texture' THEN 'old' ELSE CASE WHEN p_size % 3 = 0 THEN 'round neck' ELSE 'round neckwide foot' END END AS value, CASE key WHEN 'category' THEN 1 WHEN 'texture' THEN 1 ELSE CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END END::INTEGER AS n FROM f""")
def merged_values(spark: SparkSession, sf: str) -> Frame:
    """PR29, ST5: blanks are filled, descriptions go on, evidence is united."""
    k, s = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf, "part")
    seen = lambda page: F.array(F.struct(page.cast("int").alias("page"), F.lit("r").alias("region_id"), F.lit("q").alias("quote")))
    rows = lambda *v: F.array(*(F.struct(F.lit(a).alias("key"), b.cast("string").alias("value"), c.alias("evidence")) for a, b, c in v))
    none = F.lit(None)
    own = part.select(k.alias("record_id"), F.inline(rows(("morphological_description", F.lit("round neck"), seen(F.lit(1))), ("category", F.lit(" "), seen(F.lit(1))), ("texture", F.lit("old"), seen(F.lit(1))))))
    more = part.select(k.alias("owner_id"), F.inline(rows(("morphological_description", F.when(s % 3 == 0, "neck").otherwise("wide foot"), seen(1 + s % 2)), ("category", F.lit("new"), seen(F.lit(9))), ("texture", none, seen(F.lit(9))))))
    return linkage.merged_values(own, more).select("record_id", "key", "value", F.size("evidence").alias("n"))


@query("""SELECT l_orderkey AS job_id, 'rel_' || substr(sha256(l_orderkey || ':color_plate_of:c' || l_linenumber || ':a' || l_partkey), 1, 24) AS id, 'color_plate_of' AS relation_type, 'exact_artifact_id_color_page' AS method, round(l_quantity / 64, 6) AS score FROM lineitem""")
def color_relations(spark: SparkSession, sf: str) -> Frame:
    """GR9."""
    pairs = lines(spark, sf).select(F.col("l_orderkey").alias("job_id"), named("c", "l_linenumber").alias("color_region_id"), named("a", "l_partkey").alias("artifact_region_id"), (F.col("l_quantity") / 64).alias("score"))
    return linkage.color_relations(pairs, "22").select("job_id", "id", "relation_type", "method", "score")


@query("""SELECT 'rel_' || substr(sha256(l_orderkey || ':plate_reference_to_color:t' || l_linenumber || ':c' || l_partkey || ':' || (l_suppkey % 9) || ':' || l_linenumber), 1, 24) AS id, 'exact_plate_item_reference' AS method FROM lineitem""")
def plate_relations(spark: SparkSession, sf: str) -> Frame:
    """GE19, JN16."""
    pairs = lines(spark, sf).select(F.col("l_orderkey").alias("job_id"), named("t", "l_linenumber").alias("text_region_id"), named("c", "l_partkey").alias("color_region_id"), (F.col("l_suppkey") % 9).alias("plate_no"), F.col("l_linenumber").alias("item_no"), F.lit(0.99).alias("score"))
    return linkage.plate_relations(pairs, "22").select("id", "method")


@query("""WITH e AS (SELECT l_orderkey AS record_id, 'r' || l_linenumber AS region_id, CASE l_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS a, l_partkey % 5 AS f, l_linenumber FROM lineitem)
SELECT record_id, arg_min(region_id, (a, f, l_linenumber)) AS region_id FROM e GROUP BY 1""")
def display_evidence(spark: SparkSession, sf: str) -> Frame:
    """PR33, PR34."""
    k = F.col("l_partkey") % 5
    key = F.when(k == 0, "figure_caption").when(k == 1, "artifact_id").when(k == 2, "category").otherwise("other")
    return linkage.display_evidence(lines(spark, sf).select(F.col("l_orderkey").alias("record_id"), key.alias("key"), k.alias("field_ord"), F.col("l_linenumber").alias("pos"), named("r", "l_linenumber").alias("region_id")))


@query("""SELECT conv_id, count(*)::BIGINT AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations WHERE turn % 3 <> 0 GROUP BY 1""")
def compact_views(spark: SparkSession, sf: str) -> Frame:
    """PR19, PR40."""
    item = F.struct(F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("page"), F.col("text").alias("quote"), F.lit("r").alias("region_id"), F.lit(None).cast("string").alias("kind"), F.lit("detail").alias("detail"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(item).alias("text_evidence")).withColumns({"model_run_ids": F.array(), "relation_ids": F.array()})
    each = linkage.compact_view(rows).select("conv_id", F.explode("text_evidence").alias("e"))
    return each.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("e.quote")).cast("long").alias("chars"))


@query("""WITH v AS (SELECT p_partkey, 'M' || lpad((p_partkey % 50)::VARCHAR, 2, '0') || ':' || (p_size % 10) AS good FROM part),
r AS (SELECT p_partkey, good, CASE WHEN p_partkey % 4 = 0 THEN replace(good, '1', '|') ELSE good END AS t FROM v)
SELECT p_partkey, good AS repaired FROM r WHERE t = good OR EXISTS (SELECT 1 FROM r s WHERE s.p_partkey % 4 <> 0 AND s.good = r.good) OR (SELECT count(*) FROM r s WHERE s.t = s.good AND split_part(s.good, ':', 1) = split_part(r.good, ':', 1)) >= 3""")
def repaired_ids(spark: SparkSession, sf: str) -> Frame:
    """SF11, AG20: every fourth identifier is read with bars for ones."""
    k = F.col("p_partkey")
    good = F.concat(F.lit("M"), F.lpad(text(k % 50), 2, "0"), F.lit(":"), text(F.col("p_size") % 10))
    rows = table(spark, sf, "part").select(k.alias("row_id"), F.when(k % 4 == 0, F.translate(good, "1", "|")).otherwise(good).alias("t"))
    return records.repaired_ids(rows, "t").filter("repaired IS NOT NULL").select(F.col("row_id").alias("p_partkey"), "repaired")


# --- records -------------------------------------------------------------------------------------------------------------

@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT -1 - o_orderkey, 'new' FROM orders WHERE o_orderkey % 5 = 0""")
def changed_rows(spark: SparkSession, sf: str) -> Frame:
    """PR17: rows that changed or are new; null and null are the same."""
    old = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 1, F.col("o_orderstatus")).alias("o_orderstatus"))
    new = old.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    more = new.filter("o_orderkey % 5 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"))
    changed = records.changed_fields(old, new.unionByName(more), ["o_orderkey"], ["o_orderstatus"])
    return changed.join(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s")), "o_orderkey", "left").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") >= 0, F.col("s")), "o_orderstatus").alias("o_orderstatus"))


@query("""SELECT record_id FROM (SELECT l_orderkey AS record_id, bool_or(l_linenumber % 2 = 0 OR l_partkey % 3 = 0) AS m FROM lineitem GROUP BY 1) WHERE m""")
def meaningful_records(spark: SparkSession, sf: str) -> Frame:
    """PR9: a site alone is not enough for fusion."""
    n = F.col("l_linenumber")
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("record_id"), F.when(n % 2 == 0, "category").otherwise("site_id").alias("key"), F.lit("v").alias("value"))
    more = lines(spark, sf).filter("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("record_id"), F.lit("texture").alias("key"), F.lit("v").alias("value"))
    return records.meaningful(rows.unionByName(more), site_counts=False)


@query("""SELECT l_orderkey AS record_id, bool_and(l_linenumber % 4 < 2) AND bool_or(l_partkey % 3 = 0) AS sparse FROM lineitem GROUP BY 1""")
def caption_only_records(spark: SparkSession, sf: str) -> Frame:
    """PR6, PR7: only fields that a caption gives, and a cue of one."""
    n = F.col("l_linenumber")
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("record_id"), F.when(n % 4 < 2, "figure_no").otherwise("texture").alias("key"), F.lit("v").alias("value"), F.when(F.col("l_partkey") % 3 == 0, "see Fig 2").alias("quote"))
    return records.caption_only(rows, with_cue=True)


@query("""WITH r AS (SELECT l_orderkey AS record_id, bool_and(l_suppkey % 10 < 6) AS keep FROM lineitem GROUP BY 1) SELECT record_id FROM r WHERE keep""")
def restored_records(spark: SparkSession, sf: str) -> Frame:
    """PR18: to be kept a record lies on kept pages alone."""
    return _restored(spark, sf)[0].select("record_id")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_suppkey % 10 < 6 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey) AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_partkey AND s_suppkey % 10 < 6)""")
def restored_relations(spark: SparkSession, sf: str) -> Frame:
    """PR18, SC23: relations stay where both ends do."""
    return _restored(spark, sf)[1].select("id")


def _restored(spark: SparkSession, sf: str) -> tuple[Frame, Frame, Frame]:
    items = lines(spark, sf)
    own = items.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_list((F.col("l_suppkey") % 10).cast("int")).alias("source_pages"))
    relations = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), named("s", "l_suppkey").alias("source_region_id"), named("s", "l_partkey").alias("target_region_id"))
    regions = table(spark, sf, "supplier").select(named("s", "s_suppkey").alias("id"), (F.col("s_suppkey") % 10).cast("int").alias("page"))
    return evidence.restored(own, relations, regions, keep=[0, 1, 2, 3, 4, 5])


@query("""WITH c AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS r, event_type FROM events WHERE user_id % 10 = 3) SELECT event_id FROM c ORDER BY r, ts DESC, event_id DESC LIMIT 1""")
def latest_run(spark: SparkSession, sf: str) -> Frame:
    """JN24: active before verified before the newest."""
    kind = F.col("event_type")
    runs = table(spark, sf, "events").select("event_id", F.concat(F.lit("Report "), text(F.col("user_id") % 10), F.lit(".PDF")).alias("filename"), F.when(kind == "view", "paused").otherwise("completed").alias("status"), (kind == "click").alias("verified"), F.col("ts").alias("updated_at"), F.col("event_id").alias("created_at"))
    return records.latest_run(runs, "report 3").select("event_id")


@query("""WITH i AS (SELECT p_brand AS artifact_id, min(p_partkey) AS pos FROM part WHERE p_size > 25 GROUP BY 1), c AS (SELECT p_brand AS artifact_id, arg_min(p_partkey, (p_size, p_partkey)) AS record_id FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT i.artifact_id, pos, record_id FROM i JOIN c ON i.artifact_id = c.artifact_id""")
def identified_cards(spark: SparkSession, sf: str) -> Frame:
    """JN25."""
    part = table(spark, sf, "part")
    ids = part.filter("p_size > 25").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("artifact_id"))
    return records.identified(ids, part.filter("p_size <= 25").select(F.col("p_brand").alias("artifact_id"), F.col("p_partkey").alias("record_id"), F.struct("p_size", "p_partkey").alias("ord")))


@query("""SELECT p_partkey AS page, CASE WHEN p_size % 4 = 0 THEN 'document' WHEN p_size % 4 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'document' ELSE 'blank' END WHEN p_size % 4 = 2 THEN 'color_plate' ELSE 'mixed_visual' END AS page_type FROM part""")
def page_roles(spark: SparkSession, sf: str) -> Frame:
    """JN27, PR36: a blank page with text is a document; pages not discovered are documents."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pages = table(spark, sf, "part").select(F.lit("d").alias("document_id"), k.alias("page"), F.when(k % 2 == 0, "words").otherwise(" ").alias("text"))
    found = table(spark, sf, "part").filter("p_size % 4 > 0").select(F.lit("d").alias("document_id"), k.alias("page"), F.when(s % 4 == 1, "blank").when(s % 4 == 2, "color_plate").otherwise("mixed_visual").alias("page_type"))
    return records.page_roles(pages, found).select("page", "page_type")


@query("""WITH b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS o, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS t FROM conversations),
c AS (SELECT conv_id, regexp_replace(substr(text, 1, 30), '\\s+', '', 'g') AS q, conv_id * 1000 + turn AS e FROM conversations WHERE turn = 1)
SELECT c.e AS evidence_id, min(b.o)::BIGINT AS region_id FROM c JOIN b ON b.conv_id = c.conv_id AND contains(b.t, c.q) GROUP BY 1""")
def rebound_evidence(spark: SparkSession, sf: str) -> Frame:
    """JN28: cached quotes are bound to the first block of the page that holds them, white space aside."""
    rows = table(spark, sf, "conversations")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).cast("long")
    blocks = rows.select(F.col("conv_id").alias("document_id"), F.lit(1).alias("page"), order.alias("region_id"), order.alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    cached = rows.filter("turn = 1").select((F.col("conv_id") * 1000 + F.col("turn")).alias("evidence_id"), F.col("conv_id").alias("document_id"), F.lit(1).alias("page"), F.regexp_replace(F.substring("text", 1, 30), " ", "  ").alias("quote"))
    return records.rebound(cached, blocks).filter("region_id IS NOT NULL").select("evidence_id", "region_id")


@query("""WITH r AS (SELECT l_orderkey AS e, l_linenumber AS o, CASE WHEN l_partkey % 3 = 0 THEN 'c' || l_linenumber END AS crop FROM lineitem), f AS (SELECT e, arg_min(crop, o) AS crop FROM r WHERE crop IS NOT NULL GROUP BY 1)
SELECT r.e AS entity_id, r.o AS ord, coalesce(r.crop, f.crop) AS crop FROM r LEFT JOIN f ON r.e = f.e""")
def hydrated_crops(spark: SparkSession, sf: str) -> Frame:
    """JN29: a crop is borrowed from the first sibling that has one."""
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_partkey") % 3 == 0, named("c", "l_linenumber")).alias("crop"))
    return records.hydrated(rows, ["crop"])


@query("""SELECT o_orderkey AS job_id, coalesce(c_name, '') AS filename FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 ORDER BY o_orderkey DESC LIMIT 50""")
def recent_jobs(spark: SparkSession, sf: str) -> Frame:
    """JN31."""
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("created_at"))
    return records.jobs_with_names(jobs, table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename")), 50).select("job_id", "filename")


@query("""SELECT DISTINCT p FROM (SELECT p_partkey % 500 AS p FROM part WHERE p_size % 7 = 0 UNION ALL SELECT s_suppkey % 500 FROM supplier WHERE s_nationkey = 3)""")
def color_pages(spark: SparkSession, sf: str) -> Frame:
    """JN34, PR35."""
    d = F.lit("d").alias("document_id")
    pages = table(spark, sf, "part").select(d, (F.col("p_partkey") % 500).alias("page"), F.when(F.col("p_size") % 7 == 0, "color_plate").otherwise("document").alias("page_type"))
    regions = table(spark, sf, "supplier").select(d, (F.col("s_suppkey") % 500).alias("page"), F.when(F.col("s_nationkey") == 3, "color_plate").otherwise("artifact").alias("kind"))
    return records.color_pages(pages, regions).select(F.col("page").alias("p"))


@query("""SELECT c_custkey AS dataset_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0) AND c_custkey % 10 <> 1""")
def deletable_datasets(spark: SparkSession, sf: str) -> Frame:
    """JN36."""
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_id"))
    return records.deletable(own, table(spark, sf, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("dataset_id")), own.filter("dataset_id % 10 = 1"))


@query("""WITH o AS (SELECT p_size AS page, p_partkey % 30 AS place, count(*) AS n, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), n AS (SELECT p_size AS page, p_partkey % 30 AS place, count(*) AS n, min(p_partkey) AS k FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2)
SELECT n.k AS new_id, 'c' || o.k AS crop FROM n JOIN o ON n.page = o.page AND n.place = o.place WHERE n.n = 1 AND o.n = 1""")
def crop_repair(spark: SparkSession, sf: str) -> Frame:
    """SC20: places that are not unique in either run are left alone."""
    k = F.col("p_partkey")
    l = k % 30 / 64.0
    part = table(spark, sf, "part").select(k, F.col("p_size").alias("page"), F.lit("artifact").alias("kind"), g.box(l, l, l + 0.25, l + 0.25).alias("bbox"))
    moved = g.box(F.col("bbox.l") + 1e-9, F.col("bbox.t"), F.col("bbox.r"), F.col("bbox.b")).alias("bbox")
    return records.crop_repair(part.filter(k % 2 == 0).select("page", "kind", "bbox", named("c", k).alias("crop")), part.filter(k % 3 == 0).select("page", "kind", moved, k.alias("id")))


@query("""SELECT 'reg_j' || (p_partkey % 7) || '_' || p_size || '_' || i AS id, 'text' AS kind FROM part, (SELECT unnest([0, 2]) AS i) WHERE p_partkey % 3 = 0""")
def text_regions(spark: SparkSession, sf: str) -> Frame:
    """SC22: places count the block without a valid box, which gets no region."""
    good, bad = g.box(*map(F.lit, (0.1, 0.1, 0.2, 0.2))), g.box(*map(F.lit, (0.2, 0.1, 0.1, 0.2)))
    blocks = F.array(*(F.struct(F.lit("t").alias("text"), b.alias("bbox")) for b in (good, bad, good)))
    pages = table(spark, sf, "part").filter("p_partkey % 3 = 0").select(named("j", F.col("p_partkey") % 7).alias("job_id"), F.col("p_size").alias("page"), blocks.alias("blocks"))
    return records.text_regions(pages).select("id", "kind")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'ocr' WHEN p_size % 3 = 1 THEN 'own' ELSE '' END AS text, p_size % 3 = 2 AS needs_ocr FROM part""")
def page_texts(spark: SparkSession, sf: str) -> Frame:
    """SC25: the file's text, else OCR's."""
    s = F.col("p_size") % 3
    pages = table(spark, sf, "part").select("p_partkey", F.when(s == 0, "ocr").when(s == 1, "other").otherwise(" ").alias("ocr_text"), F.when(s == 1, "own").alias("pdf_text"))
    return records.page_text(pages, "fallback").select("p_partkey", "text", "needs_ocr")


@query("""SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey < 15 THEN 'built' || n_nationkey ELSE 'mine' || n_nationkey END AS label, CASE WHEN n_nationkey BETWEEN 5 AND 14 AND n_nationkey % 2 = 0 THEN 'saved' WHEN n_nationkey < 15 THEN 'default' ELSE CASE WHEN n_nationkey % 2 = 0 THEN 'saved' END END AS instruction FROM nation""")
def replaced_fields(spark: SparkSession, sf: str) -> Frame:
    """SC34: built-in fields are refreshed, saved instructions win, the user's own fields stay."""
    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation")
    saved = rows.filter("n_nationkey >= 5").select(named("k", k).alias("key"), k.alias("ord"), F.when(k % 2 == 0, "saved").alias("instruction"), named("mine", k).alias("label"))
    built = rows.filter("n_nationkey < 15").select(named("k", k).alias("key"), k.alias("ord"), F.lit("default").alias("instruction"), named("built", k).alias("label"))
    return records.replaced_fields(saved, built).select("key", "label", "instruction")


@query("""SELECT p_partkey // 20 AS page, p_partkey AS label_id, p_partkey + 1 AS number_id FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 20 < 19 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey + 1)""")
def label_numbers(spark: SparkSession, sf: str) -> Frame:
    """GE15: each label's number stands right below it."""
    k = F.col("p_partkey")
    l = k % 20 / 32.0
    at = lambda rows, shift, top: rows.select(F.lit("j").alias("job_id"), F.floor(k / 20).alias("page"), k.alias("id"), g.box(l - shift, F.lit(top), l - shift + 0.02, F.lit(top + 0.05)).alias("bbox"))
    part = table(spark, sf, "part")
    return records.label_numbers(at(part.filter(k % 4 == 0), 0.0, 0.1), at(part.filter(k % 4 == 1), 1 / 32, 0.2)).select("page", "label_id", "number_id")


@query("""SELECT p_size AS page, p_partkey % 9 AS plate_no, p_partkey % 4 AS item_no, CASE WHEN bool_or(p_partkey % 2 = 0) THEN 0 ELSE 1 END AS rank FROM part GROUP BY 1, 2, 3""")
def plate_anchors(spark: SparkSession, sf: str) -> Frame:
    """GE16: named by a record, or by a caption."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.lit("j").alias("job_id"), F.col("p_size").alias("page"), (k % 9).alias("plate_no"), (k % 4).alias("item_no"), k)
    return records.plate_anchors(rows.filter(k % 2 == 0).drop("p_partkey"), rows.filter(k % 2 != 0).drop("p_partkey")).select("page", "plate_no", "item_no", "rank")


# --- evaluation, fusion, evidence ----------------------------------------------------------------------------------------

@query("""WITH own AS (SELECT l_orderkey AS record_id, l_suppkey AS region, l_linenumber::BIGINT AS rank FROM lineitem WHERE l_linenumber % 2 = 0), via AS (SELECT l_orderkey, l_suppkey AS region, 1000 + l_linenumber * 2 AS rank FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT l_orderkey, l_partkey, 1001 + l_linenumber * 2 FROM lineitem WHERE l_linenumber % 2 = 1),
a AS (SELECT * FROM own UNION ALL SELECT * FROM via) SELECT record_id, 'r' || arg_min(region, rank) AS region_id FROM a WHERE region % 5 = 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = region) GROUP BY 1""")
def plates_of_records(spark: SparkSession, sf: str) -> Frame:
    """JN3: own regions before the ends of relations, the first hit wins."""
    n = F.col("l_linenumber")
    items = lines(spark, sf)
    ident = F.concat_ws("-", text("l_orderkey"), text("l_linenumber"))
    ordered = lambda cond, value: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(n.alias("n"), value.alias("v"))))), lambda x: x["v"])
    own = items.groupBy(F.col("l_orderkey").alias("record_id")).agg(ordered(n % 2 == 0, named("r", "l_suppkey")).alias("region_ids"), ordered(n % 2 == 1, ident).alias("relation_ids"))
    relations = items.filter(n % 2 == 1).select(ident.alias("id"), named("r", "l_suppkey").alias("source_region_id"), named("r", "l_partkey").alias("target_region_id"))
    regions = table(spark, sf, "supplier").select(named("r", "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 == 0, "color_plate").otherwise("artifact").alias("kind"))
    return evaluate.plate_of_records(own, relations, regions)


@query("""WITH e AS (SELECT l_orderkey AS record_id, l_suppkey AS r FROM lineitem UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1)
SELECT record_id, count(DISTINCT r)::BIGINT AS regions, list_sort(list_distinct(list(CASE s_nationkey % 3 WHEN 0 THEN 'artifact' WHEN 1 THEN 'caption' ELSE 'number' END))) AS kinds FROM e JOIN supplier ON s_suppkey = r GROUP BY 1""")
def region_kinds(spark: SparkSession, sf: str) -> Frame:
    """JN5, PR42."""
    items = lines(spark, sf)
    own = items.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_list(named("r", "l_suppkey")).alias("region_ids"), F.collect_list(F.when(F.col("l_linenumber") == 1, text("l_orderkey"))).alias("relation_ids"))
    relations = items.filter("l_linenumber = 1").select(text("l_orderkey").alias("id"), named("r", "l_suppkey").alias("source_region_id"), named("r", "l_partkey").alias("target_region_id"))
    k = F.col("s_nationkey") % 3
    regions = table(spark, sf, "supplier").select(named("r", "s_suppkey").alias("id"), F.when(k == 0, "artifact").when(k == 1, "caption").otherwise("number").alias("kind"))
    return evaluate.region_kinds(own, relations, regions).select("record_id", F.size("region_ids").cast("long").alias("regions"), "kinds")


@query("""SELECT l_returnflag AS key, count(*)::BIGINT AS evaluated, count(*) FILTER (l_partkey % 3 = 0)::BIGINT AS present, avg((l_partkey % 3 = 0)::INTEGER)::DOUBLE AS rate FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1""")
def relation_presence(spark: SparkSession, sf: str) -> Frame:
    """AG4."""
    return evaluate.relation_presence(lines(spark, sf).select(F.col("l_returnflag").alias("key"), (F.col("l_linenumber") <= 3).alias("labelled"), (F.col("l_partkey") % 3 == 0).alias("present")))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '''=' || o_orderkey ELSE o_orderpriority END AS cell FROM orders""")
def guarded_export(spark: SparkSession, sf: str) -> Frame:
    """SC16."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", named("=", "o_orderkey")).otherwise(F.col("o_orderpriority")).alias("cell"))
    return evaluate.export(rows, "o_orderkey")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey % 4 DESC, least(c_custkey % 300, 200) DESC, c_custkey % 50, c_custkey) AS n, count(*) FILTER (true) OVER (PARTITION BY c_nationkey, c_mktsegment) AS m FROM customer WHERE c_custkey % 4 > 0 OR c_custkey % 300 >= 24)
SELECT c_nationkey AS job_id, c_mktsegment AS artifact_id, c_custkey % 4 AS signals, least(c_custkey % 300, 200)::BIGINT AS n, c_custkey % 50 AS page FROM b WHERE n = 1""")
def recovered_orphans(spark: SparkSession, sf: str) -> Frame:
    """JN18."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("job_id"), F.col("c_mktsegment").alias("artifact_id"), k.alias("region_id"), (k % 50).alias("page"), (k % 4).alias("signals"), F.repeat(F.lit("x"), (k % 300).cast("int")).alias("text"))
    best = fuse.recover_orphans(rows.select("job_id", "artifact_id").distinct(), rows)
    return best.join(rows, ["job_id", "artifact_id", "region_id"]).select("job_id", "artifact_id", "signals", F.least(F.length("text"), F.lit(200)).cast("long").alias("n"), "page")


@query("""WITH r AS (SELECT l_orderkey AS record_id, l_linenumber AS ord, l_partkey % 4 AS p, 0.55 * (l_suppkey % 8) / 8.0 + 0.45 * (l_quantity::INTEGER % 8) / 8.0 AS s FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY p DESC, s DESC, ord) AS k FROM r) SELECT record_id, ord FROM n WHERE k = 1""")
def caption_anchors(spark: SparkSession, sf: str) -> Frame:
    """GR6."""
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 4).alias("priority"), (F.col("l_suppkey") % 8 / 8.0).alias("caption_score"), (F.col("l_quantity").cast("int") % 8 / 8.0).alias("item_score"))
    return fuse.caption_anchor(rows).select("record_id", "ord")


@query("""SELECT l_orderkey AS record_id, l_linenumber FROM lineitem l WHERE l_partkey % 3 = 0 OR NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_partkey % 3 = 0)""")
def near_exact(spark: SparkSession, sf: str) -> Frame:
    """GR7."""
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("record_id"), "l_linenumber", (F.col("l_partkey") % 3 == 0).alias("near_exact"))
    return fuse.prefer_near_exact(rows).select("record_id", "l_linenumber")


@query("""SELECT l_orderkey AS record_id, l_partkey AS region_id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 2 = 0 WHERE p_partkey IS NULL OR p_partkey % 5 = l_orderkey % 5""")
def pruned_evidence(spark: SparkSession, sf: str) -> Frame:
    """GR8: what another object owns goes."""
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("region_id"), (F.col("l_orderkey") % 5).alias("artifact_id"))
    owners = table(spark, sf, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("region_id"), (F.col("p_partkey") % 5).alias("owner_artifact_id"))
    return fuse.prune_foreign(rows, owners).select("record_id", "region_id")


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 1000 = 1 AS hit FROM orders) SELECT id::VARCHAR AS id, CASE WHEN id = (SELECT min(o_orderkey) FROM orders) THEN 'rejected' ELSE 'accepted' END AS review_status, CASE WHEN id = (SELECT min(o_orderkey) FROM orders) THEN 'new' END AS superseded_by FROM x
UNION ALL SELECT 'new', 'accepted', NULL""")
def superseded_links(spark: SparkSession, sf: str) -> Frame:
    """GR11, SS19."""
    orders = table(spark, sf, "orders")
    first = orders.agg(F.min("o_orderkey").alias("m")).first()[0]
    links = orders.select(text("o_orderkey").alias("id"), F.lit("t").alias("target_region_id"), F.lit("accepted").alias("review_status"), F.lit("ocr").alias("method"), *(F.lit(None).cast("string").alias(c) for c in ("superseded_by", "supersedes", "reviewer")))
    return rematch.supersede(links, str(first), "other", "new", "me").select("id", "review_status", "superseded_by")


@query("""SELECT o_orderkey AS record_id, o_custkey % 2 = 0 AND o_orderkey % 3 = 0 AS protected, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS links FROM orders""")
def guarded_records(spark: SparkSession, sf: str) -> Frame:
    """JN33: records a human passed keep their links unless their signature changed."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    now = orders.select(k.alias("record_id"), F.when(F.col("o_custkey") % 2 == 0, "passed").otherwise("failed").alias("human"), F.lit("s").alias("signature"), F.lit("new").alias("links"))
    base = orders.select(k.alias("record_id"), F.when(k % 3 == 0, "s").otherwise("x").alias("signature"), F.lit("old").alias("links"))
    return rematch.guarded_records(now, base, ["links"]).select("record_id", "protected", "links")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_suppkey % 10 = 4 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey) OR l_partkey % 10 = 4 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_partkey)""")
def page_relations(spark: SparkSession, sf: str) -> Frame:
    """SC19: either end on the page, each relation once."""
    relations = lines(spark, sf).select(F.lit("j").alias("job_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("source_region_id"), F.col("l_partkey").alias("target_region_id"))
    regions = table(spark, sf, "supplier").select(F.lit("j").alias("job_id"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10).alias("page"))
    return evidence.page_relations(relations, regions, 4).select("id")


@query("""SELECT DISTINCT o2.o_orderkey AS record_id FROM orders o1 JOIN orders o2 ON o1.o_custkey = o2.o_custkey WHERE o1.o_orderkey % 50 = 1""")
def evidence_context(spark: SparkSession, sf: str) -> Frame:
    """JN20: records asked for and their entity's siblings."""
    none = F.array().cast("array<bigint>")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("entity_id"), none.alias("region_ids"), none.alias("relation_ids"))
    relations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("source_region_id"), F.col("n_nationkey").alias("target_region_id"))
    return evidence.context(rows.filter("record_id % 50 = 1").select("record_id"), rows, relations, relations.select("id"))["records"].select("record_id")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS r FROM lineitem WHERE l_linenumber = 1), s AS (SELECT l_partkey AS region_id, 'evidence' AS origin FROM lineitem WHERE l_linenumber = 1)
SELECT * FROM s UNION ALL SELECT p_partkey, 'unreferenced' FROM part WHERE p_size % 2 = 0 AND p_partkey NOT IN (SELECT r FROM e)""")
def preview_annotations(spark: SparkSession, sf: str) -> Frame:
    """UX8: evidence boxes, and pictures nobody refers to."""
    box = g.box(*map(F.lit, (0.1, 0.1, 0.2, 0.2))).alias("bbox")
    regions = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(1).alias("page"), F.when(F.col("p_size") % 2 == 0, "artifact").otherwise("text").alias("kind"), box)
    rows = lines(spark, sf).filter("l_linenumber = 1").select(F.col("l_partkey").alias("region_id"), F.lit(1).alias("page"), box)
    return evidence.annotations(rows, regions).select("region_id", "origin")


@query("""SELECT s_suppkey AS key, s_suppkey % 7 AS n FROM supplier WHERE s_suppkey % 3 = 0""")
def in_order(spark: SparkSession, sf: str) -> Frame:
    """JN10, SC32: rows of an id list; ids without a row are dropped."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 7).alias("n"))
    ids = rows.filter("key % 3 = 0").select("key", (-F.col("key")).alias("pos")).unionByName(rows.select((-1 - F.col("key")).alias("key"), F.lit(0).cast("long").alias("pos")))
    return catalog.in_order_of(rows, ids, "key").select("key", "n")


@query("""SELECT lower(l_returnflag || l_linestatus) || CASE WHEN l_linenumber % 2 = 0 THEN '1' ELSE '2' END AS title, min(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END)::INTEGER AS part FROM lineitem GROUP BY 1""")
def effective_rules(spark: SparkSession, sf: str) -> Frame:
    """VR3: baseline rules, then selected ones, each once whatever their case."""
    n = F.col("l_linenumber")
    rows = lines(spark, sf).select(F.concat("l_returnflag", "l_linestatus", F.when(n % 2 == 0, "1").otherwise("2")).alias("title"), F.lit("Same").alias("description"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    base = rows.filter(F.col("title").endswith("1"))
    selected = rows.select(F.lower("title").alias("title"), F.upper("description").alias("description"), "ord")
    return verify.effective_rules(base, selected).select(F.lower("title").alias("title"), "part")


@query("""WITH p AS (SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'uncertain' END AS v, sha256('5:' || doc_id) AS h FROM documents WHERE n_chars % 3 <> 1 OR doc_id < 4),
a AS (SELECT *, row_number() OVER (ORDER BY h) AS n FROM p WHERE v = 'passed'), b AS (SELECT *, row_number() OVER (ORDER BY h) AS n FROM p WHERE v <> 'passed'),
u AS (SELECT *, n > 9 AS extra FROM a UNION ALL SELECT *, n > 9 FROM b) SELECT doc_id AS record_id FROM (SELECT * FROM u ORDER BY extra, n, h LIMIT 18)""")
def machine_sample(spark: SparkSession, sf: str) -> Frame:
    """SM2: half passed, half not, each pool lending what the other lacks."""
    n = F.col("n_chars") % 3
    rows = table(spark, sf, "documents").filter("n_chars % 3 <> 1 OR doc_id < 4").select(F.col("doc_id").alias("record_id"), F.when(n == 0, "passed").when(n == 1, "failed").otherwise("uncertain").alias("label"))
    return verify.balanced_sample(rows, 18, 5, borrow=True, first="passed").select("record_id")


@query("""WITH m AS (SELECT key, avg(s) AS mean_score FROM (SELECT l_returnflag || l_linestatus AS key, CASE WHEN l_returnflag || l_linestatus = 'RF' THEN NULL ELSE (l_partkey % 8) / 8.0 END AS s FROM lineitem) GROUP BY 1) SELECT key, row_number() OVER (ORDER BY coalesce(mean_score, 1.0), key)::INTEGER AS place FROM m""")
def weakest_fields(spark: SparkSession, sf: str) -> Frame:
    """SO8, SO6: null counts as perfect."""
    rows = lines(spark, sf).select(F.concat("l_returnflag", "l_linestatus").alias("key"), F.when(F.concat("l_returnflag", "l_linestatus") != "RF", F.col("l_partkey") % 8 / 8.0).alias("s")).groupBy("key").agg(F.avg("s").alias("mean_score"))
    ordered = catalog.weakest(rows)
    return ordered.select("key", F.row_number().over(Window.orderBy(F.coalesce("mean_score", F.lit(1.0)), "key")).alias("place"))  # a row per field


# --- index, extraction, state --------------------------------------------------------------------------------------------

@query("""WITH r AS (SELECT p_size AS page, count(*) FILTER (p_partkey % 3 = 0) AS entries, count(*) FILTER (p_partkey % 3 = 1) AS locators, count(*) FILTER (p_partkey % 97 = 0) AS visuals, bool_or(p_partkey % 211 = 0) AS title FROM part GROUP BY 1)
SELECT page FROM r WHERE title OR entries >= 6 AND locators >= 3 AND visuals = 0""")
def index_pages_by_region(spark: SparkSession, sf: str) -> Frame:
    """PR3, PR1."""
    k = F.col("p_partkey")
    said = F.when(k % 211 == 0, "图 版 目 录").when(k % 3 == 0, "图一 罐").when(k % 3 == 1, "… 12").otherwise("words")
    left = F.when(k % 3 == 1, 0.8).otherwise(0.1)
    rows = table(spark, sf, "part").select(F.lit("d").alias("document_id"), F.col("p_size").alias("page"), F.when(k % 97 == 0, "artifact").otherwise("text").alias("kind"), said.alias("text"), g.box(left, F.lit(0.1), left + 0.1, F.lit(0.2)).alias("bbox"))
    return index.index_pages(rows).select("page")


@query("""WITH c AS (SELECT p_partkey // 50 AS identity, 'k' || (p_partkey % 5) AS key, 'v' || (p_size % 4) AS value, p_partkey % 7 = 0 AS gr, p_partkey % 3 AS ev, p_partkey % 2 AS lo FROM part),
v AS (SELECT identity, key, value, bool_or(gr) AS gr, sum(ev) AS ev, sum(lo) AS lo FROM c GROUP BY 1, 2, 3)
SELECT identity::BIGINT AS identity, key, arg_max(value, (gr, ev, lo, length(value), value)) AS value, list_sort(list(value)) AS candidates, CASE WHEN count(*) > 1 THEN 'needs_review' ELSE 'valid' END AS status FROM v GROUP BY 1, 2""")
def merged_fields(spark: SparkSession, sf: str) -> Frame:
    """AG19, AG24, SF37: the best candidate, and all of them."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.floor(k / 50).alias("identity"), named("k", k % 5).alias("key"), named("v", F.col("p_size") % 4).alias("value"), (k % 7 == 0).alias("grounded"), (k % 3).alias("evidence_count"), (k % 2).alias("locator_count"))
    return extraction.merged_fields(rows)


@query("""SELECT p_partkey FROM part WHERE p_size % 5 NOT IN (0, 1, 2) AND p_partkey % 2 = 0""")
def eligible_pages(spark: SparkSession, sf: str) -> Frame:
    """PR20."""
    s = F.col("p_size") % 5
    pages = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "ready").otherwise("failed").alias("status"), (s == 0).alias("needs_ocr"), F.when(s == 1, True).alias("discovery_only"), F.lit(None).cast("boolean").alias("reference_index"), F.when(s == 2, False).alias("semantic_text_source"))
    return extraction.eligible(pages).select("p_partkey")


@query("""SELECT doc_id::VARCHAR AS document_id, true AS fits, CASE WHEN max(length(line)) <= 5000 THEN count(*) END::BIGINT AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def packed_segments(spark: SparkSession, sf: str) -> Frame:
    """ML4, ML5, ML8: no chunk is above the limit, and without overlap the chunks hold all lines in order (longer ones are halved)."""
    rows = table(spark, sf, "documents").select(text("doc_id").alias("document_id"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    longest = rows.groupBy("document_id").agg(F.max(F.length("text")).alias("longest"))
    chunks = extraction.packed_segments(rows, most_chars=5000, most_records=7, overlap=0)
    own = chunks.groupBy("document_id").agg(F.bool_and(F.length("text") <= 5000).alias("fits"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda c: c["text"]), "\n").alias("all"))
    return own.join(longest, "document_id").select("document_id", "fits", F.when(F.col("longest") <= 5000, F.size(F.split("all", "\n")).cast("long")).alias("lines"))


@query("""SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY""")
def retained_events(spark: SparkSession, sf: str) -> Frame:
    """SS8."""
    rows = table(spark, sf, "events")
    now = rows.agg(F.max("ts").alias("__now"))
    return state.retained(rows.crossJoin(now), "ts", F.col("__now"), 5).select("event_id")  # one row


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'restarted' END AS error FROM orders""")
def stale_runs(spark: SparkSession, sf: str) -> Frame:
    """SS10."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return state.stale(table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.lit(None).cast("string").alias("error")), "restarted")


# --- sources and sinks -----------------------------------------------------------------------------------------------------

@query("""WITH w AS (SELECT l_suppkey AS page, l_orderkey AS line, l_linenumber AS n, l_returnflag || l_linestatus AS t, (l_linenumber * 10)::DOUBLE AS x FROM lineitem WHERE l_quantity >= 25)
SELECT page::INTEGER AS page, string_agg(t, ' ' ORDER BY n) AS text, (min(x) / 128.0)::DOUBLE AS l, (max(x + 8) / 128.0)::DOUBLE AS r FROM w GROUP BY page, line""")
def ocr_lines(spark: SparkSession, sf: str) -> Frame:
    """SC3, SC27, AG21: words written as an OCR table and read back as lines."""
    n = F.col("l_linenumber")
    words = lines(spark, sf).select(F.lit(5).alias("level"), F.col("l_suppkey").alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.col("l_orderkey").alias("line_num"), n.alias("word_num"), (n * 10).alias("left"), F.lit(5).alias("top"), F.lit(8).alias("width"), F.lit(4).alias("height"), (F.col("l_quantity") * 2).alias("conf"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    path = shared_folder(spark, "ocr")
    words.write.csv(path, sep="\t", header=True, quote="")
    return files.ocr_lines(spark, path, 128, 64).select("page", "text", F.col("bbox.l").alias("l"), F.col("bbox.r").alias("r"))


@query("""SELECT (p_partkey % 50)::INTEGER AS page, CASE p_partkey % 3 WHEN 0 THEN 'artifact' WHEN 1 THEN 'number' ELSE 'caption' END AS kind, count(*)::BIGINT AS n FROM part GROUP BY 1, 2""")
def detector_rows(spark: SparkSession, sf: str) -> Frame:
    """SC5: predictions written as JSON lines and read back."""
    k = F.col("p_partkey")
    one = F.struct(F.when(k % 3 == 0, "artifact").when(k % 3 == 1, "number").otherwise("caption").alias("kind"), F.array(*map(F.lit, (0.1, 0.1, 0.5, 0.5))).alias("bbox"), F.lit(0.9).alias("confidence"))
    path = shared_folder(spark, "detector")
    table(spark, sf, "part").groupBy((k % 50).cast("int").alias("page")).agg(F.collect_list(one).alias("predictions")).write.json(path)
    return files.detections(spark, path).groupBy("page", "kind").agg(F.count("*").alias("n"))


@query("""SELECT 'K' || (c_custkey % 30) || ',' || c_nationkey AS canonical_artifact_id, count(*)::BIGINT AS n, any_value(m)::BIGINT AS duplicate_key_count FROM (SELECT *, count(*) OVER (PARTITION BY c_custkey % 30, c_nationkey) AS m FROM customer WHERE c_custkey % 11 <> 0) WHERE true GROUP BY 1""")
def human_sheet(spark: SparkSession, sf: str) -> Frame:
    """SC7, SC8, SC9: a sheet with rows that share a key, rows without one, and blank rows."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.when(k % 11 != 0, named("K", k % 30)).alias("Context"), F.when(k % 11 != 0, text("c_nationkey")).alias("Sequence"), F.when(k % 22 != 0, F.col("c_mktsegment")).alias("Note"))
    path = shared_folder(spark, "sheet")
    rows.write.csv(path, header=True)
    return files.human_sheet(spark, path, context_col="Context", sequence_col="Sequence").groupBy("canonical_artifact_id").agg(F.count("*").alias("n"), F.max("duplicate_key_count").alias("duplicate_key_count"))


@query("""SELECT DISTINCT md5(o_orderpriority || (o_custkey % 100)) AS sha256 FROM orders WHERE o_custkey % 100 >= 20""")
def first_uploads(spark: SparkSession, sf: str) -> Frame:
    """SC15, SC28: contents not stored yet, each once."""
    rows = table(spark, sf, "orders").select(F.md5(F.concat("o_orderpriority", text(F.col("o_custkey") % 100))).alias("sha256"), (F.col("o_custkey") % 100).alias("c"))
    return files.first_per_digest(rows, rows.filter("c < 20")).select("sha256")


@query("""SELECT o_orderkey, 1 AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 2 FROM orders""")
def appended_rows(spark: SparkSession, sf: str) -> Frame:
    """SC14."""
    path = shared_folder(spark, "append")
    rows = table(spark, sf, "orders").select("o_orderkey")
    state.append(rows.filter("o_orderkey % 2 = 0").withColumn("v", F.lit(1)), path)
    state.append(rows.withColumn("v", F.lit(2)), path)
    return spark.read.parquet(path)


@query("""SELECT o_orderkey, o_orderpriority AS scope, CASE WHEN o_orderpriority LIKE '1%' THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderpriority NOT LIKE '1%' OR o_orderkey % 2 = 0""")
def scope_sink(spark: SparkSession, sf: str) -> Frame:
    """SC12, SC30, SC31: a sink that replaces only the scopes it writes."""
    path = shared_folder(spark, "scope")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("scope"))
    state.write_scope(rows.withColumn("v", F.lit("old")), path, ["scope"])
    state.write_scope(rows.filter("scope LIKE '1%' AND o_orderkey % 2 = 0").withColumn("v", F.lit("new")), path, ["scope"])
    return spark.read.parquet(path).select("o_orderkey", "scope", "v")


# --- answers, lines and chunks -------------------------------------------------------------------------------------------

cases("payload_outcomes", ["string"], "VARCHAR", [
    ('{"records": []}', "read"), ('```json\n[{"a": 1}]\n```', "read"), ('{"output": "{\\"records\\": [1]}"}', "read"), ('{"output": {"output": {"records": []}}}', "read"), ("no json", "no_object"), (None, "no_object"), ('{"records": 1}', "no_records"),
    ('{"schema_version": "2", "records": []}', "other_schema"), ('{"schema_version": "1", "chunk_id": "x", "records": []}', "other_chunk"), ('{"chunk_id": "c", "records": []}', "read"),
], lambda c: reading.payload_outcome(c, F.lit("1"), F.lit("c")), "PR26.")
cases("json_objects", ["string"], "VARCHAR", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": {"b": 2}} done', '{"a": {"b": 2}}'), ("[1]", None), ("none", None), ('{"a": ', None)], reading.json_object, "PR39.")
cases("unknown_keys", ["string"], "VARCHAR[]", [('{"a": 1, "z": 2, "c": 3}', ["c", "z"]), ('{"a": 1}', []), ("{}", []), ("bad", [])], lambda c: reading.unknown_keys(c, ["a", "b"]), "PR13.")
cases("verification_compact", ["string"], "VARCHAR", [("口径 10 厘米；（残）", "口径10cm残"), ("Ａ.b，c", "abc"), (None, "")], reading.verification_compact, "PR39.")


@query("""SELECT p_partkey AS record_id, CASE WHEN p_size % 4 IN (1, 2) THEN 'v' END AS value, CASE WHEN p_size % 4 = 3 THEN 'raw' END AS raw_value, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'valid' ELSE 'missing' END WHEN p_size % 4 = 1 THEN 'valid' ELSE 'needs_review' END AS status, p_size % 4 = 0 AND p_partkey % 2 = 0 AS refused FROM part""")
def normalised_fields(spark: SparkSession, sf: str) -> Frame:
    """PR12, PR13: no value, a fine one, one without a quote, and one of another type."""
    s = F.col("p_size") % 4
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.lit("k").alias("key"), F.when(s == 3, "raw").when(s > 0, "v").alias("value"), F.lit(None).cast("string").alias("raw_value"), F.when((s > 0) | (F.col("p_partkey") % 2 == 0), "valid").alias("status"), F.when(s.isin(1, 2), "v").alias("typed"), F.when(s == 2, 0).otherwise(1).alias("grounded"))
    return reading.normalised_fields(rows).drop("key")


@query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS o FROM conversations), g AS (SELECT *, (o - 1) // 3 AS chunk FROM c)
SELECT conv_id::VARCHAR AS document_id, chunk::INTEGER AS chunk, min(turn)::INTEGER AS first_page, max(turn)::INTEGER AS last_page, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY o)) AS content_hash, list_sort(list_distinct(list('figure:' || (turn % 2)))) AS references, len(list_distinct(list(turn % 3)))::BIGINT AS ids FROM g GROUP BY 1, 2""")
def chunk_rollups(spark: SparkSession, sf: str) -> Frame:
    """AG17."""
    o = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    blocks = table(spark, sf, "conversations").withColumn("ord", o).select(text("conv_id").alias("document_id"), F.floor((F.col("ord") - 1) / 3).cast("int").alias("chunk"), "ord", F.col("turn").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.array(named("M", F.col("turn") % 3)).alias("ids"), F.array(named("figure:", F.col("turn") % 2)).alias("references"))
    return reading.chunk_rollup(blocks).select("document_id", "chunk", "first_page", "last_page", "content_hash", "references", F.size("ids").cast("long").alias("ids"))


@query("""SELECT 'd' || (p_partkey // 12) AS document_id, count(*)::BIGINT AS chunks, bool_or(m) AS inherited FROM (SELECT p_partkey, unnest(range(CASE WHEN p_partkey % 12 = 0 OR p_partkey % 12 = 6 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 12 = 4 THEN 1 ELSE 0 END)) AS i, p_partkey % 12 = 4 AS m FROM part) GROUP BY 1""")
def capped_chunks(spark: SparkSession, sf: str) -> Frame:
    """WN8, AG17, SC21: of twelve blocks the first and the seventh have ids, and the fifth outgrows the cap and inherits them."""
    k = F.col("p_partkey")
    blocks = table(spark, sf, "part").select(named("d", F.floor(k / 12)).alias("document_id"), F.lit(1).alias("page"), (k % 12).cast("int").alias("ord"), F.repeat(F.lit("x"), F.when(k % 12 < 4, 10).when(k % 12 == 4, 70).otherwise(1)).alias("text"), F.when(k % 6 == 0, F.array(named("M", k))).alias("ids"))
    chunks = index.capped_chunks(blocks, most_chars=100)
    again = Window.partitionBy("document_id").orderBy("chunk")
    return chunks.withColumn("same", F.lag("ids").over(again) == F.col("ids")).groupBy("document_id").agg(F.count("*").alias("chunks"), F.coalesce(F.bool_or("same"), F.lit(False)).alias("inherited"))


_LINES = "SELECT p_partkey AS line_id, p_partkey // 10 AS page, p_partkey % 10 AS y FROM part"


def _text_lines(spark: SparkSession, sf: str) -> Frame:
    k = F.col("p_partkey")
    y = k % 10
    said = F.when(y == 0, "M1:2 bowl (see Fig").when(y == 1, " 3, 4").when(y == 2, ") rest").when(y == 7, "M9 new entry: M3:4").otherwise("more words")
    return table(spark, sf, "part").select(F.lit("j").alias("job_id"), F.floor(k / 10).cast("int").alias("page"), k.alias("line_id"), k.alias("ord"), g.box(F.lit(0.1), y / 16.0, F.lit(0.9), y / 16.0 + 0.05).alias("bbox"), said.alias("text"), F.when(y == 0, "M1:2").when(y == 7, "M3:4").otherwise("").alias("artifact_id"))


@query(f"WITH l AS ({_LINES}) SELECT line_id, CASE WHEN y <= 5 THEN 'M1:2' ELSE 'M3:4' END AS artifact_id FROM l WHERE y <= 5 OR y >= 7")
def artifact_owners(spark: SparkSession, sf: str) -> Frame:
    """WN13, GR8: five lines go on below an object's first, up to the next object's."""
    return reading.artifact_owners(_text_lines(spark, sf)).select("line_id", "artifact_id")


@query(f"WITH l AS ({_LINES}) SELECT line_id, 'M1:2 bowl (see Fig 3, 4) rest' AS text FROM l WHERE y = 0 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = line_id + 2)")
def completed_captions(spark: SparkSession, sf: str) -> Frame:
    """PR30: lines below close what a caption opens."""
    return reading.completed_captions(_text_lines(spark, sf)).select("line_id", "text")


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 3 = 0 THEN 'own' WHEN o_orderkey % 3 = 1 THEN 'a' || o_orderkey ELSE 'b' || o_orderkey END AS region_id FROM orders WHERE o_orderkey % 3 < 2 OR o_custkey % 2 = 0""")
def primary_artifacts(spark: SparkSession, sf: str) -> Frame:
    """UX9: named, by the saved relation, or by a number that reads as the identifier."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf, "orders")
    rows = orders.select(k.alias("record_id"), F.lit(1).alias("page"), F.when(k % 3 == 0, "own").alias("primary_artifact_region_id"), F.when(k % 3 == 1, named("r", k)).alias("primary_relation_id"), named("M1:", k).alias("artifact_id"))
    region = lambda prefix, kind, ident: orders.select(named(prefix, k).alias("id"), F.lit(1).alias("page"), F.lit(kind).alias("kind"), ident.alias("artifact_id"))
    none = F.lit(None).cast("string")
    regions = region("a", "artifact", none).unionByName(region("b", "artifact", none)).unionByName(region("n", "number", named("M1:", k)))
    link = lambda prefix, target, status, score: orders.select(named(prefix, k).alias("id"), named("n", k).alias("source_region_id"), named(target, k).alias("target_region_id"), F.lit("number_of").alias("relation_type"), status.alias("review_status"), F.lit(score).alias("score"))
    relations = link("r", "a", F.lit("rejected"), 0.9).unionByName(link("s", "b", F.when(c % 2 == 0, "accepted").otherwise("rejected"), 0.5))
    return reading.primary_artifacts(rows, regions, relations)


@query("""WITH r AS (SELECT l_orderkey, bool_or(s_nationkey % 3 = 0) AND bool_or(s_nationkey % 3 <> 0) AS chain FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem)::BIGINT AS total_records, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 4 = 0)::BIGINT AS linked_records, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 4 = 1)::BIGINT AS partial_records,
       (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 4 > 1)::BIGINT AS unlinked_records, count(*) FILTER (chain)::BIGINT AS complete_chains FROM r""")
def preview_report(spark: SparkSession, sf: str) -> Frame:
    """AG13."""
    k = F.col("record_id")
    own = lines(spark, sf).groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_list("l_suppkey").alias("region_ids")).withColumn("fusion_status", F.when(k % 4 == 0, "linked").when(k % 4 == 1, "partial").otherwise("unlinked"))
    n = F.col("s_nationkey") % 3
    return rematch.preview_report(own, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(n == 0, "artifact").when(n == 1, "caption").otherwise("number").alias("kind")))


@query("""SELECT 'model_human_calibration' AS source, (SELECT count(*) FROM documents)::BIGINT AS sample_size, list('do ' || n_name ORDER BY n_nationkey) AS instructions FROM (SELECT * FROM nation WHERE n_nationkey % 2 = 1 ORDER BY n_nationkey LIMIT 12)""")
def calibration_profile(spark: SparkSession, sf: str) -> Frame:
    """ML12."""
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.lit("passed").alias("verdict"), *(F.lit(None).cast("string").alias(c) for c in ("failure_code", "failure_reason", "machine_verdict")), F.col("text").alias("machine_reason"))
    said = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.when(F.col("n_nationkey") % 2 == 1, named("do ", "n_name")).otherwise(" ").alias("text"))
    return reading.calibration_profile(reading.calibration_examples(items), said)


# --- what people filled, what linking owns -------------------------------------------------------------------------------

@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 'new' ELSE 'old' END AS v, CASE WHEN o_orderpriority LIKE '1%' AND o_orderkey % 3 = 0 THEN NULL ELSE 'human' END AS review FROM orders WHERE o_orderpriority NOT LIKE '1%' OR o_orderkey % 2 = 0""")
def kept_reviews(spark: SparkSession, sf: str) -> Frame:
    """SC30: a scope is replaced, and what people filled stays on the rows that were there."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    urgent = F.col("o_orderpriority").startswith("1")
    old = rows.filter(~urgent | (F.col("o_orderkey") % 3 != 0)).withColumns({"v": F.lit("old"), "review": F.lit("human")})
    new = rows.filter(urgent & (F.col("o_orderkey") % 2 == 0)).withColumns({"v": F.lit("new"), "review": F.lit(None).cast("string")})
    return state.replace_keeping(old, new, ["o_orderpriority"], ["o_orderkey"], ["review"])


@query("""WITH e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_linenumber <= 2), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS (SELECT 's' || s_suppkey AS seed FROM supplier WHERE s_suppkey % 5 = 0),
x AS (SELECT seed, seed AS node, 0 AS hops FROM s UNION ALL SELECT seed, b, 1 FROM s JOIN u ON seed = a UNION ALL SELECT seed, v.b, 2 FROM s JOIN u ON seed = u.a JOIN u v ON u.b = v.a) SELECT seed, node, min(hops)::INTEGER AS hops FROM x GROUP BY 1, 2""")
def typed_hops(spark: SparkSession, sf: str) -> Frame:
    """GR5: two hops over edges of given types."""
    n = F.col("l_linenumber")
    edges = lines(spark, sf).select(named("s", "l_suppkey").alias("source"), named("p", "l_partkey").alias("target"), F.when(n == 1, "contains").when(n == 2, "number_of").otherwise("other").alias("relation_type"))
    return fuse.two_hops(table(spark, sf, "supplier").filter("s_suppkey % 5 = 0").select(named("s", "s_suppkey").alias("seed")), edges, fuse.EDGES)


@query("""SELECT DISTINCT * FROM (SELECT o_orderkey AS record_id, l_orderkey * 10 + l_linenumber AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1
UNION ALL SELECT o_orderkey, l_orderkey * 10 + l_linenumber FROM orders JOIN lineitem ON l_suppkey = o_orderkey % 97 OR l_partkey = o_orderkey % 97 WHERE l_linenumber = 3 AND o_orderkey % 20 = 0)""")
def local_evidence(spark: SparkSession, sf: str) -> Frame:
    """JN21: relations a record names, and structural ones at its core pictures (every twentieth record has one)."""
    items = lines(spark, sf)
    ident = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    relations = items.select(ident.alias("id"), F.col("l_suppkey").alias("source_region_id"), F.col("l_partkey").alias("target_region_id"), F.when(F.col("l_linenumber") == 3, "number_of").otherwise("evidence_for").alias("relation_type"))
    k = F.col("o_orderkey")
    own = table(spark, sf, "orders").select(k.alias("record_id"), F.array(k * 10 + 1, -k - 1).alias("relation_ids"), F.when(k % 20 == 0, F.array(k % 97)).otherwise(F.array().cast("array<bigint>")).alias("core_ids"))
    return fuse.local_evidence(own, relations, ["number_of"])


@query("""SELECT o_custkey AS job_id, list_sort(list_distinct(list((o_orderkey % 9)::INTEGER))) AS associated_pages, arg_min('M' || o_orderkey || ':1', o_orderkey) FILTER (o_orderkey % 3 = 0) AS canonical_artifact_id FROM orders GROUP BY 1""")
def entity_columns(spark: SparkSession, sf: str) -> Frame:
    """PR27: pages and the canonical identifier of each entity."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    resolved = orders.select(F.col("o_custkey").alias("job_id"), text(k).alias("record_id"), k.alias("ord"), F.array(F.lit("artifact:m1:1")).alias("tokens"), F.lit("g").alias("group"))
    own = orders.select(F.col("o_custkey").alias("job_id"), text(k).alias("record_id"), F.array((k % 9).cast("int")).alias("pages"), F.when(k % 3 == 0, F.concat(named("m", k), F.lit(":1"))).otherwise(" ").alias("artifact_id"))
    return entity.owned_columns(resolved, own).select("job_id", "associated_pages", "canonical_artifact_id")


@query("""SELECT d.doc_id AS record_id, 'h' AS verdict, CASE WHEN quality = 1 THEN 'passed' WHEN quality = 0 THEN 'failed' END AS calibrated_machine_verdict, coalesce('r' || quality, '') AS calibrated_machine_reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def calibrated_items(spark: SparkSession, sf: str) -> Frame:
    """JN37."""
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.lit("h").alias("verdict"))
    machine = table(spark, sf, "labels").select(F.col("doc_id").alias("record_id"), F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("verdict"), F.lit(0.5).alias("confidence"), named("r", "quality").alias("reason"))
    return verify.calibrated(items, machine).drop("calibrated_machine_confidence")


@query("""WITH f AS (SELECT o_orderkey AS record_id, o_orderstatus = 'F' AS bad FROM orders) SELECT record_id, CASE WHEN bad THEN 'failed' ELSE 'passed' END AS verdict, CASE WHEN bad THEN chr(39) || '=why' ELSE '' END AS reason, CASE WHEN bad THEN 'size: too small' ELSE '' END AS failures FROM f""")
def workbook_detail(spark: SparkSession, sf: str) -> Frame:
    """SC17, PR41: the detail sheet, with a summary of each card's failures."""
    bad = F.col("o_orderstatus") == "F"
    field = lambda name, v, why: F.struct(F.lit(name).alias("field"), v.alias("verdict"), F.lit(why).alias("reason"))
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(bad, "failed").otherwise("passed").alias("verdict"), F.when(bad, "=why").alias("reason"), F.array(field("size", F.when(bad, "failed").otherwise("passed"), "too small"), field("name", F.lit("passed"), "")).alias("field_results"))
    return records.workbook(items)["detail"]


@query("""SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation WHERE n_nationkey < 8""")
def sheet_preview(spark: SparkSession, sf: str) -> Frame:
    """SC7: the header and eight rows of a sheet."""
    path = shared_folder(spark, "preview")
    table(spark, sf, "nation").select(text("n_nationkey").alias("key"), F.col("n_name").alias("name")).coalesce(1).sortWithinPartitions(F.col("key").cast("int")).write.csv(path, header=True)
    header, rows = files.sheet_preview(spark, path)
    return rows.select(*header)
