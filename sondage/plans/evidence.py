"""Queries: page index, matching, fusion, entities and evidence."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import geometry as g
from sondage.operators import entity, evaluate, evidence, fuse, index, match
from sondage.plans.adapters import REGIONS_SQL, regions
from sondage.plans.registry import query
from sondage.session import table

Frame = DataFrame

_REFS = """
pages AS (SELECT p_partkey AS page, CASE p_partkey % 4 WHEN 0 THEN 'color_plate' WHEN 1 THEN 'mixed_visual' ELSE 'document' END AS page_type,
                 list_distinct(['figure:' || (p_partkey % 50) || ':' || (p_size % 4), 'plate:' || (p_size % 10)]) AS refs FROM part),
req AS (SELECT DISTINCT unnest(['figure:' || (n_nationkey * 2), 'plate:' || n_nationkey || ':1', 'figure:' || n_nationkey || ':3']) AS r FROM nation),
p AS (SELECT page, page_type, unnest(refs) AS ref FROM pages),
met AS (SELECT p.page, p.page_type, req.r, req.r = p.ref AS exact FROM p JOIN req ON split_part(p.ref, ':', 1) = split_part(req.r, ':', 1) AND split_part(p.ref, ':', 2) = split_part(req.r, ':', 2)
        AND p.page_type <> 'document' AND (split_part(p.ref, ':', 3) = split_part(req.r, ':', 3) OR split_part(p.ref, ':', 3) = '' OR split_part(req.r, ':', 3) = ''))
"""


def _references(spark: SparkSession, sf: str) -> tuple[Frame, Frame]:
    """Requested references and page references, read out of sentences."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("see Figure "), (k % 50).cast("string"), F.lit(":"), (s % 4).cast("string"), F.lit(" and Plate "), (s % 10).cast("string"), F.lit(" here"))
    kind = F.when(k % 4 == 0, "color_plate").when(k % 4 == 1, "mixed_visual").otherwise("document")
    pages = index.references(table(spark, sf, "part").select(F.lit("d").alias("document_id"), k.alias("page"), kind.alias("page_type"), text.alias("text")), "text", normal=True).drop("text")
    n = F.col("n_nationkey")
    asked = F.array(F.concat(F.lit("figure:"), (n * 2).cast("string")), F.concat(F.lit("plate:"), n.cast("string"), F.lit(":1")), F.concat(F.lit("figure:"), n.cast("string"), F.lit(":3")))
    requested = table(spark, sf, "nation").select(F.explode(asked).alias("r")).distinct().agg(F.array_sort(F.collect_list("r")).alias("references"))  # one row of a closed list
    return requested, pages


@query(f"""WITH {_REFS}, per AS (SELECT page, page_type, r, bool_or(exact) AS exact FROM met GROUP BY 1, 2, 3)
SELECT page, (count(*) + count(*) FILTER (exact) * 0.5 + any_value(CASE page_type WHEN 'color_plate' THEN 0.35 WHEN 'mixed_visual' THEN 0.2 ELSE 0.0 END))::DOUBLE AS score FROM per GROUP BY page ORDER BY score DESC, page LIMIT 24""")
def reference_recall(spark: SparkSession, sf: str) -> Frame:
    requested, pages = _references(spark, sf)
    return index.recall(requested, pages, [], 24).select("page", F.col("score").cast("double").alias("score"))


@query(f"WITH {_REFS} SELECT r AS reference FROM req WHERE r NOT IN (SELECT r FROM met)")
def unresolved_references(spark: SparkSession, sf: str) -> Frame:
    return index.unresolved(*_references(spark, sf))


@query("""WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
SELECT user_id, run::BIGINT AS run, event_type, count(*)::BIGINT AS length, min(ts) AS first, max(ts) AS last FROM r GROUP BY 1, 2, 3""")
def page_runs(spark: SparkSession, sf: str) -> Frame:
    return index.equal_runs(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""WITH s AS (SELECT *, event_type = 'view' OR event_type = 'click' AS m, row_number() OVER w - sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER w AS island FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN m THEN count(*) FILTER (m) OVER (PARTITION BY user_id, island) ELSE 0 END::BIGINT AS run_length FROM s""")
def color_runs(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return index.promoted_runs(rows, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "click")).select("event_id", F.col("run_length").cast("long").alias("run_length"))


@query("""WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chunk FROM conversations)
SELECT conv_id, chunk::BIGINT AS chunk, min(turn) AS first, max(turn) AS last, count(*)::BIGINT AS blocks, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS content_hash FROM c GROUP BY 1, 2""")
def text_chunks(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", "role")
    return index.text_chunks(rows, "conv_id", "turn", F.col("role") == "user").drop("text")


@query("""SELECT o.o_orderkey, l.l_linenumber, abs(o.o_custkey % 9 - l.l_linenumber)::BIGINT AS distance FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
QUALIFY abs(o.o_custkey % 9 - l.l_linenumber) = min(abs(o.o_custkey % 9 - l.l_linenumber)) OVER (PARTITION BY o.o_orderkey)""")
def nearest_context(spark: SparkSession, sf: str) -> Frame:
    records = table(spark, sf, "orders").select(F.col("o_orderkey"), (F.col("o_custkey") % 9).alias("at"))
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return index.nearest_context(records, chunks, "o_orderkey", "at", "l_linenumber").select("o_orderkey", "l_linenumber", F.col("distance").cast("long").alias("distance"))


@query(r"""SELECT page_id, regexp_matches(html, '(?i)(?:list|table)\s+of\s+(?:figures|plates|illustrations)|(?:figure|plate|illustration)\s+index') OR len(regexp_extract_all(html, '<li>')) >= 8 AS is_index FROM pages""")
def reference_index_pages(spark: SparkSession, sf: str) -> Frame:
    """Pages that are mostly links stand for lists of figures: each link becomes an entry line."""
    lines = F.regexp_replace(F.regexp_replace("html", "\n", " "), "<li>", "\nFigure 1 ")
    return table(spark, sf, "pages").select("page_id", index.is_index_text(lines, longest=100_000).alias("is_index"))


_FEATURES = """
f AS (SELECT p_partkey AS page, p_size * 20 AS text_length, p_partkey % 3 = 0 AS plate, p_partkey % 5 = 0 AS figure, p_partkey % 2 AS images, (p_size % 10) / 64.0 AS color, (p_size % 7) / 32.0 AS foreground, (p_partkey % 11) / 64.0 AS tile,
             (p_partkey % 40)::DOUBLE AS chroma, (p_partkey % 9) / 512.0 AS dark, (p_partkey % 13) / 256.0 AS edge FROM part),
c AS (SELECT *, color >= 0.035 AND (tile >= 0.08 OR foreground >= 0.1 OR chroma >= 27.0) AS chromatic FROM f)
"""


@query(f"""WITH {_FEATURES} SELECT page, CASE WHEN chromatic AND plate THEN 'color_plate' WHEN chromatic AND text_length >= 500 THEN 'mixed_visual' WHEN chromatic THEN 'color_visual' WHEN plate AND images > 0 THEN 'mixed_visual'
 WHEN figure AND (images > 0 OR (text_length <= 400 AND edge >= 0.025)) THEN 'mixed_visual' WHEN images > 0 AND text_length = 0 AND dark >= 0.004 THEN 'monochrome_visual' WHEN dark >= 0.004 AND edge >= 0.018 THEN 'monochrome_visual'
 WHEN text_length = 0 AND dark < 0.004 THEN 'blank' ELSE 'document' END AS page_type FROM c""")
def page_classes(spark: SparkSession, sf: str) -> Frame:
    k, s = F.col("p_partkey"), F.col("p_size")
    features = {"text_length": s * 20, "plate": k % 3 == 0, "figure": k % 5 == 0, "images": k % 2, "color": s % 10 / 64.0, "foreground": s % 7 / 32.0, "tile": k % 11 / 64.0, "chroma": (k % 40).cast("double"), "dark": k % 9 / 512.0, "edge": k % 13 / 256.0}
    return table(spark, sf, "part").select(k.alias("page"), index.page_class(features)["page_type"].alias("page_type"))


@query()
def page_matcher(spark: SparkSession, sf: str) -> Frame:
    """Optimal assignment is no SQL; tests hold it against all assignments of small pages."""
    return match.match_pages(regions(spark, sf)).drop("job_id")


@query(f"""WITH {REGIONS_SQL}, pairs AS (SELECT x.page, x.id AS region_id, y.id AS group_id, y.ord AS go, greatest(0.0::DOUBLE, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0.0::DOUBLE, least(x.b, y.b) - greatest(x.t, y.t)) / ((x.r - x.l) * (x.b - x.t)) AS score
 FROM regions x JOIN regions y ON x.page = y.page AND y.kind = 'group' AND x.kind IN ('number', 'caption', 'artifact')),
b AS (SELECT *, row_number() OVER (PARTITION BY page, region_id ORDER BY score DESC, go) AS n FROM pairs)
SELECT page, region_id, group_id, round(score, 9) AS score FROM b WHERE n = 1 AND score >= 0.5""")
def containment_groups(spark: SparkSession, sf: str) -> Frame:
    return match.best_groups(regions(spark, sf)).select("page", "region_id", "group_id", F.round("score", 9).alias("score"))


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS k, 'a' || (o_orderkey // 4) AS t FROM orders UNION ALL SELECT o_orderkey, 'b' || ((o_orderkey + 2) // 7) FROM orders),
e AS (SELECT DISTINCT x.k AS a, y.k AS b FROM t x JOIN t y ON x.t = y.t), r AS (SELECT k, k AS root FROM (SELECT DISTINCT k FROM t) UNION SELECT r.k, e.b FROM r JOIN e ON r.root = e.a)
SELECT k AS o_orderkey, min(root) AS root FROM r GROUP BY k""")
def entity_components(spark: SparkSession, sf: str) -> Frame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k, F.explode(F.array(F.floor(k / 4), F.floor((k + 2) / 7) + (1 << 40))).alias("token"))
    # a node is a record (its key) or a token (negative), so records are the larger ends
    links = rows.select(k.alias("a"), (-F.col("token") - 1).alias("b"))
    roots = entity.components(links)
    named = roots.filter("node >= 0").select(F.col("node").alias("o_orderkey"), F.col("root").alias("part"))
    first = named.groupBy("part").agg(F.min("o_orderkey").alias("root"))
    return named.join(first, "part").select("o_orderkey", "root")


def entity_records(spark: SparkSession, sf: str) -> Frame:
    """Customers are records; some name an artifact, all point to a figure item that several share."""
    k = F.col("c_custkey")
    ids = F.array(F.when(k % 3 != 0, F.concat(F.lit("M"), (k % 40 + 1).cast("string"), F.lit(":"), F.floor(k / 40).cast("string"))).otherwise(""))
    return table(spark, sf, "customer").select(F.concat(F.lit("job"), F.col("c_nationkey").cast("string")).alias("job_id"), F.concat(F.lit("rec"), k.cast("string")).alias("record_id"), k.cast("long").alias("ord"), entity.record_tokens(ids, F.floor(k / 100).cast("string"), (k % 7).cast("string"), F.lit(""), F.lit(""), normal=True).alias("tokens"))


@query()
def entity_resolution(spark: SparkSession, sf: str) -> Frame:
    """Both phases; records without a name attach to one that has. Tests hold the result against brute force over whole jobs."""
    return entity.entities(entity.resolve(entity_records(spark, sf))).select("job_id", "entity_id", "match_keys", "record_ids", "confidence", "link_status")


@query("""WITH e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
s AS (SELECT 'r' || r_regionkey AS seed FROM region), x AS (SELECT seed, seed AS node, 0 AS hops FROM s UNION ALL SELECT s.seed, u.b, 1 FROM s JOIN u ON s.seed = u.a UNION ALL SELECT s.seed, v.b, 2 FROM s JOIN u ON s.seed = u.a JOIN u v ON u.b = v.a)
SELECT seed, node, min(hops)::INTEGER AS hops FROM x GROUP BY 1, 2""")
def two_hop_graph(spark: SparkSession, sf: str) -> Frame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "nation").select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target")).unionByName(table(spark, sf, "customer").select(name("n", "c_nationkey").alias("source"), name("c", "c_custkey").alias("target")))
    return fuse.two_hops(table(spark, sf, "region").select(name("r", "r_regionkey").alias("seed")), edges)


_WORDS = ["AUTOMOBILE", "BUILD", "MACHINERY", "HOUSEHOLD", "xy"]


def _fuzzy(a: str, b: str) -> float:
    """What the score of two texts must be: equal, contained, or the matching blocks' share."""
    return 1.0 if a == b else 0.94 if min(len(a), len(b)) >= 3 and (a in b or b in a) else SequenceMatcher(None, a, b).ratio()


_FUZZY = "CASE hint || '|' || text " + " ".join(f"WHEN '{a}|{b}' THEN {_fuzzy(a, b)!r}::DOUBLE" for a in ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"] for b in _WORDS) + " END"
_HINTS = f"""
h AS (SELECT 'd' || (c_custkey % 20) AS job_id, c_custkey AS record_id, (c_custkey // 20 % 60)::INTEGER AS hint_page, c_mktsegment AS hint FROM customer),
g AS (SELECT 'd' || (p_partkey % 20) AS job_id, p_partkey AS region_id, (p_partkey // 20 % 60)::INTEGER AS page, CASE p_size % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILD' WHEN 2 THEN 'MACHINERY' WHEN 3 THEN 'HOUSEHOLD' ELSE 'xy' END AS text FROM part),
s AS (SELECT h.job_id, h.record_id, g.region_id, {_FUZZY} AS t, (0.9 * {_FUZZY} + 0.1 * greatest(0.0, 1 - abs(page - hint_page) / 4)) * 0.98 AS score
      FROM h JOIN g ON h.job_id = g.job_id AND abs(page - hint_page) <= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY job_id, record_id ORDER BY score DESC, region_id DESC) AS n, score >= 0.62 AS fine FROM s WHERE score >= 0.62)
"""


@query(f"""WITH {_HINTS}, strong AS (SELECT s.job_id, s.record_id, s.region_id, s.score FROM s JOIN h ON s.job_id = h.job_id AND s.record_id = h.record_id JOIN g ON g.region_id = s.region_id WHERE s.score >= 0.62 AND t >= 0.94)
SELECT job_id, record_id, region_id, round(max(score), 9)::DOUBLE AS score FROM (SELECT job_id, record_id, region_id, score FROM b WHERE n = 1 UNION ALL SELECT * FROM strong) GROUP BY 1, 2, 3""")
def hint_scored_join(spark: SparkSession, sf: str) -> Frame:
    c, p = F.col("c_custkey"), F.col("p_partkey")
    job = lambda k: F.concat(F.lit("d"), (k % 20).cast("string")).alias("job_id")
    hints = table(spark, sf, "customer").select(job(c), c.alias("record_id"), F.lit("caption_texts").alias("hint_kind"), F.col("c_mktsegment").alias("hint"), (F.floor(c / 20) % 60).cast("int").alias("hint_page"))
    word = F.element_at(F.array(*(F.lit(x) for x in _WORDS)), F.col("p_size") % 5 + 1)
    own = table(spark, sf, "part").select(job(p), p.alias("region_id"), (F.floor(p / 20) % 60).cast("int").alias("page"), F.lit("caption").alias("kind"), word.alias("text"))
    return fuse.hint_matches(hints, own).select("job_id", "record_id", "region_id", F.round("score", 9).alias("score"))


@query("""WITH e AS (SELECT l_orderkey AS record_id, l_partkey AS edge_id, l_partkey % 4 = l_suppkey % 4 AS id_match, l_returnflag = 'A' AS accepted, l_quantity / 50 AS score, l_linenumber % 2 = 0 AS owned, l_suppkey % 5 AS page_gap, l_linenumber AS ord FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY id_match DESC, accepted DESC, score DESC, owned DESC, page_gap, ord, edge_id DESC) AS n FROM e) SELECT record_id, edge_id, score FROM r WHERE n = 1""")
def primary_edge(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("edge_id"), (F.col("l_partkey") % 4 == F.col("l_suppkey") % 4).alias("id_match"), (F.col("l_returnflag") == "A").alias("accepted"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_linenumber") % 2 == 0).alias("owned"), (F.col("l_suppkey") % 5).alias("page_gap"), F.col("l_linenumber").alias("ord"))
    return fuse.primary_edges(rows)


@query("""WITH r AS (SELECT c_custkey AS record_id, c_nationkey AS plate_no, (c_custkey % 12)::INTEGER AS item_no, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'M' || (c_custkey % 5) END AS artifact_id FROM customer),
l AS (SELECT p_partkey AS region_id, (p_partkey % 25)::INTEGER AS plate_no, (p_size % 12)::INTEGER AS item_no, CASE WHEN p_partkey % 2 = 0 THEN 'M' || (p_partkey % 5) ELSE '' END AS label_artifact, p_size / 64 AS confidence FROM part),
x AS (SELECT r.record_id, l.region_id, label_artifact <> '' AND label_artifact = artifact_id AS exact, row_number() OVER (PARTITION BY record_id ORDER BY (label_artifact <> '' AND label_artifact = artifact_id) DESC, confidence DESC, region_id) AS n
      FROM r JOIN l ON r.plate_no = l.plate_no AND r.item_no = l.item_no WHERE label_artifact = '' OR label_artifact = artifact_id OR artifact_id = '')
SELECT record_id, region_id, CASE WHEN exact THEN 0.99 ELSE 0.96 END::DOUBLE AS score FROM x WHERE n = 1""")
def plate_reference_join(spark: SparkSession, sf: str) -> Frame:
    c, p = F.col("c_custkey"), F.col("p_partkey")
    records = table(spark, sf, "customer").select(F.lit("job").alias("job_id"), c.alias("record_id"), F.col("c_nationkey").alias("plate_no"), (c % 12).cast("int").alias("item_no"), F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("M"), (c % 5).cast("string"))).alias("artifact_id"))
    labels = table(spark, sf, "part").select(F.lit("job").alias("job_id"), p.alias("region_id"), p.alias("region_ord"), (p % 25).cast("int").alias("plate_no"), (F.col("p_size") % 12).cast("int").alias("item_no"), F.when(p % 2 == 0, F.concat(F.lit("M"), (p % 5).cast("string"))).otherwise("").alias("label_artifact"), (F.col("p_size") / 64).alias("confidence"))
    return fuse.plate_references(records, labels).drop("job_id")


@query("""WITH w AS (SELECT l_orderkey AS record_id, l_returnflag AS field, (l_partkey % 6)::INTEGER AS page, max(l_linenumber) AS weight, bool_or(l_linestatus = 'O') AS c, bool_or(l_suppkey % 2 = 0) AS s FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT record_id, page, sum(weight) AS score, count(*) AS n, bool_or(c) AS c, bool_or(s) AS s FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY NOT c DESC, score DESC, n DESC, s DESC, page) AS k FROM p)
SELECT record_id, page, score::BIGINT AS score FROM r WHERE k = 1""")
def evidence_page(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("field"), (F.col("l_partkey") % 6).cast("int").alias("page"), F.col("l_linenumber").alias("weight"), (F.col("l_linestatus") == "O").alias("is_color"), (F.col("l_suppkey") % 2 == 0).alias("is_selected"))
    return evidence.primary_pages(rows)


@query("""WITH o AS (SELECT c_nationkey AS artifact_id, c_custkey AS record_id FROM customer WHERE c_acctbal >= 0), b AS (SELECT artifact_id, arg_max(record_id, (round(c_acctbal)::BIGINT, -c_custkey)) AS owner_id FROM (SELECT c_nationkey AS artifact_id, c_custkey AS record_id, c_acctbal, c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1)
SELECT s_suppkey AS record_id, s_nationkey AS artifact_id, b.owner_id FROM supplier LEFT JOIN b ON s_nationkey = b.artifact_id""")
def caption_absorption(spark: SparkSession, sf: str) -> Frame:
    owners = table(spark, sf, "customer").filter("c_acctbal >= 0").select(F.lit("job").alias("job_id"), F.col("c_nationkey").alias("artifact_id"), F.col("c_custkey").alias("record_id"), F.round("c_acctbal").cast("long").alias("richness"), F.col("c_custkey").alias("ord"))
    captions = table(spark, sf, "supplier").select(F.lit("job").alias("job_id"), F.col("s_nationkey").alias("artifact_id"), F.col("s_suppkey").alias("record_id"))
    return fuse.absorb(owners, captions).drop("job_id")


@query("""WITH g AS (SELECT c_custkey AS gold_id, 'stem' || (c_custkey % 300) AS key, ['p' || (c_nationkey % 10), 'p' || (c_custkey % 10)] AS pk FROM customer), a AS (SELECT s_suppkey AS asset_id, 'stem' || (s_suppkey % 60) AS stem, ['p' || (s_nationkey % 10)] AS rk FROM supplier),
s AS (SELECT stem, max(asset_id) AS asset_id FROM a GROUP BY 1), x AS (SELECT gold_id, unnest(pk) AS k FROM g), y AS (SELECT asset_id, unnest(rk) AS k FROM a)
SELECT gold_id, asset_id, 'artifact' AS link_type FROM g JOIN s ON g.key = s.stem UNION ALL SELECT DISTINCT gold_id, asset_id, 'color_plate' FROM x JOIN y USING (k)""")
def asset_links(spark: SparkSession, sf: str) -> Frame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    gold = table(spark, sf, "customer").select(c.alias("gold_id"), name("stem", c % 300).alias("key"), F.array(name("p", F.col("c_nationkey") % 10), name("p", c % 10)).alias("plate_keys"))
    assets = table(spark, sf, "supplier").select(s.alias("asset_id"), s.alias("ord"), name("stem", s % 60).alias("stem"), F.array(name("p", F.col("s_nationkey") % 10)).alias("reference_keys"))
    return evaluate.asset_links(gold, assets)


@query()
def spatial_evidence(spark: SparkSession, sf: str) -> Frame:
    """One-to-one evidence and regions of a page and kind; tests hold the assignment against brute force."""
    own = regions(spark, sf).filter("kind = 'artifact'")
    moved = g.box(F.col("bbox.l") + 0.01, F.col("bbox.t"), F.col("bbox.r") + 0.01, F.col("bbox.b"))
    found = own.select("job_id", "page", "kind", F.concat(F.lit("e"), "id").alias("evidence_id"), moved.alias("bbox"))
    return fuse.spatial_evidence(found, own.withColumnRenamed("id", "region_id")).drop("job_id")
