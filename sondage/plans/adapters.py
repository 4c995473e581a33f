"""Driver tables in the shape of the domain: integer arithmetic and ASCII strings, so SQL sees the same values.

Each adapter has its SQL twin, a list of common table expressions to put after WITH.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.geometry import box
from sondage.functions.text import identifier
from sondage.session import table

GOLD_FIELDS = ["status", "priority"]

GOLD_SQL = """
gold AS (SELECT o_orderkey AS gold_id, 'M' || o_custkey || ',' || month(o_orderdate) AS key, o_orderkey AS source_row,
                o_orderstatus AS status, translate(o_orderpriority, '12345', '１２３４５') AS priority FROM orders),
pred AS (SELECT 'M' || (l_suppkey * 13) || ',' || month(l_shipdate) AS key, max(l_linestatus) AS status,
                (1 + l_suppkey % 5) || '-URGENT' AS priority, count(*) AS n_lines, l_suppkey,
                CASE WHEN l_suppkey % 7 = 0 THEN l_returnflag ELSE '' END AS variant
         FROM lineitem GROUP BY l_suppkey, month(l_shipdate), CASE WHEN l_suppkey % 7 = 0 THEN l_returnflag ELSE '' END),
pc AS (SELECT key, count(*) AS n, min(status) AS p_status, min(priority) AS p_priority FROM pred GROUP BY key),
gc AS (SELECT key, count(*) AS n FROM gold GROUP BY key),
joined AS (SELECT g.*, coalesce(pc.n, 0) AS pred_count, gc.n AS gold_count, p_status, p_priority,
                  CASE WHEN coalesce(pc.n, 0) > 1 OR gc.n > 1 THEN 'ambiguous' WHEN pc.n IS NULL THEN 'not_found' ELSE 'matched' END AS match_status
           FROM gold g JOIN gc ON g.key = gc.key LEFT JOIN pc ON g.key = pc.key)
"""

#: What the ratio must be for the values that meet here.
_PRIORITIES = [f"{i}{name}" for i, name in enumerate(["urgent", "high", "medium", "notspecified", "low"], 1)]
_VALUES = [(f"{i}urgent", p) for i in range(1, 6) for p in _PRIORITIES] + [(a, b) for a in "fo" for b in "fop"]
_RATIOS = "CASE ca || '|' || ce " + " ".join(f"WHEN '{a}|{b}' THEN {SequenceMatcher(None, a, b).ratio()!r}" for a, b in _VALUES) + " END"

RESULTS_SQL = GOLD_SQL + """,
pairs AS (SELECT gold_id, match_status, 'status' AS key, p_status AS a, status AS e FROM joined
          UNION ALL SELECT gold_id, match_status, 'priority', p_priority, priority FROM joined),
compact AS (SELECT *, lower(regexp_replace(coalesce(a, ''), '[^0-9A-Za-z.]+', '', 'g')) AS ca, lower(regexp_replace(translate(coalesce(e, ''), '１２３４５', '12345'), '[^0-9A-Za-z.]+', '', 'g')) AS ce FROM pairs),
scored AS (SELECT *, CASE WHEN ca = ce THEN 1.0 WHEN ca = '' OR ce = '' THEN 0.0 WHEN contains(ca, ce) OR contains(ce, ca)
                     THEN greatest(0.9, least(length(ca), length(ce)) / greatest(length(ca), length(ce))) ELSE """ + _RATIOS + """ END::DOUBLE AS s FROM compact),
results AS (SELECT gold_id, key, CASE WHEN match_status <> 'matched' THEN CASE WHEN trim(coalesce(e, '')) = '' THEN 'not_applicable' ELSE 'not_evaluated' END
                   WHEN ce = '' THEN 'not_applicable' WHEN ca = '' THEN 'missing' WHEN s >= 0.85 THEN 'matched' ELSE 'mismatched' END AS verdict,
                   CASE WHEN match_status <> 'matched' OR ce = '' OR ca = '' THEN 0.0 ELSE s END::DOUBLE AS score,
                   (match_status = 'matched' AND ca <> '' AND ca = ce) AS exact FROM scored)
"""


def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit("M"), F.col("o_custkey").cast("string"), F.lit(":"), F.month("o_orderdate").cast("string"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("gold_id"), identifier(key, True).alias("key"), F.col("o_orderkey").alias("source_row"), F.col("o_orderstatus").alias("status"), F.translate("o_orderpriority", "12345", "１２３４５").alias("priority"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit("M"), (F.col("l_suppkey") * 13).cast("string"), F.lit(":"), F.col("m").cast("string"))
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.month("l_shipdate").alias("m"), F.when(F.col("l_suppkey") % 7 == 0, F.col("l_returnflag")).otherwise("").alias("variant"), "l_linestatus")
    grouped = rows.groupBy("l_suppkey", "m", "variant").agg(F.max("l_linestatus").alias("status"), F.count("*").alias("n_lines"))
    return grouped.select(identifier(key, True).alias("key"), "status", F.concat((1 + F.col("l_suppkey") % 5).cast("string"), F.lit("-URGENT")).alias("priority"), "n_lines", "l_suppkey", "variant")


#: Line items by order and number, which the table may hold more than once.
LINES_SQL = """li AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")))


#: Regions on pages: a part is a region; its page, kind and box follow from its key.
REGIONS_SQL = """
regions AS (SELECT p_partkey AS ord, 'r' || p_partkey AS id, (p_partkey // 20)::INTEGER AS page,
                   CASE p_partkey % 5 WHEN 0 THEN 'group' WHEN 1 THEN 'number' WHEN 2 THEN 'caption' ELSE 'artifact' END AS kind,
                   CASE WHEN p_partkey % 5 = 0 THEN ((p_partkey // 5) % 2) / 2.0 ELSE (p_partkey % 8) / 10.0 + (p_size % 10) / 100.0 END::DOUBLE AS l,
                   CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE ((p_partkey * 7) % 8) / 10.0 END::DOUBLE AS t,
                   CASE WHEN p_partkey % 5 = 0 THEN ((p_partkey // 5) % 2) / 2.0 + 0.5 ELSE (p_partkey % 8) / 10.0 + (p_size % 10) / 100.0 + 0.1 END::DOUBLE AS r,
                   CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE ((p_partkey * 7) % 8) / 10.0 + CASE WHEN p_partkey % 5 = 1 THEN 0.03125 ELSE 0.125 END END::DOUBLE AS b FROM part)
"""


def regions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    group = k % 5 == 0
    side = F.floor(k / 5) % 2 / 2.0
    l = F.when(group, side).otherwise(k % 8 / 10.0 + F.col("p_size") % 10 / 100.0)
    r = F.when(group, side + 0.5).otherwise(k % 8 / 10.0 + F.col("p_size") % 10 / 100.0 + 0.1)
    t = F.when(group, 0.0).otherwise(k * 7 % 8 / 10.0)
    b = F.when(group, 1.0).otherwise(k * 7 % 8 / 10.0 + F.when(k % 5 == 1, 0.03125).otherwise(0.125))
    kind = F.when(group, "group").when(k % 5 == 1, "number").when(k % 5 == 2, "caption").otherwise("artifact")
    return table(spark, sf, "part").select(F.lit("job").alias("job_id"), F.floor(k / 20).cast("int").alias("page"), F.concat(F.lit("r"), k.cast("string")).alias("id"), kind.alias("kind"), box(l, t, r, b).alias("bbox"), F.when(k % 5 == 2, F.concat(F.lit("fig 3: "), (k % 4 + 1).cast("string"), F.lit("."))).when(k % 5 == 1, (k % 4 + 1).cast("string")).alias("text"), F.lit(0.9).alias("confidence"), k.alias("ord"))


#: Links between two snapshots: a line is a link, the second snapshot changes some and drops some.
LINKS_SQL = """
keyed AS (SELECT l_orderkey || '-' || l_linenumber AS id, 'r' || l_partkey AS s, 's' || l_suppkey AS d, l_quantity, l_linenumber, l_orderkey, l_partkey, l_returnflag FROM lineitem),
old AS (SELECT id, s AS source_region_id, d AS target_region_id, 'caption_of' AS relation_type, l_quantity / 50 AS score, CASE WHEN l_linenumber % 2 = 0 THEN 'ocr_scope' ELSE 'spatial_fallback' END AS method,
               CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'unreviewed' END AS review_status FROM keyed WHERE l_orderkey % 11 <> 0),
new AS (SELECT id, s AS source_region_id, d AS target_region_id, 'caption_of' AS relation_type, CASE WHEN l_partkey % 9 = 0 THEN l_quantity / 100 ELSE l_quantity / 50 END AS score,
               CASE WHEN l_linenumber % 2 = 0 THEN 'ocr_scope' ELSE 'spatial_fallback' END AS method, 'unreviewed' AS review_status FROM keyed WHERE l_orderkey % 13 <> 0)
"""


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("source_region_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_region_id"), F.lit("caption_of").alias("relation_type"), "l_quantity", "l_linenumber", "l_orderkey", "l_partkey", "l_returnflag")
    method = F.when(F.col("l_linenumber") % 2 == 0, "ocr_scope").otherwise("spatial_fallback").alias("method")
    ends = ["id", "source_region_id", "target_region_id", "relation_type"]
    review = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("unreviewed").alias("review_status")
    old = rows.filter(F.col("l_orderkey") % 11 != 0).select(*ends, (F.col("l_quantity") / 50).alias("score"), method, review)
    new = rows.filter(F.col("l_orderkey") % 13 != 0).select(*ends, F.when(F.col("l_partkey") % 9 == 0, F.col("l_quantity") / 100).otherwise(F.col("l_quantity") / 50).alias("score"), method, F.lit("unreviewed").alias("review_status"))
    return old, new


#: Cards to verify: a document is a card; the human verdict is its label, the machine's a rule on its text.
ITEMS_SQL = """
dup AS (SELECT text, count(*) AS n FROM documents GROUP BY text),
items AS (SELECT d.doc_id AS record_id, d.source, d.lang, CASE WHEN l.quality = 1 THEN 'passed' WHEN l.quality = 0 THEN 'failed' END AS human, l.doc_id IS NULL AS model_unavailable,
                 d.n_chars < 400 AS short, dup.n > 1 AS copy, contains(d.text, '|') AS odd,
                 CASE WHEN d.n_chars < 400 OR dup.n > 1 THEN 'failed' WHEN contains(d.text, '|') THEN 'uncertain' ELSE 'passed' END AS machine
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN dup ON d.text = dup.text)
"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """record_id, human, machine, model_unavailable and field_results. Copies are counted by digest, so texts are not
    shuffled."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "source", "lang", (F.col("n_chars") < 400).alias("short"), F.contains("text", F.lit("|")).alias("odd"), F.md5("text").alias("digest"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("record_id"), "quality")
    copies = docs.groupBy("digest").agg((F.count("*") > 1).alias("copy"))
    rows = docs.join(labels, "record_id", "left").join(copies, "digest", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    verdict = lambda bad: F.when(F.col(bad), "failed").otherwise("passed")
    field = lambda name, v, code, reason, causes: F.struct(F.lit(name).alias("field"), v.alias("verdict"), F.lit(code).alias("failure_code"), F.lit(reason).alias("reason"), causes.alias("causes_overall_failure"))
    results = F.array(field("text", verdict("short"), "text_evidence_conflict", "", F.col("short")), field("identifier", verdict("copy"), "", "编号重复", F.col("copy") & (F.col("record_id") % 2 == 0)), field("layout", F.when(F.col("odd"), "uncertain").otherwise("passed"), "artifact_crop_missing", "", F.lit(False)))
    machine = F.when(F.col("short") | F.col("copy"), "failed").when(F.col("odd"), "uncertain").otherwise("passed")
    human = F.when(F.col("quality") == 1, "passed").when(F.col("quality") == 0, "failed")
    return rows.select("record_id", "source", "lang", human.alias("human"), F.col("quality").isNull().alias("model_unavailable"), "short", "copy", "odd", machine.alias("machine"), results.alias("field_results"))
