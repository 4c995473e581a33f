"""Evaluation against human labels: a left join on the label side, field comparison, and metric blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import compare_fields


def human_left_join(gold: DataFrame, pred: DataFrame, key: str = "key") -> DataFrame:
    """One row per gold row: gold columns, pred_count, gold_count, match_status and, where matched, struct ``pred``.

    A key that two predictions or two gold rows share is ambiguous, before it is asked whether any prediction exists; such
    rows are never paired by order. Empty keys of predictions never match. Predictions are reduced to one row per key
    before the join, so a hot key costs one row.
    """
    per_key = pred.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("pred_count"), F.any_value(F.struct(*[c for c in pred.columns if c != key])).alias("pred"))
    per_gold = gold.groupBy(F.col(key).alias("__key2")).agg(F.count("*").alias("gold_count"))
    joined = gold.join(per_gold, F.col(key) == F.col("__key2"), "left").join(per_key, F.col(key) == F.col("__key"), "left")
    pred_count, gold_count = F.coalesce("pred_count", F.lit(0)), F.coalesce("gold_count", F.lit(1))
    status = F.when((pred_count > 1) | (gold_count > 1), "ambiguous").when(pred_count == 0, "not_found").otherwise("matched")
    return joined.select(*gold.columns, pred_count.alias("pred_count"), gold_count.alias("gold_count"), status.alias("match_status"), F.when(status == "matched", F.col("pred")).alias("pred"))


def unmatched_predictions(pred: DataFrame, gold: DataFrame, key: str = "key") -> DataFrame:
    """Predictions whose key no gold row has; those without a key are among them."""
    left = pred.withColumn("__key", F.coalesce(F.col(key), F.lit("")))
    right = gold.select(F.col(key).alias("__key")).filter("__key IS NOT NULL AND __key <> ''").distinct()
    return left.join(right, "__key", "left_anti").drop("__key")


def field_results(joined: DataFrame, fields: list[str], *, normal: bool = False, exact_only: bool = False) -> DataFrame:
    """A row per gold row and field: the gold columns, key, verdict, score, exact. ``joined`` is what human_left_join gives
    with fields of the same names on both sides. Rows without a match are not evaluated where the label has a value."""
    keep = [c for c in joined.columns if c not in {*fields, "pred"}]
    each = F.array(*(F.struct(F.lit(f).alias("key"), F.col(f"pred.{f}").cast("string").alias("actual"), F.col(f).cast("string").alias("expected")) for f in fields))
    rows = joined.select(*keep, F.inline(each))
    # one pass: what has no match is compared with nothing, and its verdict says so
    met, empty = F.col("match_status") == "matched", F.trim(F.coalesce("expected", F.lit(""))) == ""
    marked = rows.withColumn("__other", F.when(~met, F.when(empty, "not_applicable").otherwise("not_evaluated"))).withColumn("actual", F.when(met, F.col("actual"))).withColumn("expected", F.when(met, F.col("expected")))
    out = compare_fields(marked, "key", "actual", "expected", normal=normal, exact_only=exact_only)
    return out.select(*keep, "key", F.coalesce("__other", "verdict").alias("verdict"), F.when(F.col("__other").isNull(), F.col("score")).otherwise(0.0).alias("score"), (F.col("__other").isNull() & F.col("exact")).alias("exact"))


def field_metrics(results: DataFrame, fields: list[str]) -> DataFrame:
    """Per field evaluated, matched, exact, missing, mismatched, extra (always 0), mean_score, exact_rate. Every field of the
    fixed list has a row; without evaluated rows its means are null."""
    # conditions in the aggregate: a filter would be pushed below the comparison and compare everything once more
    shown, of = ~F.col("verdict").isin("not_applicable", "not_evaluated"), lambda v: F.count_if(F.col("verdict") == v).alias(v)
    agg = results.groupBy("key").agg(F.count_if(shown).alias("evaluated"), of("matched"), F.count_if(shown & F.col("exact")).alias("exact"), of("missing"), of("mismatched"), F.avg(F.when(shown, F.col("score"))).alias("mean_score"))
    base = results.sparkSession.createDataFrame([(f,) for f in fields], "key string")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = base.join(agg, "key", "left")
    return joined.select("key", n("evaluated"), n("matched"), n("exact"), n("missing"), n("mismatched"), F.lit(0).cast("long").alias("extra"), "mean_score", F.try_divide("exact", "evaluated").alias("exact_rate"))


def summary(joined: DataFrame, metrics: DataFrame, predictions_with_id: DataFrame, full_document: bool) -> DataFrame:
    """One row: counts by status, precision over predictions with an id, recall only for whole documents, macro scores."""
    status = F.col("match_status")
    runs = joined.agg(F.count("*").alias("gold_rows"), *(F.count_if(status == s).alias(s) for s in ("matched", "ambiguous", "not_found")))
    means = metrics.agg(F.avg("mean_score").alias("macro_score"), F.avg("exact_rate").alias("macro_exact"))
    preds = predictions_with_id.agg(F.count("*").alias("predictions"))
    one = runs.crossJoin(means).crossJoin(preds)  # three single rows
    recall = F.try_divide("matched", "gold_rows") if full_document else F.lit(None).cast("double")
    return one.select("*", F.try_divide("matched", "predictions").alias("precision"), recall.alias("recall"))


def anchor_hits(anchors: DataFrame, tokens_col: str, text_tokens_col: str) -> DataFrame:
    """Per key: anchors evaluated and hit, where every token of the anchor is among the text's."""
    hit = (F.size(tokens_col) > 0) & (F.size(F.array_except(tokens_col, text_tokens_col)) == 0)
    return anchors.groupBy("key").agg(F.count("*").alias("evaluated"), F.count_if(hit).alias("hit"), F.avg(hit.cast("double")).alias("hit_rate"))


def relation_presence(items: DataFrame) -> DataFrame:
    """Per relation key: of the rows that have a label, how many have the relation. Columns key, labelled, present."""
    return items.filter("labelled").groupBy("key").agg(F.count("*").alias("evaluated"), F.count_if("present").alias("present"), F.avg(F.col("present").cast("double")).alias("rate"))


def plate_of_records(records: DataFrame, relations: DataFrame, regions: DataFrame) -> DataFrame:
    """record_id, region_id: the first colour plate among a record's own regions, then among its relations' ends.
    ``records``: record_id, region_ids, relation_ids; order within the arrays decides."""
    own = records.select("record_id", F.posexplode_outer("region_ids").alias("pos", "region_id")).withColumn("rank", F.coalesce("pos", F.lit(0)).cast("long")).drop("pos")
    via = records.select("record_id", F.posexplode("relation_ids").alias("pos", "relation_id")).join(relations.select(F.col("id").alias("relation_id"), "source_region_id", "target_region_id"), "relation_id")
    ends = via.select("record_id", F.inline(F.array(*(F.struct((F.lit(1 << 32) + F.col("pos") * 2 + k).alias("rank"), F.col(c).alias("region_id")) for k, c in enumerate(("source_region_id", "target_region_id"))))))
    found = own.unionByName(ends).join(regions.filter("kind = 'color_plate'").select(F.col("id").alias("region_id")), "region_id", "left_semi")
    return found.groupBy("record_id").agg(F.min_by("region_id", "rank").alias("region_id"))


def sibling_fill(records: DataFrame, values: list[str], last: bool = True) -> DataFrame:
    """Empty values are filled from the last (or first) sibling of the same entity that has one; ``ord`` is the order."""
    pick = F.max_by if last else F.min_by
    filled = records.filter("entity_id IS NOT NULL").groupBy(F.col("entity_id").alias("__e")).agg(*(pick(v, F.when(F.col(v).isNotNull(), F.col("ord"))).alias(f"__{v}") for v in values))
    return records.join(filled, F.col("entity_id") == F.col("__e"), "left").select(*[c for c in records.columns if c not in values], *(F.coalesce(v, f"__{v}").alias(v) for v in values))


def region_kinds(records: DataFrame, relations: DataFrame, regions: DataFrame) -> DataFrame:
    """record_id, region_ids, kinds: own regions and the ends of own relations."""
    own = records.select("record_id", F.explode("region_ids").alias("region_id"))
    via = records.select("record_id", F.explode("relation_ids").alias("id")).join(relations, "id").select("record_id", F.explode(F.array("source_region_id", "target_region_id")).alias("region_id"))
    return own.unionByName(via).distinct().join(regions.select(F.col("id").alias("region_id"), "kind"), "region_id").groupBy("record_id").agg(F.array_sort(F.collect_set("region_id")).alias("region_ids"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def _blocks(rows: DataFrame, name: str, keys: str, chunk: int) -> DataFrame:
    """``keys`` and an array of about ``chunk`` ids that have them; an id that is null is one of them."""
    sizes = rows.groupBy(keys).agg(F.ceil(F.count("*") / chunk).alias("parts"))
    ids, null = F.expr(f"array_agg({name})"), F.count_if(F.col(name).isNull()) > 0
    dealt = rows.join(sizes, keys).groupBy(keys, F.expr(f"pmod(xxhash64({name}), parts)").alias("part"))
    return dealt.agg(F.when(null, F.concat(ids, F.array(F.lit(None)))).otherwise(ids).alias(name)).drop("part")


def asset_links(gold: DataFrame, assets: DataFrame, chunk: int = 4096) -> DataFrame:
    """gold_id, asset_id, link_type: by file stem (the last asset of a stem) and by every plate key.

    Links by plate key are most of all pairs, so none of them is shuffled: ids with the same set of keys are one class, the pairs of
    classes that share a key are made distinct, and each is cut into blocks, of ``chunk`` assets and a quarter as many golds. Blocks
    are dealt evenly over all tasks, however few the classes are, and only there become links."""
    by_stem = assets.groupBy("stem").agg(F.max_by("asset_id", "ord").alias("asset_id"))
    direct = gold.join(by_stem, gold["key"] == by_stem["stem"]).select("gold_id", "asset_id", F.lit("artifact").alias("link_type"))
    keys = lambda own, name, of, to: own.select(name, F.explode(of).alias("k")).filter("k IS NOT NULL").groupBy(name).agg(F.array_sort(F.collect_set("k")).alias(to))
    left, right = keys(gold, "gold_id", "plate_keys", "own"), keys(assets, "asset_id", "reference_keys", "theirs")
    of = lambda rows, name: rows.select(name).distinct().select(name, F.explode(name).alias("k"))
    met = of(left, "own").join(of(right, "theirs"), "k").select("own", "theirs").distinct()
    blocks = met.join(_blocks(left, "gold_id", "own", max(1, chunk // 4)), "own").join(_blocks(right, "asset_id", "theirs", chunk), "theirs")
    spark = gold.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a compiled explode holds all its rows before the first is taken: the transform keeps the outer one, of whole blocks, from being compiled
    golds = blocks.select("gold_id", "asset_id").repartition(tasks).select("asset_id", F.explode(F.transform("gold_id", lambda x: x)).alias("gold_id"))
    return direct.unionByName(golds.select("gold_id", F.explode("asset_id").alias("asset_id"), F.lit("color_plate").alias("link_type")))


def duplicate_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("duplicate_key_count", F.count("*").over(Window.partitionBy(key)))


def export(items: DataFrame, order: str) -> DataFrame:
    """Text columns with the spreadsheet guard, in the order of the source rows."""
    from sondage.functions.text import guarded

    return items.select(*(guarded(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in items.dtypes)).orderBy(order)


def ratio(a: Column, b: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(a, b)
