"""Queries of scalar functions. The rows of ``part`` take the texts of a list by turns, so each runs over the whole table; the
SQL states what each text must give."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import geometry as g
from sondage.functions import text as t
from sondage.operators import catalog, extraction, fuse, match, records, rematch, state, verify
from sondage.plans.registry import QUERIES, SQL
from sondage.session import table


def _literal(value: object, kind: str) -> Column:
    if isinstance(value, list):
        return F.array(*map(F.lit, value)).cast(kind)
    return F.lit(value).cast(kind)


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]"
    return repr(value)


def cases(name: str, kinds: list[str], sql_kind: str, rows: list[tuple], function: Callable[..., Column], doc: str) -> None:
    """Registers ``name``: p_partkey and the value of ``function`` for the arguments that the row's turn gives. The last entry of
    each of ``rows`` is what must come out."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        turn = (F.col("p_partkey") % len(rows) + 1).cast("int")
        own = [F.element_at(F.array(*(_literal(r[i], k) for r in rows)), turn).alias(f"a{i}") for i, k in enumerate(kinds)]
        given = table(spark, sf, "part").select("p_partkey", *own)
        return given.select("p_partkey", function(*(F.col(f"a{i}") for i in range(len(kinds)))).alias("value"))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    whens = " ".join(f"WHEN {i} THEN {_sql(r[-1])}" for i, r in enumerate(rows))
    SQL[name] = f"SELECT p_partkey, CAST(CASE p_partkey % {len(rows)} {whens} END AS {sql_kind}) AS value FROM part"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def _box(c: Column) -> Column:
    return F.when(c.isNotNull(), g.box(c[0], c[1], c[2], c[3]))


BOX = "array<double>"

cases("text_clean_value", ["string"], "VARCHAR", [(None, None), ("  a b ", "a b"), ("无", None), ("NaN", None), ("－", None), ("ＡＢ", "AB"), ("—", None), ("None ", None), ("0", "0")], t.clean_value, "SF1, PR10: trimmed normal text, null for empty markers.")
cases("text_canonical_id", ["string", "string"], "VARCHAR", [("M13", "9", "M13,9"), ("M13：2", "a 1", "M13,2,A1"), (None, "9", "9"), ("无", "", ""), ("h 2", ",3,,4,", "H2,3,4")], t.canonical_id, "SF3: context and sequence as one identifier.")
cases("text_report_name", ["string"], "VARCHAR", [(" 报告 A.PDF ", "报告a"), ("Ｘ y.pdf", "xy"), ("a.pdf.pdf", "a.pdf"), ("Straße", "strasse"), (None, None)], t.report_name, "SF4: file names that are compared.")
cases("text_sampling_id", ["string"], "VARCHAR", [("m13:9", "M13,9"), (" 无 ", "无"), (",a,,b：", "A,B"), (None, "")], t.sampling_id, "SF5: the sampling flavour keeps empty markers.")
cases("text_entity_id", ["string"], "VARCHAR", [("M13:9", "m13:9"), ("罐M13:9", "m13:9"), ("M13:9 and M14:2", ""), ("M13", ""), ("(t0302a:12)", "t0302a:12"), (None, "")], lambda c: t.entity_id_text(c), "SF6: one strict identifier, or nothing.")
cases("text_index_id", ["string"], "VARCHAR", [(" m13：9。", "M13:9"), (";a;b;", "A;B"), ("K1:2", "K1:2")], t.index_id, "SF7: keeps colons, trims outer punctuation.")
cases("text_discovery_id", ["string"], "VARCHAR", [("M13:9", "m139"), ("M1:39", "m139"), ("图 六-3", "图六3"), ("", "")], t.discovery_id, "SF9: letters and digits only.")
cases("text_fuzzy_score", ["string", "string"], "DOUBLE", [("abc", "abc", 1.0), ("abc", "xabcx", 0.94), ("ab", "abx", 0.8), ("", "a", 0.0), ("abcd", "bcde", 0.75)], t.fuzzy_score, "SF16: equal, contained, or the ratio.")
cases("text_similarity", ["string", "string"], "DOUBLE", [("罐 10厘米", "罐１０cm", 1.0), ("abc", "abcdef", 0.9), ("abcd", "bcde", 0.75), (None, "a", 0.0), (None, "无", 1.0), ("abcdefghij", "abcdefghijk", 10 / 11)], t.text_similarity, "SF19: with the ratio and normalisation.")
cases("text_compact", ["string"], "VARCHAR", [("口径 10.5 厘米", "口径10.5cm"), ("Ａ-b_C", "abc"), ("nan", ""), ("5毫米;2米", "5mm2m")], t.compact, "SF18: only digits, letters, CJK and points.")
cases("text_split_references", ["string"], "VARCHAR[]", [("图3-1; 彩版二:3 图3-1", ["图3-1", "|", "彩版二:3"]), ("none", ["|"]), ("Fig. 4-1; Plate 5", ["Fig. 4-1", "|", "Plate 5"])], lambda c: F.concat(t.split_references(c)["figures"], F.array(F.lit("|")), t.split_references(c)["plates"]), "SF29, JN38: figures before the bar, plates behind it, in order, each once.")
cases("text_plate_keys", ["string"], "VARCHAR[]", [("彩版一二,3 和 彩版O-1", ["彩版一二,3", "彩版O-1"]), ("彩版二，4、彩版二,4", ["彩版二,4"]), ("图一", [])], t.plate_keys, "SF30: colour plates in normal form.")
cases("text_identity_key", ["string"] * 6, "VARCHAR", [("M1:2", "3", "1", None, None, "r", "id:M1:2"), (None, "3", "1", None, None, "r", "figure:3:1"), (" ", "3", None, "8", "2", "r", "plate:8:2"), (None, None, None, None, None, "r", "record:r")], extraction.identity_key, "SF39: what makes partial records one.")
cases("text_signature", ["array<string>"], "VARCHAR", [(["b", "a", "b"], _hash("a|b")), (["x"], _hash("x")), ([], "")], t.signature, "SF43: digest of a set of ids.")
cases("text_display_id", ["string"], "VARCHAR", [("M13,9", "M13:9"), ("M13 ， 9", "M13:9"), ("K1：2", "K1:2")], records.display_id, "SF48.")
cases("text_byte_size", ["bigint"], "VARCHAR", [(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (3 << 30, "3.0 GB")], records.byte_size, "SF51.")
cases("text_remaining_seconds", ["double", "double"], "BIGINT", [(0.05, 10.0, None), (0.5, 10.0, 10), (0.08, 3.0, 35), (1.0, 5.0, 0), (0.5, 2.0, None)], records.remaining_seconds, "SF52: from 8 % and three seconds on.")
cases("text_visual_parenthesis", ["string"], "VARCHAR", [("罐（图一）和（彩版二）", "彩版二"), ("(note)", None), ("（图三", None), ("(fig 1) x (see)", "fig 1")], records.last_visual_parenthesis, "SF31.")
cases("text_balanced", ["string"], "BOOLEAN", [("(a)", True), ("（a)", True), ("(a", False), ("", True), ("a)", False)], records.balanced_parentheses, "SF31.")
cases("text_prose_measurements", ["string"], "VARCHAR[]", [("口径 10、12厘米，高3.5cm", ["口径|10,12|厘米", "高|3.5|cm"]), ("通高 7 毫米", ["通高|7|毫米"]), ("no size", [])], lambda c: F.transform(records.prose_measurements(c), lambda m: F.concat_ws("|", m["name"], F.array_join(m["amounts"], ","), m["unit"])), "SF32: amounts share the unit behind the last.")
cases("text_scoped_paragraph", ["string", "string"], "VARCHAR", [("M1:2 罐。M1:3 碗", "M1:2", "M1:2 罐。"), ("M1:2 罐。M1:3 碗", "M1:3", "M1:3 碗"), ("M1:2 罐", "M9:9", None)], records.scoped_paragraph, "SF33: from the own identifier to the next.")
cases("text_upgrade", ["string", "string"], "BOOLEAN", [(None, "a", True), ("a", "ab", True), ("a", "b", False), ("a", "a", False), ("a", None, False), ("", " ", False)], records.upgrade, "SF35, PR31: whether a new value is better.")
cases("text_captions_compatible", ["string", "string"], "BOOLEAN", [("图三-1 罐", "见图三-1", True), ("罐", "大罐", True), ("罐", "碗", False), ("", "碗", False)], records.captions_compatible, "SF38.")
cases("text_ids_compatible", ["string", "string"], "BOOLEAN", [("T03021:5", "T0302:5", True), ("M1:2", "m1:2", True), ("M1:2", "M12:2", False), ("T0302:5", "T030225:5", False), ("T0302:5", "T03021:6", False)], records.ids_compatible, "SF13, PR32: equal, or a circled unit that ran into the stem.")
cases("text_missing_colon", ["string", "string"], "BOOLEAN", [("M02:2", "M022", True), ("M12:2", "M122", False), ("M02:2", "M023", False)], records.missing_colon, "SF14: for zero-padded left parts only.")
cases("material_buckets", ["string"], "VARCHAR", [(None, "未记录"), (" ", "未记录"), ("青玉", "玉石"), ("泥质灰陶", "陶瓷"), ("泥质", "泥质 / 夹砂"), ("铁器", "金属"), ("骨", "骨牙贝"), ("砂岩", "石质"), ("漆木", "木竹漆"), ("丝", "其他材质")], t.material, "SF49: the first rule that holds.")
cases("text_guarded", ["string"], "VARCHAR", [("=1+1", "'=1+1"), ("@x", "'@x"), ("-3", "'-3"), ("+", "'+"), ("a=1", "a=1"), (None, None)], t.guarded, "SC16: what a spreadsheet would take for a formula.")
cases("text_safe_path", ["string"], "VARCHAR", [("a/b.png", "a/b.png"), ("x..y/z", "x..y/z")], records.safe_path, "SC18: keys that stay in their folder.")
cases("text_upload_ids", ["string"], "VARCHAR[]", [("see m13:9 and H2:3, T1", ["M13:9", "H2:3"]), ("K1:2", []), ("M1:2 M1:2", ["M1:2"])], records.upload_ids, "PR43.")

cases("box_valid", [BOX], "BOOLEAN", [([0, 0, 1, 1], True), ([0.5, 0, 0.5, 1], False), ([-0.1, 0, 1, 1], False), ([0, 0, 1, 1.1], False), (None, False)], lambda b: g.valid(_box(b)), "PR4.")
cases("box_over_smaller", [BOX, BOX], "DOUBLE", [([0, 0, 0.5, 0.5], [0.25, 0.25, 1, 1], 0.25), ([0, 0, 0.5, 0.5], [0.5, 0.5, 1, 1], 0.0), ([0.25, 0.25, 0.5, 0.5], [0, 0, 1, 1], 1.0), ([0, 0, 0, 0], [0, 0, 1, 1], 0.0)], lambda a, b: g.over_smaller(_box(a), _box(b)), "GE3.")
cases("box_axis_overlap", ["double"] * 4, "DOUBLE", [(0.0, 0.5, 0.25, 1.0, 0.5), (0.0, 0.25, 0.5, 1.0, 0.0), (0.5, 0.5, 0.0, 1.0, 0.0), (0.0, 1.0, 0.25, 0.5, 1.0)], g.axis_overlap, "GE3.")
cases("box_covers", [BOX, BOX, "string"], "BOOLEAN", [([0.1, 0.1, 0.2, 0.2], [0, 0, 1, 1], "artifact", True), ([0.4, 0, 1, 0.5], [0, 0, 0.5, 0.5], "artifact", False), ([0, 0, 0.75, 0.5], [0, 0, 0.5, 0.5], "caption", True), ([0, 0, 1.0, 0.5], [0, 0, 0.5, 0.5], "other", True), ([0.6, 0.6, 1, 1], [0, 0, 0.5, 0.5], "number", False)], lambda a, b, k: g.covers(_box(a), _box(b), k), "GE4: labels by centre or a third, others by centre and half.")
cases("box_nearest_score", ["double", "int", "boolean", "boolean"], "DOUBLE", [(0.0, 0, True, True, 1.0), (0.55, 2, False, False, 0.78 * (1 - 0.55 / 1.1) + 0.22 * (1 - 2 / 4)), (1.1, 3, True, False, 0.0 + 0.22 * (1 - 3 / 4) + 0.12), (2.0, 4, False, True, 0.0 + 0.0 + 0.0 + 0.2)], g.nearest_score, "GE14.")
cases("box_crop", [BOX, "int", "int"], "INTEGER[]", [([0.25, 0.25, 0.5, 0.5], 100, 200, [25, 50, 50, 100]), ([0.001, 0, 0.999, 1], 10, 10, [0, 0, 10, 10])], lambda b, w, h: F.array(*(g.crop(_box(b), w, h)[c] for c in ("x0", "y0", "x1", "y1"))), "GE17: rounded outwards.")

cases("record_incomplete_context", ["string", "string"], "BOOLEAN", [("M14", None, True), ("M14", "3", False), ("M14:2", None, False), (None, None, False), (" m14 ", "", True)], records.incomplete_context, "PR8.")
cases("record_crop_bound", ["string", "string"], "BOOLEAN", [("r", None, True), (None, "r", True), ("", None, False), (None, None, False)], catalog.crop_bound, "PR5, UX11.")
cases("record_display_value", ["string"] * 3, "VARCHAR", [("a", "b", "c", "a"), (" ", "b", "c", "b"), (None, None, "c", "c"), (None, None, None, None)], catalog.display_value, "PR16: the explicit value, else the raw one, else what is derived.")
cases("record_displayed", ["string"] * 4, "VARCHAR[]", [(None, None, None, "泥质灰陶罐，敞口", ["罐", "泥质灰陶", "泥质灰陶罐，敞口"]), ("碗", None, "圆", "夹砂陶罐", ["碗", "夹砂陶", "圆"])], lambda a, b, c, e: F.array(*(records.displayed(a, b, c, e, ["罐", "碗"])[x] for x in ("category", "texture", "morphology"))), "PR16: category, texture and morphology from the evidence.")
cases("record_link_hints", ["string"] * 6, "VARCHAR[]", [("3", "1", None, None, "M1", "2", ["M1:2", "3", "3-1", "3:1", "3 1"]), (None, None, "8", "2", None, None, ["8", "8-2", "8:2", "8 2"]), (None, " ", None, None, "M1", None, [])], extraction.link_hints, "PR22, PR25.")
cases("record_coerced_number", ["string"], "VARCHAR", [("12", "12.0|valid"), ("1e3", "|needs_review"), (None, "|missing"), (" 3.5 ", "3.5|valid"), ("x", "|needs_review")], lambda c: F.concat_ws("|", F.coalesce(extraction.coerced(c, "number")["value"], F.lit("")), extraction.coerced(c, "number")["status"]), "PR12.")
cases("record_coerced_date", ["string"], "VARCHAR", [("2026-01-31", "2026-01-31|valid"), ("2026/1/31", "|needs_review"), (None, "|missing")], lambda c: F.concat_ws("|", F.coalesce(extraction.coerced(c, "date")["value"], F.lit("")), extraction.coerced(c, "date")["status"]), "PR12.")
cases("record_expanded", ["string"], "VARCHAR[]", [('{"a": {"v": "1", "raw": "one"}, "b": 2}', ["a=1/one/valid", "b=2/2/valid", "c=//missing"]), ('{"a": {"value": "x", "status": "NEEDS_REVIEW"}, "z": 1}', ["a=x/x/needs_review", "b=//missing", "c=//missing"])], lambda c: F.transform(extraction.expanded(c, ["a", "b", "c"]), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")), F.lit("/"), F.coalesce(x["raw_value"], F.lit("")), F.lit("/"), x["status"])), "PR13, PR14: full, compact and bare fields.")
cases("record_candidate", ["string"], "BOOLEAN", [("M1:2 here", True), ("10 cm, red", True), ("10 cm", False), ("red", False), (None, False)], lambda c: extraction.candidate(c, r"[A-Z]\d+:\d+", r"\d+ cm", "red|grey"), "PR21.")
cases("text_looks_cut", ["string"], "BOOLEAN", [('{"a": [1', True), ("{}", False), ("[1, 2]", False)], extraction.looks_cut, "SF41.")
cases("text_item_numbers", ["string"], "INTEGER[]", [("图3-4:5", [5]), ("1-3. 罐 7、碗", [1, 2, 3, 7]), ("十二、罐", [12]), ("９～８．倒", [8, 9]), ("none", [])], lambda c: F.array_sort(match.caption_items(c)), "SF28: item numbers of captions.")

cases("verdict_method_class", ["array<string>"], "VARCHAR", [(["ocr_scope"], "ocr_exact"), (["spatial_fallback"], "layout_fallback"), (["ocr_fallback"], "layout_fallback"), ([], "other"), (["manual"], "other")], verify.method_class, "SM3.")
cases("verdict_confidence_bucket", ["double"], "VARCHAR", [(0.9, "high"), (0.85, "high"), (0.6, "medium"), (0.59, "low"), (None, "low")], verify.confidence_bucket, "SM3.")
cases("state_move", ["string"], "VARCHAR", [("queued", "failed"), ("running", "failed")], lambda c: state.moved(c, "failed"), "SS6.")
cases("state_completed_at", ["string", "int", "int"], "INTEGER", [("completed", None, 5, 5), ("completed", 3, 5, 3), ("running", 3, 5, None), ("failed", None, 7, 7)], state.completed_at, "SS7.")
cases("link_rebind", ["array<string>", "string", "string"], "VARCHAR[]", [(["a", "b"], "a", "c", ["b", "c"]), (["a"], "x", "a", ["a"]), ([], "x", "y", ["y"])], rematch.rebind_array, "ST6.")
cases("link_fusion_status", ["int", "int"], "VARCHAR", [(0, 3, "unlinked"), (3, 3, "linked"), (1, 3, "partial"), (0, 0, "unlinked")], fuse.fusion_status, "GR10.")
