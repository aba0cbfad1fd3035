"""Operators on small literal rows whose answers were worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.functions.values import calibrated, json_equals, missing_features, month_period, set_scores, subset, title_month
from sparquill.operators import corpus as C
from sparquill.operators import costing as K
from sparquill.operators import evaluation as E
from sparquill.operators import relational as R
from sparquill.operators import retrieval as S
from sparquill.operators.costing import resolve_codes
from sparquill.plans.registry import rows
from sparquill.sources.tables import layout_blocks
from tests.compare import both, connect

CASES = {}


def query(name, sql):
    return lambda run: CASES.update({name: (run, sql)}) or run


@pytest.fixture(scope="module")
def tables():
    return connect("/root/testdata/sf0.001")


@query(
    "name_normalising",
    "SELECT * FROM (VALUES (1, '干混砂浆m7.5', 'ｘ干混砂浆m7.5', 'm³'), (2, 'phi48', 'phi4848', '块'), (3, '', '', '')) t(id, plain, canonical, unit)",
)
def name_normalising(spark, sf_dir):
    given = rows(spark, "id int, name string, spec string, unit string", (1, "ｘ干混 砂浆（M7.5）", None, "$m^3$"), (2, "PHI48", "(48)", " 块"), (3, None, None, None))
    return given.select("id", T.plain_name(F.col("name")).alias("plain"), T.canonical_key(F.col("name"), F.col("spec")).alias("canonical"), T.canonical_unit(F.col("unit")).alias("unit"))


@query("unit_factors", "SELECT * FROM (VALUES (1, CAST(1000 AS DOUBLE)), (2, 1.0), (3, NULL)) t(id, factor)")
def unit_factors(spark, sf_dir):
    given = rows(spark, "id int, a string, b string", (1, "千块", "块"), (2, "$m^3$", "m3"), (3, "t", "kg"))
    return given.select("id", T.unit_factor(F.col("a"), F.col("b")).alias("factor"))


@query(
    "number_extraction",
    """SELECT * FROM (VALUES (1, '-1.5|20%|3e2|.5', '-1.5|20|300|0.5'), (2, '', ''), (3, '7', '7')) t(id, written, "values")""",
)
def number_extraction(spark, sf_dir):
    given = rows(spark, "id int, t string", (1, "at -1.5, 20% or 3e2; .5 x2 a3"), (2, "none"), (3, "7"))
    found = F.transform(T.number_values(F.col("t")), lambda x: F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    return given.select("id", F.concat_ws("|", T.numbers(F.col("t"))).alias("written"), F.concat_ws("|", found).alias("values"))


@query("number_conflicts", "SELECT * FROM (VALUES (1, false), (2, true), (3, false)) t(id, conflict)")
def number_conflicts(spark, sf_dir):
    given = rows(spark, "id int, a string, b string", (1, "10 和 20 和 30", "10 20 mm"), (2, "10 和 20 和 30 和 2", "40 mm"), (3, "10 20 30", "无"))
    return given.select("id", T.numbers_conflict(F.col("a"), F.col("b")).alias("conflict"))


@query(
    "clause_citations",
    """SELECT * FROM (VALUES (1, 'GB50010-2010_8.2.1|GB50011-2010_5.1'), (2, 'JGJ3-2010_4.2|GB50009-2012_3.1.2'), (3, 'GB50007-2011_5.2.1'), (4, 'GB50300-2013_3.0.6')) t(id, cited)""",
)
def clause_citations(spark, sf_dir):
    given = rows(
        spark, "id int, t string, std string",
        (1, "按 GB 50010—2010 第8.2.1条，《抗规》第5.1条，GB50010 8.2.1", ""), (2, "荷规3.1.2款与 JGJ3 4.2", ""), (3, "见第 5.2.1 条", "GB50007"), (4, "GB/T 50300-2013 3.0.6 条", ""),
    )
    return given.select("id", F.concat_ws("|", T.citations(F.col("t"), F.col("std"))).alias("cited"))


@query(
    "typed_references",
    """SELECT * FROM (VALUES (1, '5.3.4', 'strong'), (1, '6.1', 'exclude'), (1, '7.2', 'weak'), (2, '8.2.1', 'cross_standard')) t(id, "to", "type")""",
)
def typed_references(spark, sf_dir):
    given = rows(spark, "id int, t string", (1, "应符合5.3.4的规定，厚度为2.5mm，见图3.1；本工程各部位均除6.1外；一般情形下的做法参照7.2"), (2, "GB50010第8.2.1条"))
    return given.select("id", F.inline(T.typed_references(F.col("t"))))


@query("refusals", "SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(id, refused)")
def refusals(spark, sf_dir):
    given = rows(spark, "id int, t string", (1, "信息不足，无法回答"), (2, "厚度为20mm"), (3, "建议由现场专业人员处理"))
    return given.select("id", T.is_refusal(F.col("t")).alias("refused"))


@query("numbered_lists", "SELECT * FROM (VALUES (1, 'a|b|c'), (2, 'plain'), (3, '厚 1.5|宽')) t(id, entries)")
def numbered_lists(spark, sf_dir):
    given = rows(spark, "id int, t string", (1, "1.a2.b3、c"), (2, "plain"), (3, "1.厚 1.5 2.宽"))
    return given.select("id", F.concat_ws("|", T.numbered_list(F.col("t"))).alias("entries"))


@query(
    "heading_paths",
    """SELECT * FROM (VALUES (1, '附录E', 1.0, NULL, 1), (2, 'E.1.2', 1.0, 'E.1', 3), (3, '5.3.4', 1.0, '5.3', 3), (4, NULL, NULL, NULL, 1), (5, '前言', 0.6, NULL, 1), (6, 'E.1', 1.0, '附录E', 2))
    t(id, path, confidence, parent, depth)""",
)
def heading_paths(spark, sf_dir):
    given = rows(spark, "id int, t string", (1, "附录E 钢筋计算"), (2, "E.1.2 细则"), (3, "5.3.4 构造"), (4, "5.3节的规定"), (5, "前言"), (6, "E.1 总则"))
    p = T.heading_path(F.col("t"))
    return given.select("id", p.alias("path"), T.heading_confidence(F.col("t")).alias("confidence"), T.path_parent(p).alias("parent"), F.coalesce(T.path_depth(p), F.lit(1)).alias("depth"))


@query("verdicts", "SELECT * FROM (VALUES (1, true), (2, false), (3, NULL), (4, NULL)) t(id, verdict)")
def verdicts(spark, sf_dir):
    given = rows(spark, "id int, t string", (1, "<think>no</think> YES"), (2, "No."), (3, "yes or no"), (4, None))
    return given.select("id", T.verdict(F.col("t")).alias("verdict"))


@query("month_periods", "SELECT * FROM (VALUES (1, '2024-03', DATE '2024-03-01', DATE '2024-04-01'), (2, '2023-12', DATE '2023-12-01', DATE '2024-01-01'), (3, NULL, NULL, NULL)) t(id, month, start, \"end\")")
def month_periods(spark, sf_dir):
    given = rows(spark, "id int, t string", (1, "深圳 2024年3月信息价"), (2, "2023-12 期"), (3, "无"))
    m = title_month(F.col("t"))
    return given.select("id", m.alias("month"), month_period(m)["start"].alias("start"), month_period(m)["end"].alias("end"))


@query(
    "typed_json",
    """SELECT * FROM (VALUES (1, false, false, true, false, true, false), (2, false, true, false, false, false, false), (3, true, false, false, false, false, false), (4, false, false, false, false, false, false),
    (5, false, false, false, true, false, false), (6, false, false, false, false, false, true)) t(id, is_null, is_true, is_one, is_text, is_float, is_half)""",
)
def typed_json(spark, sf_dir):
    given = rows(spark, "id int, j string", (1, '{"k": 1}'), (2, '{"k": true}'), (3, '{"k": null}'), (4, '{"x": 1}'), (5, '{"k": "1"}'), (6, '{"k": 0.5}'))
    j = F.col("j")
    return given.select(
        "id", json_equals(j, "k", None).alias("is_null"), json_equals(j, "k", True).alias("is_true"), json_equals(j, "k", 1).alias("is_one"), json_equals(j, "k", "1").alias("is_text"),
        json_equals(j, "k", 1.0).alias("is_float"), json_equals(j, "k", 0.5).alias("is_half"),
    )


@query("array_predicates", "SELECT * FROM (VALUES (1, true, ''), (2, false, 'size,colour')) t(id, passed, missing)")
def array_predicates(spark, sf_dir):
    given = rows(spark, "id int, need array<string>, have array<string>", (1, ["a"], ["a", "b"]), (2, ["size", "colour"], ["weight 3"]))
    return given.select("id", subset(F.col("need"), F.col("have")).alias("passed"), F.concat_ws(",", missing_features(F.col("need"), F.col("have"))).alias("missing"))


_HTML = '<table><tr><th colspan="2">a</th><th rowspan="2">b</th></tr><tr><td>1</td><td>2</td></tr></table><p>x</p><table><tr><td>z</td></tr></table>'


@query("html_table_grid", "SELECT * FROM (VALUES (1, 0, 0, 'a||b'), (1, 0, 1, '1|2|b'), (1, 1, 0, 'z')) t(page_id, \"table\", \"row\", cells)")
def html_table_grid(spark, sf_dir):
    given = rows(spark, "page_id int, html string", (1, _HTML), (2, None), (3, "<p>no table</p>"))
    return C.html_tables(given, "page_id", "html").withColumn("cells", F.concat_ws("|", "cells"))


@query("table_markdown", "SELECT 1 AS page_id, '| a |  | b |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| 1 | 2 |  |' AS md")
def table_markdown(spark, sf_dir):
    return rows(spark, "page_id int, html string", (1, _HTML)).select("page_id", C.table_markdown(F.col("html")).alias("md"))


@query("header_detection", "SELECT * FROM (VALUES ('s', 2, 3)) t(sheet, line, score)")
def header_detection(spark, sf_dir):
    given = rows(spark, "sheet string, line int, cells array<string>", ("s", 1, ["工程"]), ("s", 2, ["项目编码", "项目名称", "计量单位"]), ("s", 3, ["编码", "名称", "单位"]))
    return C.header_row(given, "sheet", "line", "cells", ["编码", "名称", "单位"])


@query("matrix_links", "SELECT * FROM (VALUES ('q1', '人工', 1.5), ('q2', '人工', 2.0), ('q2', '水泥', 0.3)) t(item, name, value)")
def matrix_links(spark, sf_dir):
    given = rows(spark, "id int, items array<string>, names array<string>, cells array<array<string>>", (1, ["q1", "q2"], ["人工", "水泥"], [["1.5", "2"], ["-", "0.3"]]))
    return C.matrix_links(given, ["id"], "items", "names", "cells").select("item", "name", "value")


_STANDARD = "# 1 总则\n1.0.1 为了统一。\n续行\n## 2 大偏心\n# 2 术语\n2.0.1 结构\n# 附录A 材料\n表格\nA.0.1 明细\n# 条文说明\n1.0.1 解释"


@query(
    "clause_segmentation",
    """SELECT * FROM (VALUES ('1.0.1', '1 总则', 14), ('2.0.1', '2 术语', 8), ('A.0', '附录A 材料', 2), ('A.0.1', '附录A 材料', 8)) t(clause_no, chapter, char_len)""",
)
def clause_segmentation(spark, sf_dir):
    made = C.segment(rows(spark, "doc_id string, text string", ("s", _STANDARD.replace("## 2 大偏心\n", ""))), "doc_id", "text")
    return made.select("clause_no", F.concat_ws(" > ", "chapter_path").alias("chapter"), "char_len")


@query("numbering_gaps", "SELECT * FROM (VALUES ('s', '3.1.7', 2)) t(doc_id, clause_no, previous)")
def numbering_gaps(spark, sf_dir):
    given = rows(spark, "doc_id string, clause_no string", *[("s", c) for c in ("3.1.1", "3.1.2", "3.1.7", "3.2.1", "3.2.4", "9")])
    return C.numbering_gaps(given, ["doc_id"]).select("doc_id", "clause_no", "previous")


@query("toc_runs", "SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, true), (5, false), (6, false)) t(idx, is_toc)")
def toc_runs(spark, sf_dir):
    given = rows(spark, "doc string, idx int, text string", *[("d", i, t) for i, t in enumerate(["总则 … 1", "术语 … 3", "设计 … 5", "附录 …… 9", "正文", "厚度 25"], 1)])
    return C.mark_toc(given, ["doc"], "idx", "text").select("idx", "is_toc")


@query("toc_location", "SELECT * FROM (VALUES (1, NULL, 'front'), (2, '总则', 'match'), (3, '总则', 'inherited'), (4, '设计', 'match'), (5, '设计', 'inherited')) t(idx, entry, source)")
def toc_location(spark, sf_dir):
    blocks = rows(spark, "doc string, idx int, text string", *[("d", i, t) for i, t in enumerate(["封面", "总 则", "文字", "设计", "总则"], 1)])
    entries = rows(spark, "doc string, idx int, title string", ("d", 1, "总则"), ("d", 2, "术语"), ("d", 3, "设计"))
    return C.locate(blocks, "doc", "idx", "text", entries, "title").select("idx", "entry", "source")


_NODES = [("1", 1), ("1.1", 2), ("1.1.1.1", 3), ("附录E", 4), ("E.1.1", 5), ("前言", 6), ("1.2", 7)]


def _tree(spark):
    return C.resolve_parents(rows(spark, "doc string, path string, ord int", *[("d", p, o) for p, o in _NODES]), ["doc"], "path")


@query("parent_resolution", "SELECT * FROM (VALUES ('1', NULL), ('1.1', '1'), ('1.1.1.1', '1.1'), ('附录E', NULL), ('E.1.1', '附录E'), ('前言', NULL), ('1.2', '1')) t(path, parent)")
def parent_resolution(spark, sf_dir):
    return _tree(spark).select("path", "parent")


@query("children_lists", "SELECT * FROM (VALUES ('1', '1.1,1.2'), ('1.1', '1.1.1.1'), ('附录E', 'E.1.1')) t(path, children)")
def children_lists(spark, sf_dir):
    return C.children(_tree(spark), ["doc"], "path", "ord").select("path", F.concat_ws(",", "children").alias("children"))


@query("ancestor_chains", "SELECT * FROM (VALUES ('1.1', '1'), ('1.1.1.1', '1>1.1'), ('E.1.1', '附录E'), ('1.2', '1')) t(node, chain)")
def ancestor_chains(spark, sf_dir):
    return C.ancestor_chain(_tree(spark).select(F.col("path").alias("node"), "parent")).select("node", F.concat_ws(">", "chain").alias("chain"))


@query("tree_pruning", "SELECT * FROM (VALUES ('1'), ('1.1'), ('1.1.1.1'), ('前言')) t(node)")
def tree_pruning(spark, sf_dir):
    nodes = _tree(spark).select(F.col("path").alias("node"), "parent")
    return C.pruned(nodes, F.col("node") == "1.1.1.1", F.col("node") == "前言").select("node")


@query("tree_leaves", "SELECT * FROM (VALUES ('1.1.1.1'), ('E.1.1'), ('1.2')) t(node)")
def tree_leaves(spark, sf_dir):
    nodes = _tree(spark).select(F.col("path").alias("node"), "parent")
    return C.leaves(nodes, F.col("node") != "前言").select("node")


@query("reverse_references", "SELECT * FROM (VALUES ('b', 'a,c'), ('c', 'a')) t(dst, referenced_by)")
def reverse_references(spark, sf_dir):
    edges = rows(spark, "src string, dst string", ("a", "b"), ("a", "b"), ("c", "b"), ("a", "c"), ("a", "zz"), ("b", "b"))
    return C.reversed_edges(edges, rows(spark, "node string", ("a",), ("b",), ("c",))).select("dst", F.concat_ws(",", "referenced_by").alias("referenced_by"))


@query("layout_parsing", "SELECT * FROM (VALUES ('d', 0, 'text', 'Title', 1, 0), ('d', 1, 'table', NULL, NULL, 2)) t(doc, block_idx, \"type\", text, text_level, page)")
def layout_parsing(spark, sf_dir):
    raw = '[{"type": "text", "text": " Title ", "text_level": 1, "page_idx": 0}, {"type": "table", "table_body": "<table></table>", "table_caption": ["c"], "page_idx": 2}]'
    return layout_blocks(rows(spark, "doc string, j string", ("d", raw)), "doc", "j").select("doc", "block_idx", "type", "text", "text_level", "page")


@query("table_rendering", "SELECT 1 AS id, '表1' || chr(10) || 'a | b' || chr(10) || '1 | 2' || chr(10) || '3 | 4' AS t")
def table_rendering(spark, sf_dir):
    given = rows(spark, "id int, c string, h array<string>, b array<array<string>>", (1, "表1", ["a", "b"], [["1", "2"], ["3", "4"]]))
    return given.select("id", T.table_text(F.col("c"), F.col("h"), F.col("b")).alias("t"))


@query("provenance_freshness", "SELECT * FROM (VALUES ('a', 'fresh'), ('b', 'unknown'), ('c', 'stale')) t(grp, status)")
def provenance_freshness(spark, sf_dir):
    return C.freshness(rows(spark, "grp string, fingerprint string", ("a", "f1"), ("b", None), ("c", "f0")), "f1").select("grp", "status")


@query("reference_pairs", "SELECT * FROM (VALUES ('a', 'b'), ('b', 'c')) t(a, b)")
def reference_pairs(spark, sf_dir):
    given = rows(spark, "id string, refs array<string>", ("a", ["b", "b"]), ("b", ["a", "zz"]), ("c", ["b", "c"]))
    return C.existing_pairs(given, "id", "refs")


@query("either_parent_gate", "SELECT * FROM (VALUES (1, 'rejected'), (2, 'kept'), (3, 'kept')) t(id, outcome)")
def either_parent_gate(spark, sf_dir):
    given = rows(spark, "id int, a boolean, b boolean", (1, False, True), (2, None, False), (3, None, None))
    marked = R.split_by_reason(given, rejected=C.either_alone(F.col("a"), F.col("b")))
    return marked.select("id", F.coalesce("reject_reason", F.lit("kept")).alias("outcome"))


@query("roll_up", "SELECT * FROM (VALUES (3.5, 2, 2)) t(total, included, skipped)")
def roll_up(spark, sf_dir):
    return K.roll_up(rows(spark, "amount string", ("1.5",), ("2",), ("x",), (None,)), "amount")


@query("bill_check", "SELECT * FROM (VALUES ('010101001', '', NULL), ('0101', 'invalid code,missing unit', 'error'), ('010101001001', 'missing name', 'warn')) t(code, issues, severity)")
def bill_check(spark, sf_dir):
    given = rows(spark, "code string, name string, unit string", ("010101001", "挖土", "m³"), ("0101", "x", None), ("010101001001", "", "t"))
    return K.check_bill(given).select("code", F.concat_ws(",", "issues").alias("issues"), "severity")


_LINKS = [(1, "b1", "q1", "人工", "普工", None, 1, None, None, 2.0), (2, "b1", "q1", "材料", "砖", "千块", 2, 9, 1000.0, 0.5), (3, "b1", "q1", "机械", "车", None, 3, None, None, 1.0), (4, "b1", "q2", "材料", "水泥", None, 4, None, None, 1.25)]


_PRICES = [(1, "深圳", 80.0, dt.date(2026, 4, 1), dt.date(2026, 5, 1)), (1, "深圳", 90.0, dt.date(2026, 5, 1), dt.date(2026, 6, 1)), (9, "深圳", 0.45, dt.date(2026, 5, 1), dt.date(2026, 6, 1)), (4, "广州", 5.0, dt.date(2026, 5, 1), dt.date(2026, 6, 1)), (4, "深圳", 6.25, dt.date(2026, 3, 1), None)]


def _composed(spark, on=None):
    links = rows(spark, "link_id int, code string, quota_code string, category string, res_name string, spec string, resource_id int, price_resource_id int, unit_factor double, consumption double", *_LINKS)
    return K.compose(links, rows(spark, "rp_resource_id int, region string, price double, period_start date, period_end date", *_PRICES), on, "深圳")


@query("price_composition", "SELECT * FROM (VALUES (1, 90.0, 'direct', 180.0, 'matched'), (2, 0.45, 'mapped', 225.0, 'matched'), (3, NULL, NULL, NULL, 'no_source'), (4, 6.25, 'direct', 7.81, 'matched')) t(link_id, price, via, amount, price_status)")
def price_composition(spark, sf_dir):
    return _composed(spark).select("link_id", "price", "via", F.col("amount").cast("double").alias("amount"), "price_status")


@query("price_composition_on", "SELECT * FROM (VALUES (1, 80.0), (2, NULL), (3, NULL), (4, 6.25)) t(link_id, price)")
def price_composition_on(spark, sf_dir):
    return _composed(spark, dt.date(2026, 4, 15)).select("link_id", "price")


@query("nested_quotas", "SELECT * FROM (VALUES ('b1', 'q1', '普工,砖,车', 405.0, 1), ('b1', 'q2', '水泥', 7.81, 0)) t(code, quota_code, resources, subtotal, unpriced)")
def nested_quotas(spark, sf_dir):
    made = K.nested(_composed(spark), ["code"], ["quota_code"], "res_name", "price")
    return made.select("code", "quota_code", F.concat_ws(",", F.transform("resources", lambda r: r["res_name"])).alias("resources"), F.col("subtotal").cast("double").alias("subtotal"), "unpriced")


@query("missing_prices", "SELECT 'b1::车::' AS price_key")
def missing_prices(spark, sf_dir):
    return K.missing_prices(_composed(spark))


@query("price_write_back", "SELECT * FROM (VALUES ('b1::车::', 300.0, 'manual'), ('b1::普工::', 90.0, 'matched')) t(price_key, unit_price, price_status)")
def price_write_back(spark, sf_dir):
    parts = rows(spark, "price_key string, unit_price double, price_status string", ("b1::车::", None, "no_source"), ("b1::普工::", 90.0, "matched"))
    return K.write_back(parts, rows(spark, "price_key string, unit_price double", ("b1::车::", 300.0)))


@query(
    "quota_schemes",
    "SELECT * FROM (VALUES ('b1', 1, '010001-1|010002-2', 0.8, 30.0), ('b1', 2, '010001-1|010002-1', 0.5, 20.0), ('b2', 1, '010001-1', NULL, 5.0)) t(bill, scheme, codes, score, base_price)",
)
def quota_schemes(spark, sf_dir):
    given = rows(
        spark, "bill string, ordinal int, quota_code string, confidence double, base_price double",
        ("b1", 1, "010001-1", 0.9, 10.0), ("b1", 2, "010002-1", 0.5, 10.0), ("b1", 3, "010002-2", 0.8, 20.0), ("b2", 1, "010001-1", None, 5.0),
    )
    return K.schemes(given, "bill").withColumn("codes", F.concat_ws("|", "codes"))


@query("price_trend", "SELECT * FROM (VALUES ('砖', '2026-03', '2026-05', 0.05, 12.5), ('砖', '2026-05', '2026-06', -0.05, -11.11)) t(name, from_period, to_period, delta, pct)")
def price_trend(spark, sf_dir):
    given = rows(spark, "name string, spec string, period string, price string", ("砖", "a", "2026-03", "0.40"), ("砖", "a", "2026-05", "0.45"), ("砖", "a", "2026-06", "0.40"), ("砖", "b", "2026-05", "1"), ("灰", "a", "2026-03", "0"), ("灰", "a", "2026-05", "3"))
    return K.trend(given, ["name", "spec"], "period", "price").drop("spec")


@query("rule_table", "SELECT * FROM (VALUES (1, '管理费', 0.1), (2, '利润', 0.05), (3, NULL, NULL)) t(id, fee, rate)")
def rule_table(spark, sf_dir):
    given = rows(spark, "id int, t string", (1, "企业管理费率 建筑"), (2, "利润率"), (3, "其他"))
    rules = [{"contains": ["管理费", "建筑"], "fee": "管理费", "rate": 0.1}, {"contains": ["利润"], "fee": "利润", "rate": 0.05}]
    return K.apply_rules(given, "t", rules, ["fee", "rate"]).select("id", "fee", "rate")


def _answers(spark):
    evals = rows(
        spark, "id int, type string, question string, gold_clauses array<string>, gold_values array<string>, should_refuse boolean",
        (1, "clause", "按《混规》8.2.1", ["GB50010-2010_8.2.1", "GB50010-2010_8.2.2"], ["20"], False), (2, "clause", "问", ["GB50011-2010_5.1"], [], False),
        (3, "number", "问", [], ["0.20", "7"], False), (4, "refuse", "问", [], [], True),
    )
    answers = rows(
        spark, "id int, model_id string, answer string, finish_reason string, completion_tokens int",
        (1, "m", "GB50010-2010 第8.2.1条，厚 20.0 mm", "stop", 10), (2, "m", "第5.1条和第9.9条", "stop", 20), (3, "m", "0.2", "length", 30), (4, "m", "信息不足", "stop", None),
    )
    return E.score_answers(evals, answers, rows(spark, "clause_id string", ("GB50010-2010_8.2.1",), ("GB50011-2010_5.1",)))


@query(
    "answer_scores",
    """SELECT * FROM (VALUES (1, 1, 1, 2, 1.0, 0.5, 0.6667, 1, 1, true, false, ''), (2, 1, 2, 1, 0.5, 1.0, 0.6667, 0, 0, NULL, false, 'GB50011-2010_9.9'), (3, 0, 0, 0, NULL, NULL, NULL, 2, 1, false, false, ''),
    (4, 0, 0, 0, NULL, NULL, NULL, 0, 0, NULL, true, '')) t(id, clause_tp, clause_predicted, clause_gold, clause_precision, clause_recall, clause_f1, numeric_gold, numeric_matched, numeric_exact, refusal_pred, invalid)""",
)
def answer_scores(spark, sf_dir):
    cols = ["id", "clause_tp", "clause_predicted", "clause_gold", "clause_precision", "clause_recall", "clause_f1", "numeric_gold", "numeric_matched", "numeric_exact", "refusal_pred"]
    return _answers(spark).select(*cols, F.concat_ws(",", "invalid_clauses").alias("invalid"))


@query(
    "answer_summary",
    """SELECT * FROM (VALUES ('all', 4, 0.75, 0.75, 0.6667, 0.6667, 0.25, 0.5, 0.6667, 1.0, 0.0, 0.25, 20.0), ('clause', 2, 0.75, 0.75, 0.6667, 0.6667, 0.5, 1.0, 1.0, NULL, 0.0, 0.0, 15.0),
    ('number', 1, NULL, NULL, NULL, NULL, 0.0, 0.0, 0.5, NULL, 0.0, 1.0, 30.0), ('refuse', 1, NULL, NULL, NULL, NULL, 0.0, NULL, NULL, 1.0, NULL, 0.0, NULL))
    t(scope, n, clause_precision, clause_recall, clause_f1, clause_f1_micro, hard_hallucination_rate, numeric_exact_accuracy, numeric_value_accuracy, refusal_recall, false_refusal_rate, truncated_rate, avg_completion_tokens)""",
)
def answer_summary(spark, sf_dir):
    cols = ["scope", "n", "clause_precision", "clause_recall", "clause_f1", "clause_f1_micro", "hard_hallucination_rate", "numeric_exact_accuracy", "numeric_value_accuracy", "refusal_recall", "false_refusal_rate", "truncated_rate", "avg_completion_tokens"]
    return E.summarize(_answers(spark)).select(*cols)


@query("set_metrics", "SELECT * FROM (VALUES (1, 0.5, 1.0, 0.6667), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)) t(id, \"precision\", recall, f1)")
def set_metrics(spark, sf_dir):
    given = rows(spark, "id int, p array<string>, g array<string>", (1, ["a", "b", "a"], ["a"]), (2, [], ["a"]), (3, [], []))
    return given.select("id", set_scores(F.col("p"), F.col("g")).alias("s")).select("id", "s.*")


@query("first_hits", "SELECT * FROM (VALUES (1, 2), (2, NULL)) t(query_id, rank)")
def first_hits(spark, sf_dir):
    ranked = rows(spark, "query_id int, id string, rank int", (1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1))
    return S.first_hit(ranked, rows(spark, "query_id int, id string", (1, "b"), (1, "c"), (2, "z")))


@query("selection_metrics", "SELECT 4 AS n, 0.75 AS recall_at_k, 0.5 AS top1, 0.6667 AS top1_given_recalled, 0.5 AS auto_accept_acc, 0.5 AS review_rate, 2 AS n_auto_accept, 3 AS n_recalled, 1 AS n_dangerous")
def selection_metrics(spark, sf_dir):
    given = rows(
        spark, "gold array<string>, candidates array<string>, code string, confidence double, need_review boolean",
        (["a"], ["a", "b"], "a", 0.9, False), (["a"], ["a"], "b", 0.8, False), (["a"], ["a"], "a", 0.4, True), (["a"], ["c"], None, 0.0, None),
    )
    return E.selection_metrics(E.selection_flags(given))


@query("confidence_calibration", "SELECT * FROM (VALUES (1, 0.5), (2, 0.3), (3, 0.9), (4, 0.2)) t(id, confidence)")
def confidence_calibration(spark, sf_dir):
    given = rows(spark, "id int, own double, s double, r double", (1, 0.9, 0.6, None), (2, 0.3, 0.8, 0.1), (3, 0.9, None, None), (4, 0.9, 0.8, 0.78))
    return given.select("id", calibrated(F.col("own"), F.col("s"), F.col("r"), 0.5, 0.7, 0.1).alias("confidence"))


@query("ablation_deltas", "SELECT * FROM (VALUES ('a', 'f1', 5.0, 'better'), ('a', 'latency', 10.0, 'worse'), ('b', 'f1', 0.04, 'same'), ('b', 'latency', -10.0, 'better')) t(config, metric, delta_pp, direction)")
def ablation_deltas(spark, sf_dir):
    given = rows(spark, "config string, metric string, v double", ("base", "f1", 0.5), ("base", "latency", 0.3), ("a", "f1", 0.55), ("a", "latency", 0.4), ("b", "f1", 0.5004), ("b", "latency", 0.2))
    return E.deltas_to(given, "config", "metric", "v", "base", F.col("metric") != "latency").select("config", "metric", "delta_pp", "direction")


@query("severity_verdicts", "SELECT * FROM (VALUES ('a', 'fail'), ('b', 'doubt'), ('c', 'pass')) t(id, verdict)")
def severity_verdicts(spark, sf_dir):
    given = rows(spark, "id string, severity string", ("a", "warn"), ("a", "critical"), ("b", "warn"), ("b", "info"), ("c", None))
    return given.groupBy("id").agg(E.verdict_of(F.col("severity")).alias("verdict"))


@query("citation_faithfulness", "SELECT * FROM (VALUES (1, 'faithful', 1.0, '', 0.5), (2, 'unfaithful', 0.5, 'z', 1.0), (3, 'no_citation', NULL, '', NULL)) t(id, verdict, rate, phantom, recall)")
def citation_faithfulness(spark, sf_dir):
    given = rows(spark, "id int, cited array<string>, evidence array<string>, gold array<string>", (1, ["a", "a"], ["a", "b"], ["b", "c"]), (2, ["a", "z"], ["a"], ["a"]), (3, [], ["a"], []))
    f = E.faithfulness(F.col("cited"), F.col("evidence"))
    return given.select("id", f["verdict"].alias("verdict"), f["rate"].alias("rate"), F.concat_ws(",", f["phantom"]).alias("phantom"), E.context_recall(F.col("gold"), F.col("evidence")).alias("recall"))


@query("gold_anchoring", "SELECT * FROM (VALUES (1, '20mm'), (2, '')) t(id, kept)")
def gold_anchoring(spark, sf_dir):
    given = rows(spark, "id int, v array<string>, t string", (1, ["20mm", "30mm", "厚度"], "厚度不小于20mm"), (2, ["5"], "无"))
    return given.select("id", F.concat_ws(",", E.anchored(F.col("v"), F.col("t"))).alias("kept"))


@query("routing_rates", "SELECT 4 AS n, 0.5 AS route_rate, 0.6667 AS clarify_rate, 0.25 AS halt_rate")
def routing_rates(spark, sf_dir):
    given = rows(
        spark, "routed boolean, expect_route boolean, clarified boolean, expect_clarify boolean, halted boolean",
        (True, True, False, False, False), (False, True, True, False, False), (True, None, False, False, None), (True, True, True, True, True),
    )
    return E.routing_rates(given)


@query(
    "null_safe_upsert",
    """
    WITH old AS (SELECT * FROM (VALUES ('a', CAST(NULL AS VARCHAR), 1), ('b', 'x', 2), (NULL, NULL, 3)) t(name, spec, v)),
         new AS (SELECT * FROM (VALUES ('a', CAST(NULL AS VARCHAR), 10), ('c', 'y', 20), (NULL, NULL, 30)) t(name, spec, v))
    SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.name IS NOT DISTINCT FROM o.name AND n.spec IS NOT DISTINCT FROM o.spec)
    """,
)
def null_safe_upsert(spark, sf_dir):
    old = rows(spark, "name string, spec string, v int", ("a", None, 1), ("b", "x", 2), (None, None, 3))
    new = rows(spark, "name string, spec string, v int", ("a", None, 10), ("c", "y", 20), (None, None, 30))
    return R.upsert(old, new, ["name", "spec"], "v")


@query("code_merge", "SELECT * FROM (VALUES ('010101001', 'm³,m', '挖土方'), ('010101003', 't', '钢筋')) t(code, units, name)")
def code_merge(spark, sf_dir):
    given = rows(
        spark, "ordinal int, code string, name string, unit string",
        (1, "010101001", "挖土方", "m³"), (2, "010101001", "挖 土方", "m"), (3, "010101001", "挖土方", "m³"), (4, "010101002", "回填", "m³"), (5, "010101002", "运土", "m³"), (6, "010101003", "钢筋", "t"),
    )
    merged, _ = resolve_codes(given, ["code"], T.resource_text(F.col("name")))
    return merged.select("code", F.concat_ws(",", "units").alias("units"), "name")


@query("code_conflicts", "SELECT * FROM (VALUES (4, '010101002'), (5, '010101002')) t(ordinal, code)")
def code_conflicts(spark, sf_dir):
    given = rows(spark, "ordinal int, code string, name string, unit string", (1, "010101001", "挖土方", "m³"), (2, "010101001", "挖 土方", "m"), (4, "010101002", "回填", "m³"), (5, "010101002", "运土", "m³"))
    return resolve_codes(given, ["code"], T.resource_text(F.col("name")))[1].select("ordinal", "code")


@query("canonical_key_join", "SELECT * FROM (VALUES (1, 'matched', 7), (2, 'matched', 8), (3, 'none', NULL)) t(id, status, price_id)")
def canonical_key_join(spark, sf_dir):
    quota = rows(spark, "id int, name string, spec string", (1, "干混砌筑砂浆 M7.5", None), (2, "钢管（Φ48×3.5）", None), (3, "电焊条", None))
    price = rows(spark, "price_id int, name string, spec string", (7, "干混砌筑砂浆", "m7.5"), (8, "钢管", "Φ48x3.5"), (9, "钢管 ", "φ48×3.5"))
    key = T.canonical_key(F.col("name"), F.col("spec"))
    best = R.best_by(price.select(key.alias("k"), "price_id"), ["k"], F.col("price_id"))
    found = quota.withColumn("k", key).join(best, "k", "left")
    return found.select("id", F.when(F.col("price_id").isNotNull(), "matched").otherwise("none").alias("status"), "price_id")


@query("until_blank_run", "SELECT * FROM (VALUES ('a', 1), ('a', 3), ('b', 1)) t(sheet, line)")
def until_blank_run(spark, sf_dir):
    given = rows(spark, "sheet string, line int, v string", ("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("a", 4, ""), ("a", 5, ""), ("a", 6, "z"), ("b", 1, "x"), ("b", 2, ""))
    return R.until_blank_run(given, ["sheet"], "line", F.col("v") == "", 2).select("sheet", "line")


@query(
    "gram_similarity",
    """
    WITH w AS (SELECT * FROM (VALUES ('cold widget', 'warm widget'), ('a', 'a'), ('', 'b'), ('steel pipe', 'pipe steel')) t(x, y)),
    n AS (SELECT x, y, replace(x, ' ', '') AS p, replace(y, ' ', '') AS q FROM w),
    g AS (SELECT x, y, CASE WHEN length(p) = 0 THEN [] WHEN length(p) = 1 THEN [p] ELSE list_distinct([substr(p, i, 2) for i in range(1, length(p))]) END AS a,
                 CASE WHEN length(q) = 0 THEN [] WHEN length(q) = 1 THEN [q] ELSE list_distinct([substr(q, i, 2) for i in range(1, length(q))]) END AS b FROM n)
    SELECT x, y, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS coverage,
           round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM g
    """,
)
def gram_similarity(spark, sf_dir):
    given = rows(spark, "x string, y string", ("cold widget", "warm widget"), ("a", "a"), ("", "b"), ("steel pipe", "pipe steel"))
    a, b = T.grams(F.col("x")), T.grams(F.col("y"))
    return given.select("x", "y", F.round(T.coverage(a, b), 6).alias("coverage"), F.round(T.jaccard(a, b), 6).alias("jaccard"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_by_hand(spark, tables, name):
    ours, theirs = both(spark, tables, *CASES[name], "/root/testdata/sf0.001")
    assert ours == theirs
