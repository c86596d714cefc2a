"""Blocks, contents, audits and training rows."""

from pyspark.sql import functions as F

from evidentia.functions import blocks
from evidentia.operators import audits, toc, training


def test_blocks(spark):
    df = spark.createDataFrame(
        [("text", "a", None, None, None), ("list", None, ["A", " ", "B"], None, None), ("image", None, None, ["Fig. 1"], "x"), ("page_header", "h", None, None, None), ("table", None, None, ["Table 1: t"], "z")],
        "kind string, body string, items array<string>, caption array<string>, content string",
    )
    c = F.col
    assert [r[0] for r in df.select(blocks.block_text(c("kind"), c("body"), c("items"), c("caption"), c("content"))).collect()] == ["a", "A\n \nB", "Fig. 1\nx", "", "Table 1: t"]
    assert [r[0] for r in df.select(blocks.prose(c("kind"), c("body"), c("items"))).collect()] == ["a", "A\nB", None, None, None]
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(blocks.is_table(F.lit("table"), F.lit("Figure 2"))) is False and one(blocks.is_table(F.lit("code"), F.lit("Table 2")))
    assert one(blocks.exclusion_reason(F.lit("Department of X"), F.lit(1))) == "front_page_author_or_affiliation"
    assert one(blocks.evidence_units(F.lit("Score is 40.2. Ok. It is better；then worse"))) == ["Score is 40.2. Ok.", "It is better；", "then worse"]
    assert one(blocks.predicted_label(F.lit(None), F.lit(None).cast("boolean"), F.lit(0.5), 0.5)) == 0 and one(blocks.label_of(F.lit("Mismatch"))) == 1


def test_contents(spark):
    lines = spark.createDataFrame([("d", 0, "1 Introduction ..... 2"), ("d", 1, "1.1. Data 4"), ("d", 2, "plain")], "doc string, idx int, line string")
    rows = toc.entries(lines).orderBy("idx").collect()
    assert [(r["label"], r["title"], r["page"], r["depth"]) for r in rows] == [("1", "Introduction", 2, 1), ("1.1", "Data", 4, 2)]
    heads = spark.createDataFrame([("d", 5, "1", "Introduction", 3), ("d", 9, "", "data and more", 8), ("d", 12, "", "References", 9)], "doc string, content_index int, label string, title string, page int")
    got = {r["idx"]: (r["page"], r["page_source"]) for r in toc.with_heading_pages(toc.entries(lines), heads).collect()}
    assert got == {0: (3, "heading_match"), 1: (4, "toc_page_number")}
    assert [(r["title"], r["page"]) for r in toc.back_matter(heads, heads.where("page = 3")).collect()] == [("References", 9)]
    starts = spark.createDataFrame([("d", 0, "A", 3), ("e", 0, "B", 1)], "doc string, idx int, title string, start_page int")
    assert toc.with_preface(starts).where("title = 'Preface'").count() == 1


def test_audits(spark):
    tables = spark.createDataFrame([("d", "n1", 0, 1, [1.0], "Table 1", "c", "p", None), ("d", "n2", 7, 1, [1.0], "Table 2", None, "p", "q")], "doc string, node_id string, raw_index int, page int, bbox array<double>, label string, caption string, parent_id string, expected_parent string")
    source = spark.createDataFrame([("d", 0, "table", 1, [1.0], "Table 1 c")], "doc string, content_index int, kind string, page int, bbox array<double>, caption string")
    got = {r["node_id"]: (r["flags"], r["status"]) for r in audits.position_audit(tables, source).collect()}
    assert got["n1"] == ([], "pass") and got["n2"] == (["raw_content_index_out_of_range", "override_parent_mismatch", "caption_label_fallback"], "fail")
    a = spark.createDataFrame([("p", "t", "c1", "we use five seeds for all"), ("p", "t", "c2", "pure pointer")], "paper string, label string, child_id string, text string")
    b = spark.createDataFrame([("p", "t", "e1", "for all runs we use five ran- dom seeds"), ("p", "u", "e2", "x")], "paper string, label string, evidence_id string, text string")
    rows = {r["label"]: (r["selected"], r["selected_matched"], r["reference"], r["reference_matched"]) for r in audits.against_reference(a, b).collect()}
    assert rows == {"t": (2, 1, 1, 1), "u": (0, 0, 1, 0)}
    gold = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0)], "k int, gold_label int")
    done = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "k int, final_label int")
    assert {r["category"]: r["n"] for r in audits.errors(gold, done, ["k"]).collect()} == {"agreement": 1, "false_positive": 1, "false_negative": 1, "unreviewed_human_example": 1}
    anchors = spark.createDataFrame([("d", "table 1", 9, [1.0], "c")], "doc string, label string, page_index int, bbox array<double>, caption string")
    over = spark.createDataFrame([("d", "table 1", 1, None, None), ("d", "table 5", 1, None, None)], anchors.schema)
    patched, bad = audits.with_overrides(anchors, over)
    assert patched.first()["page_index"] == 1 and bad.first()["reason"] == "anchor_override_target_count"
    n = spark.createDataFrame([("x", 4)], "k string, n int")
    assert audits.before_after(n, n.withColumn("n", F.lit(1)), "k", "n").first()["reduction"] == 0.75


def test_training(spark):
    body = "<Ground Truth>facts</Ground Truth> and <Citation Sentence>claim</Citation Sentence>"
    rows = training.pair_rows(spark.createDataFrame([("a", body, "true"), ("b", " raw  text ", "no")], "id string, input string, match string"))
    got = {r["id"]: (r["label"], r["text_a"], r["status"]) for r in rows.collect()}
    assert got["a"] == (0, "cited paper facts: facts", "structured_sections") and got["b"][1] == "raw text"
    assert training.faults(rows).count() == 1 and training.overlap(rows, rows.where("id = 'a'")).count() == 1
