"""Queries of document structure on literal inputs, since the driver's tables hold no layout; their SQL lists the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import blocks
from evidentia.operators import audits, toc, training
from evidentia.plans.on_text import t


def block_texts(spark, sf_dir):
    """Text, prose and table test of one block of each kind."""
    rows = [("text", "a", None, None, None), ("list", None, ["A", " ", "B"], None, None), ("image", None, None, ["Fig. 1"], "x"), ("page_header", "h", None, None, None), ("table", None, None, ["Table 1: t"], "z"), ("code", None, None, ["Table 2"], "y")]
    df = spark.createDataFrame(rows, "kind string, body string, items array<string>, caption array<string>, content string")
    c = F.col
    cap = F.coalesce(F.array_join("caption", " "), F.lit(""))
    return df.select("kind", blocks.block_text(c("kind"), c("body"), c("items"), c("caption"), c("content")).alias("text"), blocks.prose(c("kind"), c("body"), c("items")).alias("prose"), blocks.is_table(c("kind"), cap).alias("is_table"))


BLOCK_TEXTS = """SELECT * FROM (VALUES ('text', 'a', 'a', false), ('list', 'A' || chr(10) || ' ' || chr(10) || 'B', 'A' || chr(10) || 'B', false), ('image', 'Fig. 1' || chr(10) || 'x', NULL, false),
 ('page_header', '', NULL, false), ('table', 'Table 1: t', NULL, true), ('code', 'Table 2' || chr(10) || 'y', NULL, true)) v(kind, text, prose, is_table)"""


def toc_pages(spark, sf_dir):
    """Contents lines, with the pages of their headings where those are close."""
    lines = spark.createDataFrame([("d", 0, "1 Introduction ..... 2"), ("d", 1, "1.1. Data 4"), ("d", 2, "A Appendix 9"), ("d", 3, "plain")], "doc string, idx int, line string")
    heads = spark.createDataFrame([("d", 5, "1", "Introduction", 3), ("d", 9, "", "data and more", 8), ("d", 12, "A", "Appendix A", 9)], "doc string, content_index int, label string, title string, page int")
    return toc.with_heading_pages(toc.entries(lines), heads).select("label", "title", "depth", "page", "page_source")


TOC_PAGES = "SELECT * FROM (VALUES ('1', 'Introduction', 1, 3, 'heading_match'), ('1.1', 'Data', 2, 4, 'toc_page_number'), ('A', 'Appendix', 1, 9, 'heading_match')) v(label, title, depth, page, page_source)"


def evidence_unit_counts(spark, sf_dir):
    units = blocks.evidence_units(F.col("text"))
    d = t(spark, sf_dir, "benchmark").select("item_id", units.alias("u"))
    return d.select("item_id", F.size("u").cast("long").alias("units"), F.sha2(F.array_join("u", "|"), 256).alias("units_sha256"))


EVIDENCE_UNITS = r"""WITH RECURSIVE p AS (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？；;：:\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '') AS parts FROM benchmark),
 r(item_id, k, acc, parts) AS (SELECT item_id, 0, CAST([] AS VARCHAR[]), parts FROM p UNION ALL
 SELECT item_id, k + 1, CASE WHEN len(acc) > 0 AND length(parts[k + 1]) <= 8 THEN list_append(acc[1:len(acc) - 1], acc[len(acc)] || ' ' || parts[k + 1]) ELSE list_append(acc, parts[k + 1]) END, parts FROM r WHERE k < len(parts))
 SELECT item_id, CAST(len(acc) AS BIGINT) AS units, sha256(array_to_string(acc, '|')) AS units_sha256 FROM r WHERE k = len(parts)"""


def position_audit(spark, sf_dir):
    tables = spark.createDataFrame([("d", "n1", 0, 1, [1.0], "Table 1", "c", "p", None), ("d", "n2", 7, 1, [1.0], "Table 2", None, "p", "q"), ("d", "n3", 1, 2, [2.0], "Table 3", "c", "p", None), ("d", "n4", None, 2, [2.0], "x", "c", "p", "p")], "doc string, node_id string, raw_index int, page int, bbox array<double>, label string, caption string, parent_id string, expected_parent string")
    source = spark.createDataFrame([("d", 0, "table", 1, [1.0], "Table 1 c"), ("d", 1, "code", 2, [3.0], "Table 3")], "doc string, content_index int, kind string, page int, bbox array<double>, caption string")
    return audits.position_audit(tables, source).select("node_id", "status", F.array_join("flags", ",").alias("flags"))


POSITION = """SELECT * FROM (VALUES ('n1', 'pass', ''), ('n2', 'fail', 'raw_content_index_out_of_range,override_parent_mismatch,caption_label_fallback'), ('n3', 'fail', 'bbox_mismatch,source_code_promoted_to_table'),
 ('n4', 'fail', 'raw_content_index_missing')) v(node_id, status, flags)"""


def selected_vs_reference(spark, sf_dir):
    a = spark.createDataFrame([("p", "t", "c1", "we use five seeds for all"), ("p", "t", "c2", "pure pointer"), ("q", "t", "c3", "lone")], "paper string, label string, child_id string, text string")
    b = spark.createDataFrame([("p", "t", "e1", "for all runs we use five ran- dom seeds"), ("p", "u", "e2", "x")], "paper string, label string, evidence_id string, text string")
    return audits.against_reference(a, b)


AGAINST = "SELECT paper, label, CAST(a AS BIGINT) AS selected, CAST(b AS BIGINT) AS reference, CAST(c AS BIGINT) AS selected_matched, CAST(d AS BIGINT) AS reference_matched FROM (VALUES ('p', 't', 2, 1, 1, 1), ('p', 'u', 0, 1, 0, 0), ('q', 't', 1, 0, 0, 0)) v(paper, label, a, b, c, d)"


def error_taxonomy(spark, sf_dir):
    """Quality labels as feedback, toxicity as the review of even documents."""
    l = t(spark, sf_dir, "labels")  # noqa: E741
    return audits.errors(l.select("doc_id", F.col("quality").alias("gold_label")), l.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("final_label")), ["doc_id"])


ERRORS = """SELECT CASE WHEN doc_id % 2 <> 0 THEN 'unreviewed_human_example' WHEN toxic = quality THEN 'agreement' WHEN toxic = 0 THEN 'false_positive' ELSE 'false_negative' END AS category, count(*) AS n FROM labels GROUP BY 1"""


def before_after_by_lang(spark, sf_dir):
    """Documents per language before and after leaving out short ones."""
    d = t(spark, sf_dir, "documents")
    n = lambda x: x.groupBy("lang").agg(F.count("*").alias("n"))
    return audits.before_after(n(d), n(d.where("n_chars >= 1000")), "lang", "n")


BEFORE_AFTER = "WITH c AS (SELECT lang, count(*) AS before, count(*) FILTER (n_chars >= 1000) AS after FROM documents GROUP BY lang) SELECT lang, before, after, round(1 - after / before, 4) AS reduction FROM c"


def training_pairs(spark, sf_dir):
    """Conversations' first two turns as tagged prompts."""
    c = t(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("u"))
    answer = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"))
    body = F.concat(F.lit("<Ground Truth>"), F.col("u"), F.lit("</Ground Truth><Citation Sentence>"), F.coalesce("a", F.lit("")), F.lit("</Citation Sentence>"))
    prompts = user.join(answer, "conv_id", "left").select(F.col("conv_id").cast("string").alias("id"), body.alias("input"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "true").otherwise("mismatch").alias("match"))
    return training.pair_rows(prompts).select("id", "label", "status", F.length("text_a").alias("a_chars"))


PAIRS = rf"""WITH u AS (SELECT conv_id, arg_min(text, turn) AS u FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, arg_min(text, turn) AS a FROM conversations WHERE role = 'assistant' GROUP BY 1),
 j AS (SELECT conv_id, trim(u, ' ') AS f, trim(coalesce(a, ''), ' ') AS c, '<Ground Truth>' || u || '</Ground Truth><Citation Sentence>' || coalesce(a, '') || '</Citation Sentence>' AS input FROM u LEFT JOIN a USING (conv_id))
 SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 END AS label, CASE WHEN f <> '' AND c <> '' THEN 'structured_sections' ELSE 'fallback_raw_input' END AS status,
 CAST(CASE WHEN f <> '' AND c <> '' THEN length(f) + 19 ELSE length(trim(regexp_replace(input, '\s+', ' ', 'g'))) END AS INT) AS a_chars FROM j"""

QUERIES = {f.__name__: f for f in (block_texts, toc_pages, evidence_unit_counts, position_audit, selected_vs_reference, error_taxonomy, before_after_by_lang, training_pairs)}
SQL = {
    "block_texts": BLOCK_TEXTS, "toc_pages": TOC_PAGES, "evidence_unit_counts": EVIDENCE_UNITS, "position_audit": POSITION, "selected_vs_reference": AGAINST,
    "error_taxonomy": ERRORS, "before_after_by_lang": BEFORE_AFTER, "training_pairs": PAIRS,
}
