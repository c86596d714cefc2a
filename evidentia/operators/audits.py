"""Audits of built data: positions of tables, selections against a reference, errors against feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import blocks as block_functions
from evidentia.operators.review import failed_rules

# Flags that fail a table; all others only warn.
HARD = ("raw_content_index_missing", "raw_content_index_out_of_range", "source_item_not_table_like", "page_mismatch", "bbox_mismatch", "override_parent_mismatch")


def position_audit(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """``tables(doc, node_id, raw_index, page, bbox, label, caption, parent_id, expected_parent)`` with flags and status.

    blocks(doc, content_index, kind, page, bbox, caption) are what the tables were made of.
    """
    source = blocks.select("doc", F.col("content_index").alias("raw_index"), "kind", F.col("page").alias("s_page"), F.col("bbox").alias("s_bbox"), F.coalesce("caption", F.lit("")).alias("s_caption"))
    joined = tables.join(source, ["doc", "raw_index"], "left")
    there = F.col("kind").isNotNull()
    flags = failed_rules({
        "raw_content_index_missing": F.col("raw_index").isNull(),
        "raw_content_index_out_of_range": F.col("raw_index").isNotNull() & ~there,
        "source_item_not_table_like": there & ~block_functions.is_table(F.col("kind"), F.col("s_caption")),
        "page_mismatch": there & ~F.col("s_page").eqNullSafe(F.col("page")),
        "bbox_mismatch": there & ~F.col("s_bbox").eqNullSafe(F.col("bbox")),
        "source_caption_empty": there & (F.col("s_caption") == ""),
        "source_code_promoted_to_table": there & (F.col("kind") == "code"),
        "override_parent_mismatch": F.col("expected_parent").isNotNull() & ~F.col("parent_id").eqNullSafe(F.col("expected_parent")),
        "caption_label_fallback": F.col("label").startswith("Table ") & (F.coalesce("caption", F.lit("")) == ""),
    })
    status = F.when(F.arrays_overlap("flags", F.array(*map(F.lit, HARD))), "fail").when(F.size("flags") > 0, "warn").otherwise("pass")
    return joined.withColumn("flags", flags).withColumn("status", status).drop("kind", "s_page", "s_bbox", "s_caption")


def text_match(child: str, evidence: str):
    """Score of two texts in match form: 1 if one holds the other, 0 for under four tokens, else the share of the child's tokens."""
    a, b = F.col(child), F.col(evidence)
    tokens = F.filter(F.split(a, " "), lambda t: t != "")
    share = F.size(F.filter(tokens, lambda t: F.array_contains(F.split(b, " "), t))) / F.size(tokens)
    return F.when((a == "") | (b == ""), 0.0).when(F.contains(a, b) | F.contains(b, a), 1.0).when(F.size(tokens) < 4, 0.0).otherwise(share)


def match_form(column: str):
    """Split marks and hyphens at line ends out, punctuation to blanks, for text that is in normal form."""
    c = F.regexp_replace(F.regexp_replace(column, r"(?i)<\|(?:txt_)?split\|>", " "), r"(?U)(?<=\w)-\s+(?=\w)", "")
    return F.trim(F.regexp_replace(c, r"(?U)[^\w]+", " "))


def against_reference(selected: DataFrame, reference: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(paper, label, selected, selected_matched, reference, reference_matched): best matches either way, per table.

    selected(paper, label, child_id, text), reference(paper, label, evidence_id, text), texts in normal form. One
    equi-join serves both directions.
    """
    a = selected.withColumn("a", match_form("text")).drop("text")
    b = reference.withColumn("b", match_form("text")).drop("text")
    pairs = a.join(b, ["paper", "label"]).withColumn("score", text_match("a", "b")).where(F.col("score") >= threshold)
    key = ["paper", "label"]
    left = pairs.groupBy(*key).agg(F.count_distinct("child_id").alias("selected_matched"), F.count_distinct("evidence_id").alias("reference_matched"))
    n_a, n_b = selected.groupBy(*key).agg(F.count("*").alias("selected")), reference.groupBy(*key).agg(F.count("*").alias("reference"))
    return n_a.join(n_b, key, "full_outer").join(left, key, "left").na.fill(0, ["selected", "reference", "selected_matched", "reference_matched"])


def errors(feedback: DataFrame, reviewed: DataFrame, key: list[str]) -> DataFrame:
    """Counts of agreement, false positives, false negatives and what nobody reviewed; 0 is relevant."""
    joined = feedback.select(*key, "gold_label").join(reviewed.select(*key, "final_label"), key, "left")
    kind = F.when(F.col("final_label").isNull(), "unreviewed_human_example").when(F.col("final_label") == F.col("gold_label"), "agreement").when(F.col("final_label") == 0, "false_positive").otherwise("false_negative")
    return joined.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def with_overrides(anchors: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors with the page, box and caption of their override, and the overrides that fit no anchor or several.

    anchors(doc, label, page_index, bbox, caption), overrides(doc, label, page_index, bbox, caption); labels in normal form.
    """
    n = anchors.groupBy("doc", "label").agg(F.count("*").alias("targets"))
    w = Window.partitionBy("doc", "label").orderBy(F.col("page_index"), F.col("caption"))
    rated = overrides.withColumn("_k", F.row_number().over(w)).join(n, ["doc", "label"], "left")
    good = rated.where("_k = 1 AND targets = 1").select("doc", "label", *[F.col(c).alias(f"new_{c}") for c in ("page_index", "bbox", "caption")])
    patched = anchors.join(good, ["doc", "label"], "left")
    for c in ("page_index", "bbox", "caption"):
        patched = patched.withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
    reason = F.when(F.col("_k") > 1, "duplicate_anchor_override").when(F.coalesce("targets", F.lit(0)) != 1, "anchor_override_target_count")
    return patched, rated.withColumn("reason", reason).where("reason IS NOT NULL").select("doc", "label", "reason")


def before_after(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """A measure before and after, and by what share it fell; no share where there was nothing."""
    a, b = old.select(key, F.col(value).alias("before")), new.select(key, F.col(value).alias("after"))
    joined = a.join(b, key, "full_outer").na.fill(0, ["before", "after"])
    return joined.withColumn("reduction", F.when(F.col("before") > 0, F.round(1 - F.col("after") / F.col("before"), 4)))
