"""Candidates of evidence for tables: pairs per document in order, strict gates, ranks, audits and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.review import failed_rules

# Least scores of parents and children of strict candidates; how far is "no distance".
PARENT_SCORE, CHILD_SCORE, NO_DISTANCE = 120, 60, 999_999


def pairs(tables: DataFrame, parents: DataFrame, score: Column) -> DataFrame:
    """All pairs of a document's tables and parents, which are few beside the corpus, with ``score`` and ``place``.

    Excluded parents score -1. Best first: score, then the parent's first page and block.
    tables(doc, table_id, ...), parents(doc, parent_id, page, content_index, excluded, ...).
    """
    joined = tables.join(parents, "doc").withColumn("score", F.when(F.col("excluded"), F.lit(-1)).otherwise(score))
    order = Window.partitionBy("doc", "table_id").orderBy(F.desc("score"), "page", "content_index", "parent_id")
    return joined.withColumn("place", F.row_number().over(order))


def strict(children: DataFrame, parent_score: int = PARENT_SCORE, child_score: int = CHILD_SCORE) -> DataFrame:
    """``children(exact_reference, parent_score, tier, child_score)`` with ``gate``: selected, fallback (the parent passes, the child not), or none."""
    c = F.col
    parent = c("exact_reference") | (c("parent_score") >= parent_score) | c("tier").isin(1, 2)
    child = c("exact_reference") | (c("child_score") >= child_score)
    return children.withColumn("gate", F.when(parent & child, "selected").when(parent, "fallback").otherwise("none"))


def nine_keys() -> list[Column]:
    """The order of strict candidates, best first: reference, scores, matches, families, distances, length."""
    c = F.col
    far = lambda n: F.coalesce(c(n), F.lit(NO_DISTANCE))
    return [
        F.desc(c("exact_reference").cast("int")), F.desc("child_score"), F.desc("parent_score"), F.desc(c("condition_match").cast("int")), F.desc(c("result_match").cast("int")),
        F.desc("n_families"), far("page_distance").asc(), far("block_distance").asc(), F.desc(F.length("child_text")),
    ]


def best_k(children: DataFrame, k: int) -> DataFrame:
    """The ``k`` best selected children of each table; tables with fewer are filled up from the fallbacks."""
    order = Window.partitionBy("doc", "table_id").orderBy((F.col("gate") != "selected").cast("int"), *nine_keys(), "child_id")
    return children.where("gate <> 'none'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def projected(children: DataFrame, threshold: float) -> DataFrame:
    """``children(doc, table_id, parent_id, child_id, exact_reference, score)`` with ``selected``: referenced or scored, and of a parent without any its best."""
    own = (F.col("exact_reference") | (F.col("score") >= threshold)).cast("boolean")
    w = Window.partitionBy("doc", "table_id", "parent_id")
    lone = ~F.max(own).over(w) & (F.row_number().over(w.orderBy(F.desc("score"), "child_id")) == 1)
    return children.withColumn("selected", own | lone).withColumn("selection_reason", F.when(own, "score_or_reference").when(lone, "fallback_best_child"))


def audit(children: DataFrame) -> DataFrame:
    """(doc, child_id, failure) of ``children(doc, child_id, parent_text, char_start, char_end, child_text, parent_label, child_label, selected)``."""
    c = F.col
    slice_ = F.substr(c("parent_text"), c("char_start") + 1, c("char_end") - c("char_start"))
    rules = {
        "offset_mismatch": ~slice_.eqNullSafe(c("child_text")),
        "child_label_not_inherited": c("selected") & ~c("child_label").eqNullSafe(c("parent_label")),
        "label_without_selection": ~c("selected") & c("child_label").isNotNull(),
    }
    return children.select("doc", "child_id", F.explode(failed_rules(rules)).alias("failure"))


def first_reviews(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(key, failure) of ``decisions(key, text_sha256, label, role, support, rationale)`` against ``rows(key, text, gold_label)``."""
    c = F.col
    joined = decisions.join(rows.select("key", "text", "gold_label", F.lit(True).alias("_known")), "key", "left")
    blank = lambda n: F.trim(F.coalesce(c(n), F.lit(""))) == ""
    rules = {
        "unknown_row": c("_known").isNull(), "text_hash_mismatch": c("_known").isNotNull() & (c("text_sha256") != F.sha2("text", 256)),
        "label_not_0_or_1": c("label").isNull() | ~c("label").isin(0, 1), "role_missing": (c("label") == 0) & blank("role"), "support_missing": (c("label") == 0) & blank("support"),
        "rationale_missing": blank("rationale"), "conflict_with_gold": c("gold_label").isNotNull() & (c("gold_label") != c("label")),
    }
    return joined.select("key", F.explode(failed_rules(rules)).alias("failure"))


def retained(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows that a review keeps (label 0); parents that lose all children go with them, tables stay as ``tables`` lists them."""
    return rows.join(decisions.where("label = 0").select("key").distinct(), "key", "left_semi")


def annotations(selections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``selections(doc, table_id, raw_index)`` to the one paragraph of ``paragraphs(doc, parent_id, raw_indices array)`` that holds the index.

    An index that several paragraphs hold, or none, fails the query.
    """
    by_index = paragraphs.select("doc", "parent_id", F.explode("raw_indices").alias("raw_index")).groupBy("doc", "raw_index").agg(F.min("parent_id").alias("parent_id"), F.count_distinct("parent_id").alias("_n"))
    joined = selections.join(by_index, ["doc", "raw_index"], "left")
    fine = F.when(F.col("_n") == 1, F.col("parent_id")).otherwise(F.raise_error(F.lit("raw index without one paragraph")).cast(paragraphs.schema["parent_id"].dataType))
    return joined.select("doc", "table_id", fine.alias("parent_id")).distinct()


def lessons(errors: DataFrame, least: int = 2) -> DataFrame:
    """``errors(category, table_label)`` to rules worth keeping: (category, n, tables, lesson) of categories met ``least`` times."""
    counted = errors.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("table_label").alias("tables")).where(F.col("n") >= least)
    said = F.when(F.col("category") == "false_positive", "raise the bar").when(F.col("category") == "false_negative", "lower the bar").otherwise("keep")
    return counted.withColumn("lesson", said)
