"""Inventory of evidence: parents, orphans of the layout, scopes and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import mentions as mention_functions
from evidentia.functions import scoring, text


def orphan_status(body: Column, is_caption: Column, in_references: Column, by_id: Column, by_content: Column) -> Column:
    """Why a block is or is not covered; the first rule that applies."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(F.trim(body) == "") | body.isNull(), "excluded_empty_text").when(yes(is_caption), "excluded_known_table_caption")
        .when(yes(in_references), "excluded_reference_area").when(yes(by_id), "covered_by_block_id")
        .when(yes(by_content), "covered_by_content").otherwise("orphan_fallback")
    )


def classify_blocks(blocks: DataFrame, parents: DataFrame, captions: DataFrame) -> DataFrame:
    """``blocks(doc, content_index, text, in_references)`` with a status.

    parents(doc, full_text, block_ids) cover by id or by containing a block's text; a block within a caption of its
    document, or around one, is that caption. All joins are within a document.
    """
    norm = lambda c: F.lower(text.collapse(c))
    ids = parents.select("doc", F.explode("block_ids").alias("content_index")).distinct().withColumn("by_id", F.lit(True))
    bodies = parents.groupBy("doc").agg(F.collect_list(norm(F.col("full_text"))).alias("bodies"))
    caps = captions.groupBy("doc").agg(F.collect_list(norm(F.col("caption"))).alias("caps"))
    own = blocks.join(ids, ["doc", "content_index"], "left").join(bodies, "doc", "left").join(caps, "doc", "left").withColumn("_n", norm(F.col("text")))
    is_caption = F.exists("caps", lambda c: F.contains(c, F.col("_n")) | F.contains(F.col("_n"), c))
    by_content = F.exists("bodies", lambda b: F.contains(b, F.col("_n")))
    return own.withColumn("status", orphan_status(F.col("text"), is_caption, F.col("in_references"), F.col("by_id"), by_content)).drop("by_id", "bodies", "caps", "_n")


def coverage(statuses: DataFrame) -> DataFrame:
    """Characters of body text per document that are covered, and the share that layout parents cover themselves."""
    size = F.length("text")
    body = ~F.col("status").startswith("excluded")
    n = statuses.groupBy("doc").agg(F.sum(F.when(body, size).otherwise(0)).alias("body_chars"), F.sum(F.when(F.col("status").startswith("covered"), size).otherwise(0)).alias("covered_chars"))
    return n.withColumn("covered_ratio", F.when(F.col("body_chars") > 0, F.col("covered_chars") / F.col("body_chars")))


def suggestions(children: DataFrame, tables: DataFrame) -> DataFrame:
    """Child and table pairs of a document that have a channel, with points by channel, best first per child.

    children(doc, child_id, text, section_path, pages, block_ids), tables(doc, table_id, label, section_path, pages,
    block_ids, tokens). Tokens and hints are made once per side, before the join.
    """
    labels = tables.groupBy("doc").agg(F.collect_list(F.struct("table_id", "label")).alias("labels"))
    made = children.join(labels, "doc").withColumn("found", mention_functions.mentions("text", "labels"))
    made = made.withColumn("named", F.array_distinct(F.flatten(F.transform("found", lambda m: m["table_ids"]))))
    made = made.withColumn("hints", text.condition_hints(F.col("text"))).withColumn("child_tokens", text.scope_tokens(text.nfkc_casefold("text")))
    t = tables.select("doc", "table_id", F.col("section_path").alias("t_path"), F.col("pages").alias("t_pages"), F.col("block_ids").alias("t_blocks"), F.col("tokens").alias("t_tokens"))
    pairs = made.join(t, "doc")
    c = F.col
    parts = scoring.suggestion_parts(
        F.array_contains("named", c("table_id")), text.share_section(c("section_path"), c("t_path")), text.least_distance(c("pages"), c("t_pages")),
        text.least_distance(c("block_ids"), c("t_blocks")), F.size("hints"), F.size(F.array_intersect("child_tokens", "t_tokens")),
    )
    scored = pairs.withColumn("score_components", parts).where(F.size("score_components") > 0)
    return scored.select("doc", "child_id", "table_id", "score_components", scoring.total(c("score_components")).alias("ordering_score"), F.lit(False).alias("binding"))


def scopes(parents: DataFrame) -> DataFrame:
    """(doc, scope_id, title, parent_ids): parents by normal section path."""
    path = F.transform("section_path", lambda t: F.lower(text.collapse(t)))
    ids = parents.withColumn("scope_id", text.scope_id(path))
    return ids.groupBy("doc", "scope_id").agg(F.min(F.array_join("section_path", " > ")).alias("title"), F.array_sort(F.collect_list("parent_id")).alias("parent_ids"))
