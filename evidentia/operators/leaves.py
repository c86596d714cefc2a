"""Leaves under sections: where tables, texts and media hang, in which order, and how many are below each node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Block types that become text or media leaves.
TEXT_TYPES = ("text", "list", "equation", "code", "page_footnote", "aside_text")
MEDIA_TYPES = ("image", "chart")
FAR = 10**9


def draft_ranges(entries: DataFrame) -> DataFrame:
    """``entries(doc, idx, depth, start_page, page_count)`` with end_page: the start of the next entry of no greater depth.

    Per document, a later entry closes all open entries of its depth or deeper. The first such entry is the least
    index among those of each depth up to its own, with depths few: so windows by (doc, depth) find it, without pairs of
    entries. Rows that lie by ``doc`` are not moved again.
    """
    c = F.col
    there = F.struct(c("idx").cast("long").alias("i"), c("start_page").cast("long").alias("p"))
    asked = F.transform(F.filter("_depths", lambda d: d <= c("depth")), lambda d: F.struct(d.alias("d2"), F.lit(None).cast("struct<i:bigint,p:bigint>").alias("own")))
    known = entries.withColumn("_depths", F.collect_set("depth").over(Window.partitionBy("doc")))
    rows = known.select(*entries.columns, F.explode(F.concat(F.array(F.struct(c("depth").alias("d2"), there.alias("own"))), asked)).alias("_x"))
    later = Window.partitionBy("doc", "_x.d2").orderBy(F.desc("idx")).rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_next", F.when(c("_x.own").isNull(), F.min("_x.own").over(later)))
    closed = found.withColumn("_next", F.min("_next").over(Window.partitionBy("doc", "idx"))).where("_x.own IS NOT NULL")
    end = F.greatest(c("start_page").cast("long"), F.coalesce("_next.p", c("page_count").cast("long")))
    return closed.select("doc", "idx", *[x for x in entries.columns if x not in ("doc", "idx")], end.alias("end_page"))


def attach(leaves: DataFrame, sections: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``leaves(doc, content_index, page, kind, label)`` with parent_node_id and assignment_reason.

    A table goes where ``overrides(doc, label, node_id)`` says if that section exists, else to the deepest section over
    its page, else to the document's last section. Other leaves need a section over their page, which must not be
    outline-only. sections(doc, node_id, depth, start_page, end_page, outline_only). Leaves without a place are left out.

    A document's sections and overrides come to its leaves as arrays, by joins on ``doc`` alone: rows that lie by it are not moved.
    """
    c = F.col
    place = F.struct("depth", (c("start_page") - c("end_page")).alias("narrow"), "node_id", "start_page", "end_page")
    by_doc = sections.groupBy("doc").agg(F.collect_list(place).alias("_sections"), F.max("node_id").alias("last_id"), F.collect_set(F.when(c("outline_only"), c("node_id"))).alias("_outlined"))
    placed = leaves.join(by_doc, "doc", "left")
    over = F.filter("_sections", lambda s: c("page").between(s["start_page"], s["end_page"]))
    placed = placed.withColumn("page_id", F.array_max(over)["node_id"])  # the deepest, then the narrowest, then the last
    if overrides is None:
        placed = placed.withColumn("asked_id", F.lit(None).cast("string")).withColumn("own_id", F.lit(None).cast(sections.schema["node_id"].dataType))
    else:
        asked = overrides.groupBy("doc").agg(F.collect_list(F.struct("label", "node_id")).alias("_asked"))
        named = F.filter("_asked", lambda x: x["label"] == c("label"))
        placed = placed.join(asked, "doc", "left").withColumn("asked_id", F.array_min(F.transform(named, lambda x: x["node_id"])))
        placed = placed.withColumn("own_id", F.when(F.array_contains(c("_sections.node_id"), c("asked_id")), c("asked_id"))).drop("_asked")
    placed = placed.withColumn("outline", F.when(F.array_contains("_outlined", c("page_id")), True)).drop("_sections", "_outlined")
    table = c("kind") == "table"
    reason = (
        F.when(~table, "page_range_deepest_match")
        .when(c("own_id").isNotNull(), "manifest_override")
        .when(c("page_id").isNotNull() & c("asked_id").isNotNull(), "page_range_deepest_match_after_missing_override")
        .when(c("page_id").isNotNull(), "page_range_deepest_match")
        .otherwise("fallback_last_node")
    )
    parent = F.when(~table, c("page_id")).otherwise(F.coalesce("own_id", "page_id", "last_id"))
    out = placed.withColumn("parent_node_id", parent).withColumn("assignment_reason", reason)
    return out.where(c("parent_node_id").isNotNull() & (table | c("outline").isNull())).drop("page_id", "last_id", "asked_id", "own_id", "outline")


def child_order(children: DataFrame) -> DataFrame:
    """``children(doc, parent_node_id, page, y, node_type, node_id)`` with ``place`` among their siblings, from 1."""
    order = [F.coalesce("page", F.lit(FAR)), F.coalesce("y", F.lit(float(FAR))), F.coalesce("node_type", F.lit("")), F.coalesce(F.col("node_id").cast("string"), F.lit(""))]
    return children.withColumn("place", F.row_number().over(Window.partitionBy("doc", "parent_node_id").orderBy(*order)))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """``nodes(doc, node_id, node_type, path array)``, path from the root to the node itself: (doc, node_id, node_type, n) of what is below or is it."""
    return nodes.select("doc", "node_type", F.explode("path").alias("node_id")).groupBy("doc", "node_id", "node_type").agg(F.count("*").alias("n"))


def heading_entries(headings: DataFrame) -> DataFrame:
    """Headings as entries where there is no table of contents: those labelled with a dotted number or one capital letter."""
    return headings.where(F.col("label").rlike(r"^(?:\d+(?:\.\d+)*|[A-Z])$")).withColumn("start_source", F.lit("heading_fallback"))


def page_texts(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """``blocks(doc, content_index, page, text)``: (doc, page, first_index, page_text), its blocks in order, blank ones left out; cut to ``most`` characters."""
    own = blocks.where(F.trim("text") != "").groupBy("doc", "page").agg(F.min("content_index").alias("first_index"), F.array_sort(F.collect_list(F.struct("content_index", "text"))).alias("b"))
    joined = F.array_join(F.transform("b", lambda x: x["text"]), "\n")
    return own.select("doc", "page", "first_index", (joined if most is None else F.substring(joined, 1, most)).alias("page_text"))


def page_start_flags(entries: DataFrame, pages: DataFrame, reach: int = 700) -> DataFrame:
    """``entries(doc, start_page, title, label, content_index)`` with at_page_start: first or second block of the page, or title (with label) early in its text."""
    joined = entries.join(pages.select("doc", F.col("page").alias("start_page"), "first_index", "page_text"), ["doc", "start_page"], "left")
    early = F.lower(F.substring("page_text", 1, reach))
    named = F.contains(early, F.lower("title")) | F.contains(early, F.lower(F.concat_ws(" ", "label", "title")))
    flag = (F.col("content_index") <= F.col("first_index") + 1) | named
    return joined.withColumn("at_page_start", F.coalesce(flag, F.lit(False))).drop("first_index", "page_text")


def split_nodes(nodes: DataFrame, kind: str) -> DataFrame:
    """``nodes(doc, preorder, type, block_ids)`` of one kind, numbered by least block id (none: last), ties by pre-order."""
    own = nodes.where(F.col("type") == kind)
    least = F.coalesce(F.array_min("block_ids"), F.lit(FAR))
    order = Window.partitionBy("doc").orderBy(*([least] if kind == "table" else []), "preorder")
    n = F.row_number().over(order)
    return own.withColumn("node_order", n).withColumn("node_id", F.format_string(f"popo-{kind}-%04d", n))


def section_path(ancestors: Column, title: Column) -> Column:
    """Titles above and its own, which is not repeated where it is the last already."""
    own = F.when((F.trim(title) == "") | F.element_at(ancestors, -1).eqNullSafe(title), ancestors).otherwise(F.array_append(ancestors, title))
    return F.when(F.size(ancestors) > 0, own).otherwise(F.when(F.trim(title) != "", F.array(title)).otherwise(F.array().cast("array<string>")))


def table_blocks(blocks: DataFrame) -> DataFrame:
    """Numbered table anchors of ``blocks(doc, content_index, kind, caption)``: tables, and code with a table's caption."""
    own = blocks.where((F.col("kind") == "table") | ((F.col("kind") == "code") & F.col("caption").rlike(r"(?i)^\s*tab(?:le|\.)")))
    return own.withColumn("anchor_no", F.row_number().over(Window.partitionBy("doc").orderBy("content_index")))
