"""Paragraph merge: neighbouring text blocks that go on in one another become one paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import geometry

# Geometry on the scale of 0 to 1000.
SAME_COLUMN, GAP, PAGE_BOTTOM, PAGE_TOP = 0.45, (-4, 28), 700, 350
_CAPTION = r"(?iU)^\s*(?:table|tab\.|figure|fig\.)\s*[A-Z]?\d"
_END = r"[.!?。！？][\"'’”)\]]*\s*$"


def joins_previous(text: Column, box: Column, page: Column, section: Column, w) -> Column:
    """Whether a block goes on with the one before it in ``w``."""
    p_text, p_box, p_page, p_section = (F.lag(c).over(w) for c in (text, box, page, section))
    goes_on = ~p_text.rlike(_END) | text.rlike(r"^\s*\p{Ll}")
    plain = ~text.rlike(_CAPTION) & ~p_text.rlike(_CAPTION) & ~p_text.rlike(r":\s*$")
    gap = F.get(box, F.lit(1)) - F.get(p_box, F.lit(3))
    same_page = (page == p_page) & (section == p_section) & (geometry.overlap_share(p_box, box) >= SAME_COLUMN) & gap.between(*GAP)
    dangling = text.rlike(r"^\s*\p{Ll}") | p_text.rlike(r"(?i)\b(?:and|or|the|of|to|in|with|for)\s*$|[,;\-]\s*$")
    next_page = (page == p_page + 1) & (F.get(p_box, F.lit(3)) >= PAGE_BOTTOM) & (F.get(box, F.lit(1)) <= PAGE_TOP) & ((section == p_section) | dangling)
    return F.coalesce(goes_on & plain & (same_page | next_page), F.lit(False))


def sessions(df: DataFrame, keys: list[str], order: list[str], joined: Column, name: str = "session") -> DataFrame:
    """Numbers runs of rows (from 1 per key) in which each row joins the one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """``blocks(doc, content_index, kind, text, page_index, bbox, section)`` to paragraphs.

    Media, tables, headers and footnotes neither join nor part what surrounds them; headings and blank blocks part.
    """
    own = blocks.where(F.col("kind").isin("text", "heading"))
    w = Window.partitionBy("doc").orderBy("content_index")
    text_pair = (F.col("kind") == "text") & (F.lag("kind").over(w) == "text") & (F.trim("text") != "") & (F.trim(F.lag("text").over(w)) != "")
    joined = F.coalesce(text_pair, F.lit(False)) & joins_previous(F.col("text"), F.col("bbox"), F.col("page_index"), F.col("section"), w)
    numbered = sessions(own, ["doc"], ["content_index"], joined).where("kind = 'text' AND trim(text) <> ''")
    parts = F.array_sort(F.collect_list(F.struct("content_index", "text")))
    return numbered.groupBy("doc", "session").agg(F.array_join(F.transform(parts, lambda x: F.trim(x["text"])), " ").alias("text"), F.transform(parts, lambda x: x["content_index"]).alias("content_indexes"), F.min("page_index").alias("page_start"), F.max("page_index").alias("page_end"))
