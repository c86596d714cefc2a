"""Tables of contents: entries from lines, headings as evidence of pages, back matter, a preface where pages lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

# Back-matter terms in the order in which they are tried.
BACK_MATTER = ("references", "bibliography", "acknowledgement", "acknowledgments", "ethics statement", "license", "limitations")
ENTRY = r"^\s*(\d+(?:\.\d+)*\.?|[A-Z]\.?)\s+(.+?)\s*(?:\.{2,}\s*)?(\d+)\s*$"
HEADING = r"^\s*(\d+(?:\.\d+)*\.?|[A-Z]\.?)\s+(.+?)\s*$"


def depth(label: Column) -> Column:
    """A numeric label's dots and one more; letters stand at the top."""
    bare = F.regexp_replace(label, r"\.$", "")
    return F.when(bare.rlike(r"^\d"), F.size(F.split(bare, r"\."))).otherwise(1)


def entries(lines: DataFrame) -> DataFrame:
    """``lines(doc, idx, line)`` that look like entries, as (doc, idx, label, title, page, depth)."""
    got = lines.where(F.col("line").rlike(ENTRY))
    part = lambda k: F.regexp_extract("line", ENTRY, k)
    own = got.select("doc", "idx", F.regexp_replace(part(1), r"\.$", "").alias("label"), part(2).alias("title"), part(3).cast("int").alias("page"))
    return own.withColumn("depth", depth(F.col("label")))


def with_heading_pages(toc: DataFrame, headings: DataFrame) -> DataFrame:
    """Entries with the page of their heading where one is at most a page off, and where the page is from.

    headings(doc, content_index, label, title, page): the label must agree if the heading has one, and one title must
    begin the other; the nearest page counts, then the earlier heading.
    """
    n = lambda c: F.lower(text.collapse(c))
    h = headings.select("doc", "content_index", F.col("label").alias("h_label"), n(F.col("title")).alias("h_title"), F.col("page").alias("h_page"))
    pairs = toc.join(h, "doc").where(F.col("h_page").isNotNull() & (F.coalesce(F.nullif("h_label", F.lit("")), F.col("label")) == F.col("label")))
    t = n(F.col("title"))
    pairs = pairs.where(t.startswith(F.col("h_title")) | F.col("h_title").startswith(t)).withColumn("off", F.abs(F.col("h_page") - F.col("page")))
    w = Window.partitionBy("doc", "idx").orderBy("off", "content_index")
    best = pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1 AND off <= 1").select("doc", "idx", "h_page", "content_index")
    joined = toc.join(best, ["doc", "idx"], "left")
    source = F.when(F.col("h_page").isNotNull(), "heading_match").otherwise("toc_page_number")
    return joined.withColumn("page", F.coalesce("h_page", "page")).withColumn("page_source", source).drop("h_page")


def back_matter(headings: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, title, page): the first heading of each back-matter term that no title of ``known(doc, title)`` has."""
    low = F.lower(text.collapse(F.col("title")))
    term = F.get(F.filter(F.array(*map(F.lit, BACK_MATTER)), lambda t: F.contains(low, t)), F.lit(0))
    found = headings.withColumn("term", term).where("term IS NOT NULL AND page >= 1")
    first = found.groupBy("doc", "term").agg(F.min_by("page", "content_index").alias("page"))
    have = known.select("doc", F.lower("title").alias("term")).distinct()
    return first.join(have, ["doc", "term"], "left_anti").select("doc", F.initcap("term").alias("title"), "page")


def with_preface(rows: DataFrame) -> DataFrame:
    """Entries ``(doc, idx, title, start_page)`` with a preface before them where the first starts after page 1."""
    first = rows.groupBy("doc").agg(F.min("start_page").alias("m")).where("m > 1")
    return rows.unionByName(first.select("doc", F.lit(-1).alias("idx"), F.lit("Preface").alias("title"), F.lit(1).alias("start_page")), allowMissingColumns=True)
