"""Claims against tables: evidence segments, candidate rows by author, best pair of each sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_segments(df: DataFrame, key: str, facts: str) -> DataFrame:
    """(key, number, source, segment) of texts like ``citekey evidence 1 (source): ...``; text before the first is left out."""
    parts = df.select(key, F.posexplode(F.split(facts, r"(?i)(?=citekey\s+evidence\s+\d+)")).alias("_p", "part"))
    head = r"(?is)^citekey\s+evidence\s+(\d+)\s*(?:\(([^)]*)\))?\s*:\s*(.*)$"
    got = lambda k: F.regexp_extract("part", head, k)
    return parts.where(F.col("part").rlike(head)).select(key, got(1).cast("int").alias("number"), F.trim(got(2)).alias("source"), F.trim(got(3)).alias("segment"))


def tagged_section(text: Column, marker: str) -> Column:
    """The body between a tag that holds ``marker`` and the closing tag after it."""
    return F.trim(F.regexp_extract(text, rf"(?is)<[^<>/]*{marker}[^<>]*>(.*?)</[^<>]*>", 1))


def author_points(row: Column, author: Column) -> Column:
    """Points of a table row for an author: all of it 5, the surname 2, each year 2.

    ``and`` goes from author names wherever it stands, inside words too.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")
    years = F.array_distinct(F.regexp_extract_all(author, F.lit(r"(?:19|20)\d{2}"), F.lit(0)))
    names = F.regexp_replace(F.regexp_replace(F.lower(author), r"(?:19|20)\d{2}[a-z]?|et al\.?|and", " "), r"(?U)[^\w]+", " ")
    surname = F.get(F.filter(F.split(F.trim(names), r"\s+"), lambda w: F.length(w) > 1), F.lit(0))
    whole = F.when((bare(author) != "") & F.contains(bare(row), bare(author)), 5).otherwise(0)
    by_name = F.when(F.contains(F.lower(row), surname), 2).otherwise(0)
    by_year = 2 * F.size(F.filter(years, lambda y: F.contains(row, y)))
    return whole + F.coalesce(by_name, F.lit(0)) + by_year


def best_pairs(comparisons: DataFrame, threshold: float) -> DataFrame:
    """``comparisons(sample_id, idx, score)`` with review_rank, the sample's best score and whether it is over the threshold."""
    w = Window.partitionBy("sample_id")
    ranked = comparisons.withColumn("review_rank", F.row_number().over(w.orderBy(F.desc("score"), "idx")))
    return ranked.withColumn("best_score", F.max("score").over(w)).withColumn("matched", F.coalesce(F.max("score").over(w) > threshold, F.lit(False)))
