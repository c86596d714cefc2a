"""Caption resolution: candidates near a table, their scores, the choice and its flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scoring

# Windows of candidates, and the score difference within which a rival competes.
PAGE_WINDOW, INDEX_WINDOW, LATE_LABEL, RIVAL = 1, 10, 25, 8.0
LABEL = r"(?iU)\b(?:(?:extended\s+data|supplementary|supplemental)\s+table|table|tab\.?)\s*(?:S?\d+[A-Z]?|[A-Z]\.?\d+[A-Z]?|[IVXLCDM]+)(?=\s*[:：.\-–—)]|\s|$)|表\s*(?:S?\d+[A-Z]?|[A-Z]\.?\d+[A-Z]?)(?=\s*[:：.\-–—)]|\s|$)"


def candidates(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs within a page and ten blocks, or on one page, scored.

    tables(doc, table_id, page, idx, bbox, label), texts(doc, idx, page, bbox, label, kind, caption_like, label_start).
    """
    t = tables.select("doc", "table_id", F.col("page").alias("t_page"), F.col("idx").alias("t_idx"), F.col("bbox").alias("t_box"), F.col("label").alias("t_label"))
    pairs = t.join(texts, "doc")
    close = F.abs(F.col("idx") - F.col("t_idx")) <= INDEX_WINDOW
    pairs = pairs.where((F.abs(F.col("page") - F.col("t_page")) <= PAGE_WINDOW) & (close | (F.col("page") == F.col("t_page"))))
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    same = bare(F.col("label")) == bare(F.col("t_label"))
    c = F.col
    score = scoring.caption_score(c("kind"), c("caption_like"), c("page"), c("t_page"), same, c("bbox"), c("t_box"), c("idx"), c("t_idx"), c("label_start") > LATE_LABEL)
    return pairs.withColumn("score", score)


def resolve(scored: DataFrame, keep: int = 8) -> DataFrame:
    """Up to ``keep`` candidates per table in order, with confidence and whether a rival of another label is close."""
    w = Window.partitionBy("doc", "table_id").orderBy(F.desc("score"), "idx")
    all_rows = Window.partitionBy("doc", "table_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("_top", F.first(F.struct("score", "label")).over(w))
    rival = F.col("rank").between(2, 4) & (F.col("_top.score") - F.col("score") <= RIVAL) & (F.col("label") != F.col("_top.label"))
    flagged = ranked.withColumn("competing", F.max(F.coalesce(rival, F.lit(False))).over(all_rows)).where(F.col("rank") <= keep)
    return flagged.withColumn("confidence", scoring.confidence(F.col("score"))).drop("_top")
