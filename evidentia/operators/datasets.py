"""Datasets and metrics: folds, class metrics, group scores, chunks, and the tables of grouped results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folds(articles: DataFrame, n: int = 5) -> DataFrame:
    """``articles(article, size, label, first)`` with a fold: round robin by size within each majority label."""
    w = Window.partitionBy("label").orderBy(F.desc("size"), "first")
    return articles.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(n)))


def majority(rows: DataFrame, article: str, label: str, order: str) -> DataFrame:
    """(article, size, label, first): each article's commonest label, on ties the one seen first."""
    counted = rows.groupBy(article, label).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    w = Window.partitionBy(article)
    ranked = counted.withColumn("size", F.sum("n").over(w)).withColumn("first", F.min("seen").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("n"), "seen")))
    return ranked.where("_k = 1").select(F.col(article).alias("article"), "size", F.col(label).alias("label"), "first")


def class_metrics(pairs: DataFrame, truth: str, guess: str, classes: tuple = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support of each class; a ratio without cases is 0. One pass over the pairs."""
    n = lambda c: F.count(F.when(c, True))
    counts = [F.struct(F.lit(k).alias("label"), n((F.col(truth) == k) & (F.col(guess) == k)).alias("hit"), n(F.col(guess) == k).alias("guessed"), n(F.col(truth) == k).alias("support")) for k in classes]
    rows = pairs.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p, r = F.col("precision"), F.col("recall")
    rated = rows.withColumn("precision", share("hit", "guessed")).withColumn("recall", share("hit", "support"))
    return rated.select("label", "precision", "recall", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")


def class_weight(count: Column, total: Column, classes: int = 2) -> Column:
    return F.when(count > 0, total / (classes * count)).otherwise(0.0)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def group_scores(rows: DataFrame, group: str, p1: Column) -> DataFrame:
    """A group's mean, largest and least score of label 1, and the label each gives from 0.5 on."""
    out = rows.groupBy(group).agg(F.avg(p1).alias("mean_p1"), F.max(p1).alias("max_p1"), F.min(p1).alias("min_p1"), F.count("*").alias("chunks"))
    return out.withColumns({f"label_{k}": (F.col(f"{k}_p1") >= 0.5).cast("int") for k in ("mean", "max", "min")})


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Chunks of ``size`` tokens, each ``overlap`` tokens into the one before it; the last may be shorter."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - overlap) / F.lit(step)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(tokens, k * step + 1, F.lit(size)))


def topk_with_refill(df: DataFrame, group: str, order: list[Column], good: Column, most: int, least: int) -> DataFrame:
    """Per group up to ``most`` good rows in order, refilled from the others up to ``least``; with the final rank."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("_g", F.coalesce(good, F.lit(False))).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_g"), *order)))
    kept = ranked.withColumn("_n", F.least(F.lit(most), F.count(F.when(F.col("_g"), 1)).over(w))).where(F.col("_r") <= F.greatest(F.col("_n"), F.lit(least)))
    return kept.withColumn("refill", ~F.col("_g")).withColumn("rank", F.row_number().over(w.orderBy(*order))).drop("_g", "_r", "_n")
