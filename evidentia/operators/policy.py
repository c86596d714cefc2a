"""Policies from feedback: evaluation with forced choices, the grid of proposals, guardrails; memory packs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scoring

# Weights that are varied, and by how much.
VARIED = ("table_text_overlap_per_token", "annotation_rationale_overlap_per_token", "evidence_family_match", "condition_match", "result_match")
FACTORS = (0.5, 1.5, 2.0)


@dataclass(frozen=True)
class Guardrails:
    min_examples: int = 30
    min_recall: float = 0.98
    min_table_coverage: float = 1.0


def weight_sets(base: dict[str, float]) -> list[dict[str, float]]:
    """The weights as they are, and with each varied weight by each factor."""
    return [dict(base)] + [base | {name: round(base[name] * f, 6)} for name in VARIED for f in FACTORS]


def rates(counted: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and table coverage of ``counted(*by, tp, fp, fn, tn, covered, tables)``."""
    c = F.col
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counted.select(*by, "tp", "fp", "fn", "tn", (c("tp") + c("fp")).alias("selected"), share(c("tp"), c("tp") + c("fp")).alias("precision"), share(c("tp"), c("tp") + c("fn")).alias("recall"), share(c("covered"), c("tables")).alias("table_coverage"))


def measured(choices: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts, precision, recall and table coverage of ``choices(*by, doc, table_label, gold_label, selected)``; 0 is relevant."""
    relevant, chosen = F.col("gold_label") == 0, F.col("selected")
    table = F.struct("doc", "table_label")
    n = lambda c: F.count(F.when(c, True))
    counted = choices.groupBy(*by).agg(
        n(relevant & chosen).alias("tp"), n(~relevant & chosen).alias("fp"), n(relevant & ~chosen).alias("fn"), n(~relevant & ~chosen).alias("tn"),
        F.count_distinct(F.when(relevant & chosen, table)).alias("covered"), F.count_distinct(F.when(relevant, table)).alias("tables"),
    )
    return rates(counted, by)


def with_forced(scored: DataFrame, by: list[str], parent: list[str], order: list[Column]) -> DataFrame:
    """``scored(score, selected)`` with the best child of each parent selected where none is; the first on ties."""
    w = Window.partitionBy(*by, *parent)
    none = ~F.max(F.col("selected")).over(w)
    first = F.row_number().over(w.orderBy(F.desc("score"), *order)) == 1
    return scored.withColumn("selected", F.col("selected") | (none & first))


def proposals(examples: DataFrame, base: dict[str, float]) -> DataFrame:
    """Examples scored under every weight set: adds weight_set and score. ``examples`` has a struct ``signals``."""
    sets = F.array(*[F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(float(v)))]) for w in weight_sets(base)])
    wide = examples.select("*", F.posexplode(sets).alias("weight_set", "weights"))
    return wide.withColumn("score", F.round(scoring.policy_score(F.col("signals"), F.col("weights")), 6)).drop("weights")


def _counted_by_scores(examples: DataFrame, base: dict[str, float], order: str) -> DataFrame:
    """Examples of one parent, label and flag that score alike under all weight sets as one row, with their number and first place."""
    scores = F.array(*[F.round(scoring.policy_score(F.col("signals"), w), 6) for w in weight_sets(base)])
    keys = ["doc", "table_label", "candidate_id", "gold_label"]
    own = examples.select(*keys, F.col(order).alias("place"), F.col("signals.exact_table_reference").alias("exact"), scores.alias("scores"))
    return own.groupBy(*keys, "exact", "scores").agg(F.count("*").alias("n"), F.min("place").alias("place"))


def optimize(examples: DataFrame, base: dict[str, float], rails: Guardrails, order: str) -> DataFrame:
    """The viable proposals with their measures, best first: precision, fewer selected, recall, then the order of the grid.

    A weight set's thresholds are 0 and its distinct scores. A child leaves the selection above its score; one with an exact
    reference never does, nor does the first of a parent without such a reference, which is forced where its score is too low.
    So the measures of all thresholds are running counts, and no child is joined to thresholds.
    """
    c = F.col
    alike = _counted_by_scores(examples, base, order).select("*", F.posexplode("scores").alias("weight_set", "score")).drop("scores")
    parent = Window.partitionBy("weight_set", "doc", "table_label", "candidate_id")
    first = F.row_number().over(parent.orderBy(F.desc("score"), "place")) == 1
    kept = F.when(c("exact"), c("n")).when(first & ~F.max("exact").over(parent), 1).otherwise(0)
    split = alike.withColumn("kept", kept).select(
        "weight_set", "doc", "table_label", "gold_label", (c("exact").isNotNull()).alias("known"),
        F.explode(F.array(F.struct(F.lit(float("inf")).alias("last"), c("kept").alias("n")), F.struct(c("score").alias("last"), (c("n") - c("kept")).alias("n")))).alias("x"),
    )
    # Children without a flag are unknown above their score: they count in neither column there.
    n = lambda x: F.sum(F.when(x, c("x.n")).otherwise(0))
    relevant = c("gold_label") == 0
    by_table = split.groupBy("weight_set", "doc", "table_label", "x.last").agg(n(relevant).alias("p"), n(~relevant).alias("q"), n(relevant & c("known")).alias("p_known"), n(~relevant & c("known")).alias("q_known"))
    best = Window.partitionBy("weight_set", "doc", "table_label").orderBy(F.desc(c("p") > 0), F.desc("last"))
    by_last = by_table.withColumn("t", ((F.row_number().over(best) == 1) & (c("p") > 0)).cast("long")).groupBy("weight_set", "last").agg(*[F.sum(x).alias(x) for x in ("p", "q", "p_known", "q_known", "t")])
    zero = by_last.groupBy("weight_set").agg(F.lit(0.0).alias("last"), *[F.lit(0).cast("long").alias(x) for x in ("p", "q", "p_known", "q_known", "t")])
    steps = by_last.unionByName(zero).groupBy("weight_set", "last").agg(*[F.sum(x).alias(x) for x in ("p", "q", "p_known", "q_known", "t")])
    of_set = Window.partitionBy("weight_set")
    above = of_set.orderBy(F.desc("last")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = lambda x: F.sum(x).over(above)
    below = lambda x: F.sum(x).over(of_set) - up(x)
    counted = steps.select("weight_set", c("last").alias("threshold"), up("p").alias("tp"), up("q").alias("fp"), below("p_known").alias("fn"), below("q_known").alias("tn"), up("t").alias("covered"), F.sum("t").over(of_set).alias("tables"))
    rated = rates(counted.where(c("threshold") < float("inf")), ["weight_set", "threshold"])
    viable = rated.where((c("recall") >= rails.min_recall) & (c("table_coverage") >= rails.min_table_coverage))
    return viable.orderBy(F.desc("precision"), "selected", F.desc("recall"), "weight_set", "threshold")


def bump_patch(version: Column) -> Column:
    """A version name-a.b.c with c one higher."""
    return F.concat(F.regexp_extract(version, r"^(.*\.)\d+$", 1), (F.regexp_extract(version, r"(\d+)$", 1).cast("int") + 1).cast("string"))


def upsert(memory: DataFrame, items: DataFrame, key: str = "memory_id") -> DataFrame:
    """The latest version of each item; when it was first created stays."""
    both = memory.unionByName(items, allowMissingColumns=True)
    w = Window.partitionBy(key)
    newest = F.row_number().over(w.orderBy(F.desc("updated_at_utc")))
    return both.withColumn("created_at_utc", F.min("created_at_utc").over(w)).withColumn("_k", newest).where("_k = 1").drop("_k")


def memory_score(haystack: Column, confidence: Column, terms: list[str], paper: str | None = None, label: str | None = None) -> Column:
    """Points for the paper, the table label and each query term that the item's text names, plus its confidence."""
    points = confidence.cast("double")
    for name, worth in ((paper, 8.0), (label, 10.0), *((t, 1.0) for t in sorted(set(terms)))):
        if name:
            points = points + F.when(F.contains(haystack, F.lit(name.lower())), worth).otherwise(0.0)
    return points
