"""Reviews: packages without history, rules on decisions, and what accepted decisions become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = r"^(?:human|codex|historical|gold)_"


def without_history(df: DataFrame) -> DataFrame:
    """Columns that tell of earlier reviews go."""
    import re

    return df.select(*[c for c in df.columns if not re.match(HISTORY, c)])


def failed_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules (conditions that must not hold) that a row breaks, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))


def validate_decisions(items: DataFrame, tables: DataFrame, decisions: DataFrame) -> DataFrame:
    """(paper_id, child_id, failure): all that is wrong, none dropped at the first.

    items(paper_id, child_id, parent_id), tables(paper_id, table_id), decisions(paper_id, child_id, parent_id,
    relevant_tables array<struct<table_id,label,confidence,evidence_role,rationale>>, rejection_reason).
    """
    key = ["paper_id", "child_id"]
    seen = decisions.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("parent_id")))
    known = items.select(*key, F.col("parent_id").alias("item_parent"))
    missing = known.join(decisions.select(*key).distinct(), key, "left_anti").select(*key, F.lit("missing_decision").alias("failure"))
    joined = seen.join(known, key, "left")
    empty = F.size(F.coalesce("relevant_tables", F.array())) == 0
    of_child = failed_rules({
        "unknown_child": F.col("item_parent").isNull(), "duplicate_decision": F.col("_k") > 1, "parent_mismatch": F.col("parent_id") != F.col("item_parent"),
        "tables_not_a_list": F.col("relevant_tables").isNull(), "rejection_reason_missing": empty & (F.trim(F.coalesce("rejection_reason", F.lit(""))) == ""),
        "rejection_reason_with_tables": ~empty & (F.trim(F.coalesce("rejection_reason", F.lit(""))) != ""),
    })
    children = joined.select(*key, F.explode(of_child).alias("failure"))
    one = joined.select(*key, F.explode("relevant_tables").alias("r")).select(*key, "r.*")
    rated = one.join(tables.select("paper_id", "table_id", F.lit(True).alias("_known")).distinct(), ["paper_id", "table_id"], "left")
    again = F.row_number().over(Window.partitionBy(*key, "table_id").orderBy("label")) > 1
    of_table = rated.withColumn("_again", again).select(*key, F.explode(failed_rules({
        "unknown_table": F.col("_known").isNull(), "duplicate_table": F.col("_again"), "label_not_zero": F.col("label").isNull() | (F.col("label") != 0),
        "confidence_out_of_range": F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1),
        "role_missing": F.trim(F.coalesce("evidence_role", F.lit(""))) == "", "rationale_missing": F.trim(F.coalesce("rationale", F.lit(""))) == "",
    })).alias("failure"))
    return missing.unionByName(children).unionByName(of_table)


def relations(decisions: DataFrame) -> DataFrame:
    """One row per accepted (child, table)."""
    return decisions.select("paper_id", "child_id", "parent_id", F.explode("relevant_tables").alias("r")).select("paper_id", "child_id", "parent_id", "r.*").where("label = 0")


def table_summary(tables: DataFrame, accepted: DataFrame) -> DataFrame:
    """Every table with its number of relations and children; tables without any stay."""
    n = accepted.groupBy("paper_id", "table_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("child_id")).alias("ids"))
    joined = tables.join(n, ["paper_id", "table_id"], "left")
    return joined.withColumn("relations", F.coalesce("n", F.lit(0))).withColumn("child_ids", F.coalesce("ids", F.array().cast("array<string>"))).drop("n", "ids")


def packages(items: DataFrame) -> DataFrame:
    """One nested row per paper: parents in order, each with its children in order."""
    child = F.struct("child_id", "char_start", "char_end", "text")
    parents = items.groupBy("paper_id", "parent_id").agg(F.array_sort(F.collect_list(child)).alias("children"))
    return parents.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("parent_id", "children"))).alias("parents"))
