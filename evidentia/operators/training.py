"""Training rows for a pair classifier: from prompts with tagged sections, checked, and split without overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import blocks, text
from evidentia.operators.pairwise import tagged_section


def pair_rows(prompts: DataFrame) -> DataFrame:
    """``prompts(id, input, match)`` to (id, label, text_a, text_b, status); a prompt without both sections goes in whole."""
    facts, claim = tagged_section(F.col("input"), "Ground Truth"), tagged_section(F.col("input"), "Citation Sentence")
    both = (facts != "") & (claim != "")
    own = prompts.withColumn("_f", facts).withColumn("_c", claim)
    return own.select(
        text.collapse(F.col("id")).alias("id"), blocks.label_of(F.col("match")).alias("label"),
        F.when(both, F.concat(F.lit("cited paper facts: "), F.col("_f"))).otherwise(text.collapse(F.col("input"))).alias("text_a"),
        F.when(both, F.concat(F.lit("originalkey author_related_content: "), F.col("_c"))).otherwise("").alias("text_b"),
        F.when(both, "structured_sections").otherwise("fallback_raw_input").alias("status"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Rows that cannot be trained on: no text, or a label that is neither 0 nor 1."""
    return rows.where(F.col("label").isNull() | ~F.col("label").isin(0, 1) | (F.trim("text_a") == ""))


def overlap(train: DataFrame, validation: DataFrame, key: str = "id") -> DataFrame:
    """Ids in both parts of a split; a good split has none."""
    return train.select(key).distinct().join(validation.select(key).distinct(), key, "left_semi")
