"""Coverage of evidence by texts: substring first, then token containment, and a sequence ratio for what is left."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import text

# Token shares from which evidence is covered or weakly covered; the least sequence ratio.
COVERED, WEAK, RATIO = 0.65, 0.45, 0.80
#: Evidence up to so many rows and bytes of text is sent to all executors; more is matched by joins on tokens.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 8 << 20


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def is_small(df: DataFrame, column: str) -> bool:
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def token_overlaps(evidence: DataFrame, parents: DataFrame) -> DataFrame:
    """(evidence_id, parent_id, shared, total): pairs that share a token, by an equi-join on tokens.

    evidence(evidence_id, text), parents(parent_id, text). Documents are cut to the evidence's vocabulary first.
    """
    words = evidence.select("evidence_id", F.size(text.tokens(F.col("text"))).alias("total"), F.explode(text.tokens(F.col("text"))).alias("token"))
    vocabulary = words.select("token").distinct()
    own = parents.select("parent_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    if is_small(evidence, "text"):
        vocabulary, words = F.broadcast(vocabulary), F.broadcast(words)
    pairs = own.join(vocabulary, "token", "left_semi").join(words, "token")
    return pairs.groupBy("evidence_id", "parent_id").agg(F.count("*").alias("shared"), F.first("total").alias("total"))


def best_evidence(evidence: DataFrame, parents: DataFrame) -> DataFrame:
    """Each evidence's best parent by share of its tokens (then the smaller id) and the status that share gives."""
    w = Window.partitionBy("evidence_id").orderBy(F.desc("share"), "parent_id")
    rated = token_overlaps(evidence, parents).withColumn("share", F.col("shared") / F.col("total"))
    best = rated.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("evidence_id", "parent_id", "share")
    status = F.when(F.col("share") >= COVERED, "covered").when(F.col("share") >= WEAK, "weak").otherwise("uncovered")
    return evidence.select("evidence_id").join(best, "evidence_id", "left").withColumn("status", status)


def substring_coverage(evidence: DataFrame, parents: DataFrame) -> DataFrame:
    """(evidence_id, parents): in how many parents each evidence's normal text stands, word for word.

    Evidence of six words or more is met by a join on four of its inner words, hashed (it may start and end inside
    a word), and only what meets is compared in full. Shorter evidence is a set of queries that is tested against
    all parents in blocks of at most BROADCAST_ROWS.
    """
    needles = evidence.select("evidence_id", F.lower(text.collapse(F.col("text"))).alias("needle")).where("needle <> ''").withColumn("w", F.split("needle", " "))
    hay = parents.select("parent_id", F.lower(text.collapse(F.col("text"))).alias("hay"))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - 3)), lambda i: F.xxhash64(F.slice(c, i, F.lit(4))))
    keyed = hay.where(F.size(F.split("hay", " ")) >= 6).select("parent_id", "hay", F.element_at(F.transform(F.array(F.split("hay", " ")), grams), 1).alias("keys"))
    long = needles.where("size(w) >= 6").select("evidence_id", "needle", F.xxhash64(F.slice("w", 2, 4)).alias("key"))
    if is_small(evidence, "text"):
        long = F.broadcast(long)
    met = keyed.select("parent_id", "hay", F.explode_outer("keys").alias("key")).join(long, "key")
    found = met.where(F.contains("hay", "needle")).select("evidence_id", "parent_id").distinct()
    short = needles.where("size(w) < 6").select("evidence_id", "needle")
    n = short.count()
    blocks = -(-n // max(1, BROADCAST_ROWS))
    for k in range(blocks):
        own = short if blocks == 1 else short.where(F.pmod(F.xxhash64("evidence_id"), F.lit(blocks)) == k)
        found = found.unionByName(hay.join(F.broadcast(own), F.contains("hay", "needle")).select("evidence_id", "parent_id"))
    counts = found.groupBy("evidence_id").agg(F.count("*").alias("n"))
    return evidence.select("evidence_id").join(counts, "evidence_id", "left").select("evidence_id", F.coalesce("n", F.lit(0)).alias("parents"))


def coverage_cascade(evidence: DataFrame, parents: DataFrame) -> DataFrame:
    """(evidence_id, tier): substring, then tokens, then sequence ratio against the best parent, else uncovered.

    Each tier sees only what the tiers before it left.
    """
    first = substring_coverage(evidence, parents).where("parents > 0").select("evidence_id", F.lit("substring").alias("tier"))
    rest = evidence.join(first, "evidence_id", "left_anti")
    tokens = best_evidence(rest, parents)
    second = tokens.where("status = 'covered'").select("evidence_id", F.lit("tokens").alias("tier"))
    third = tokens.where("status <> 'covered' AND parent_id IS NOT NULL").join(rest.select("evidence_id", F.col("text").alias("a")), "evidence_id").join(parents.select("parent_id", F.col("text").alias("b")), "parent_id")
    near = third.where(sequence_ratio("a", "b") >= RATIO).select("evidence_id", F.lit("sequence_ratio").alias("tier"))
    found = first.unionByName(second).unionByName(near)
    return evidence.select("evidence_id").join(found, "evidence_id", "left").withColumn("tier", F.coalesce("tier", F.lit("uncovered")))
