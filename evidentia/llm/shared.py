"""What the operators of this subpackage share: cutting lineage, hashing, components, text rules."""

from __future__ import annotations

import gc
import random
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the controls 0x09 to 0x0D.
WORD_CLASS = r"[^\x20\x09-\x0D]"
GAP_CLASS = r"[\x20\x09-\x0D]"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from the session; a temporary one only in local mode where none is set (tests)."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known and sc.master.startswith("local"):
        known = tempfile.mkdtemp(prefix="evidentia-checkpoints-")
    if not known:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that lost executors cost no recomputation.

    A checkpoint keeps its plan's estimated size, and that of a join is the product of its sides: over rounds of joins the
    digits of such numbers multiply, up to seconds and hundreds of MB of the driver for one plan. So the rows go on without it.
    """
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    jvm, session, plan = df.sparkSession._jvm, kept._jdf.sparkSession(), kept._jdf.queryExecution().analyzed()
    none = jvm.scala.Option.empty()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), df.sparkSession)


def release(spark: SparkSession) -> None:
    """Lets the driver collect finished plans, so that Spark's cleaner drops their shuffle files, broadcasts and generated code.

    It does so by itself only when the heap is full; an operator of many small jobs should not wait for that.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Stands for a null doc_id where rows go through Python, which has no null among integers; sorts first.
NO_ID = -(2**63)


def with_id(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with NO_ID for null ids."""
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")


def with_null_id(df: DataFrame) -> DataFrame:
    """Null ids again."""
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 0, F.lit(False))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


LETTER_RUN = re.compile(r"[^\W\d_]+")


FINISH_ROWS = 1_000_000
#: Orders of ids that rounds of ``components`` take in turn: few, so that generated code is the same again.
MASKS = (0, *(random.Random(i).getrandbits(63) for i in (1, 2)))


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by shuffle and sort: no side that may grow goes through the driver."""
    return df.hint("merge")


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all edges of a partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pd.DataFrame({"node": np.array(nodes, np.int64), "to": np.array([find(x) for x in nodes], np.int64)})


def components(edges: DataFrame, native: bool = False, limit: int = 80) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as ``(node, root)``, for nodes that have an edge.

    Each round points every node to the neighbour (or itself) that is least in the round's order of ids, then
    contracts the graph along these pointers. The orders differ by a mask, so chains contract by a
    constant share per round in expectation; a star of any size goes in one. All steps are keyed joins and
    aggregates with map-side combination, and each round is cut in the shared folder. Once FINISH_ROWS edges or
    fewer are left, and unless only DataFrame functions may be used (``native``), one task finishes by
    union-find. Roots are members of their component.
    """
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pointers: list[DataFrame] = []
    for i in range(limit):
        if live.isEmpty():
            break
        if not native and live.count() <= FINISH_ROWS:
            pointers.append(live.coalesce(1).mapInPandas(_finish, "node long, to long"))
            break
        mask = F.lit(MASKS[i % len(MASKS)])
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        to = cut(least.select(F.col("a").alias("node"), F.least(F.col("m"), F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to")))
        pointers.append(to)
        x, y = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = live.join(by_key(x), "a").join(by_key(y), "b").where("x <> y")
        live = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    if not pointers:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = pointers[0].withColumnRenamed("to", "root")
    for to in pointers[1:]:
        step = to.select(F.col("node").alias("root"), F.col("to").alias("next"))
        out = out.join(by_key(step), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut(out)
