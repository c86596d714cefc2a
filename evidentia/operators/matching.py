"""Matching: spatial pair audit and unique complete matching of anchors and nodes; nearest preceding; best evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import geometry

# Provisional guards of table-anchor matching.
MIN_IOU, MAX_DELTA = 0.70, 0.03


def pair_audit(anchors: DataFrame, nodes: DataFrame, min_iou: float = MIN_IOU, max_delta: float = MAX_DELTA) -> DataFrame:
    """Every (anchor, node) pair of a document: its best location on the anchor's page, then the guards.

    anchors(doc, anchor_id, page_index, bbox), nodes(doc, node_id, locations array<struct<page,bbox>>). The best
    location has the largest overlap, then the least difference; guards come second, so another location that
    would pass them does not count.
    """
    left = anchors.select("doc", "anchor_id", F.col("page_index").alias("page"), geometry.normal_box(F.col("bbox")).alias("box"))
    here = F.filter("locations", lambda x: x["page"] == F.col("page"))
    boxes = F.transform(here, lambda x: geometry.normal_box(x["bbox"]))
    rated = F.transform(F.filter(boxes, lambda b: b.isNotNull()), lambda b: F.struct(geometry.iou(F.col("box"), b).alias("iou"), (-geometry.largest_delta(F.col("box"), b)).alias("nearness"), b.alias("box")))
    pairs = left.join(nodes.select("doc", "node_id", "locations"), "doc").withColumn("best", F.array_max(rated))
    reason = (
        F.when(F.col("box").isNull(), "anchor_box_invalid").when(F.size(here) == 0, "no_location_on_page").when(F.col("best").isNull(), "no_valid_location_box")
        .when(F.col("best.iou") < min_iou, "overlap_too_small").when(-F.col("best.nearness") > max_delta, "difference_too_large")
    )
    return pairs.select("doc", "anchor_id", "node_id", F.col("best.iou").alias("iou"), (-F.col("best.nearness")).alias("delta"), reason.alias("reason"), reason.isNull().alias("eligible"))


def complete_matchings(eligible: dict[str, set[str]], most: int = 2) -> list[dict[str, str]]:
    """Up to ``most`` ways to give every anchor a node of its own; the anchor with fewest nodes left goes first."""
    found: list[dict[str, str]] = []

    def place(open_anchors: frozenset, used: frozenset, done: dict) -> None:
        if len(found) >= most:
            return
        if not open_anchors:
            found.append(dict(done))
            return
        anchor = min(open_anchors, key=lambda a: (len(eligible[a] - used), a))
        for node in sorted(eligible[anchor] - used):
            place(open_anchors - {anchor}, used | {node}, done | {anchor: node})

    place(frozenset(eligible), frozenset(), {})
    return found


def match_anchors(anchors: DataFrame, nodes: DataFrame, min_iou: float = MIN_IOU, max_delta: float = MAX_DELTA) -> DataFrame:
    """(doc, status, reason, anchor_id, node_id): the only complete matching of each document, or why there is none.

    A document fails on unequal counts, on repeated anchors, on an anchor without an eligible node, without a
    complete matching and with two or more. A document's anchors are few; pairs are compared in the JVM.
    """
    ids = anchors.groupBy("doc").agg(F.collect_list("anchor_id").alias("anchor_ids"))
    counts = nodes.groupBy("doc").agg(F.count("*").alias("n_nodes"))
    pairs = pair_audit(anchors, nodes, min_iou, max_delta).where("eligible").groupBy("doc").agg(F.collect_list(F.struct("anchor_id", "node_id")).alias("pairs"))
    rows = ids.join(counts, "doc", "left").join(pairs, "doc", "left")

    def solve(batches):
        for b in batches:
            out = []
            for doc, names, n, own in zip(b["doc"], b["anchor_ids"], b["n_nodes"], b["pairs"], strict=True):
                eligible: dict[str, set[str]] = {a: set() for a in names}
                for p in [] if own is None else own:
                    eligible[p["anchor_id"]].add(p["node_id"])
                if len(names) != (0 if pd.isna(n) else n):
                    out.append((doc, "fail", "table_count_mismatch", None, None))
                elif len(eligible) != len(names):
                    out.append((doc, "fail", "duplicate_anchor_labels", None, None))
                elif not all(eligible.values()):
                    out.append((doc, "fail", "anchor_has_no_eligible_node", None, None))
                elif len(ways := complete_matchings(eligible)) != 1:
                    out.append((doc, "fail", "ambiguous_multiple_complete_matchings" if ways else "no_complete_matching", None, None))
                else:
                    out += [(doc, "pass", None, a, node) for a, node in sorted(ways[0].items())]
            yield pd.DataFrame(out, columns=["doc", "status", "reason", "anchor_id", "node_id"])

    return rows.mapInPandas(solve, "doc string, status string, reason string, anchor_id string, node_id string")


def nearest_preceding(rows: DataFrame, marks: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with the ``value`` of the last mark at or before their place in ``order``, per ``keys``.

    One union and one window instead of a range join; a row without an earlier mark gets a null.
    """
    tagged = rows.withColumn("_m", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_r", F.lit(1))
    own = marks.select(*keys, order, F.col(value).alias("_m")).withColumn("_r", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(order, "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(tagged, allowMissingColumns=True)
    return both.withColumn(value, F.last("_m", ignorenulls=True).over(w)).where("_r = 1").drop("_m", "_r")


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def completeness(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, unexpected or found more than once, with the problem."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(True))
    b = found.groupBy(key).agg(F.count("*").alias("_n"))
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem IS NOT NULL")
