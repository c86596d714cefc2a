"""Section trees as flat tables: flattening, parents, page ranges, deepest section of a page, validation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FLAT = "doc string, preorder int, parent_preorder int, depth int, title string, node_type string, ancestors array<string>, body string"


def flatten(trees: DataFrame, children: str = "children") -> DataFrame:
    """Nodes of JSON trees ``trees(doc, tree)`` in pre-order, with depth and the titles above; a tree is one value, so is flattened alone."""

    def run(batches):
        for b in batches:
            out = []
            for doc, tree in zip(b["doc"], b["tree"], strict=True):
                stack, n = [(json.loads(tree), -1, 0, [])] if tree else [], 0
                while stack:
                    node, parent, depth, above = stack.pop()
                    title = (node.get("title") or "").strip()
                    out.append((doc, n, parent, depth, title, node.get("type"), above, node.get("content")))
                    below = [*above, title] if title else above
                    stack += [(c, n, depth + 1, below) for c in reversed(node.get(children) or [])]
                    n += 1
            yield pd.DataFrame(out, columns=[x.strip().split(" ")[0] for x in _FLAT.split(", ")])

    return trees.select("doc", "tree").mapInPandas(run, _FLAT)


def parents_by_depth(nodes: DataFrame) -> DataFrame:
    """``nodes(doc, idx, depth)`` with parent_idx: the last earlier node of smaller depth; null at the top.

    For each smaller depth of the document (depths are few) the last earlier node of that depth is carried along; a
    parent is the largest of these. No list of earlier nodes is built.
    """
    depths = nodes.select("doc", F.col("depth").alias("d2")).distinct()
    asked = nodes.select("doc", "idx", "depth").join(depths, "doc").where("d2 < depth").select("doc", "idx", "d2", F.lit(None).cast(nodes.schema["idx"].dataType).alias("own"))
    there = nodes.select("doc", "idx", F.col("depth").alias("d2"), F.col("idx").alias("own"))
    before = Window.partitionBy("doc", "d2").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    found = asked.unionByName(there).withColumn("last", F.last("own", ignorenulls=True).over(before)).where("own IS NULL")
    parent = found.groupBy("doc", "idx").agg(F.max("last").alias("parent_idx"))
    return nodes.join(parent, ["doc", "idx"], "left")


def page_ranges(entries: DataFrame) -> DataFrame:
    """``entries(doc, idx, start_page, at_page_start, page_count)`` with end_page: up to the next entry.

    The next entry's own page belongs to it alone if it starts the page; an end never precedes its start.
    """
    w = Window.partitionBy("doc").orderBy("idx")
    after, fresh = F.lead("start_page").over(w), F.lead("at_page_start").over(w)
    end = F.when(after.isNull(), F.col("page_count")).when(fresh, after - 1).otherwise(after)
    return entries.withColumn("end_page", F.greatest("start_page", end))


def deepest_section(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """For ``pages(doc, page)`` the narrowest section of ``sections(doc, node_id, depth, start_page, end_page)`` over it; ties to depth, then order."""
    joined = pages.join(sections, "doc").where(F.col("page").between(F.col("start_page"), F.col("end_page")))
    w = Window.partitionBy("doc", "page").orderBy(F.col("end_page") - F.col("start_page"), F.desc("depth"), "node_id")
    return joined.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def problems(sections: DataFrame) -> DataFrame:
    """(doc, node_id, problem) for ids used twice, ranges the wrong way round and starts that go back."""
    w = Window.partitionBy("doc").orderBy("idx")
    twice = sections.groupBy("doc", "node_id").agg(F.count("*").alias("n")).where("n > 1").select("doc", "node_id", F.lit("duplicate_id").alias("problem"))
    turned = sections.where("end_page < start_page").select("doc", "node_id", F.lit("range_reversed").alias("problem"))
    back = sections.where("depth = 0").withColumn("_b", F.lag("start_page").over(w)).where("start_page < _b").select("doc", "node_id", F.lit("start_before_previous").alias("problem"))
    return twice.unionByName(turned).unionByName(back)


def page_validity(entries: DataFrame) -> DataFrame:
    """``entries(doc, idx, label, title, page, page_count)`` with ``removed``: why an entry goes, or null."""
    again = F.row_number().over(Window.partitionBy("doc", "label", "title", "page").orderBy("idx")) > 1
    return entries.withColumn("removed", F.when(F.col("page").isNull() | (F.col("page") < 1) | (F.col("page") > F.col("page_count")), "page_out_of_range").when(again, "duplicate_entry"))
