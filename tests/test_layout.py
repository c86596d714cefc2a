"""Layout and candidate queries against their SQL on the smallest tables, and cases that the tables do not hold."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia.operators import candidates, labels, leaves, normalize
from evidentia.plans import on_layout

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(on_layout.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = on_layout.QUERIES[name](spark, SMALL)
    names = sorted(got.columns)
    want = duck.sql(on_layout.SQL[name])
    assert sorted(want.columns) == names
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.select(*names).fetchall()))


def test_required_ids_and_templates(spark):
    rows = spark.createDataFrame([(None, "b"), ("  ", "c")], "table_id string, label string")
    with pytest.raises(Exception, match="missing stable id"):
        rows.select(normalize.required_id(rows, ("table_id", "id"), "table")).collect()
    with pytest.raises(ValueError, match="unresolved"):
        normalize.filled("{{a}} {{b}}", a=F.lit(1))
    key = rows.select(normalize.composite_key("table_id", "label").alias("k")).collect()
    assert [r["k"] for r in key] == ["::b", "  ::c"]
    moved = spark.createDataFrame([("/old/ws/x/y.json",), ("x.json",), ("/other/z",), (None,)], "p string").select(normalize.workspace_path(F.col("p"), "/new/ws").alias("p")).collect()
    assert [r["p"] for r in moved] == ["/new/ws/x/y.json", "/new/ws/x.json", "/other/z", None]


def test_segments_run_to_the_next_label(spark):
    df = spark.createDataFrame([("Table 1: one  two Tab. S2 - three",), ("none",), (None,)], "t string").select(labels.segments(F.col("t")).alias("s")).collect()
    assert [[tuple(x) for x in r["s"] or []] for r in df] == [[("Table 1", "Table 1: one two"), ("Tab. S2", "Tab. S2 - three")], [], []]


def test_annotations_need_one_paragraph(spark):
    paragraphs = spark.createDataFrame([("d", "p1", [1, 2]), ("d", "p2", [3])], "doc string, parent_id string, raw_indices array<int>")
    fine = candidates.annotations(spark.createDataFrame([("d", "t", 2), ("d", "t", 1)], "doc string, table_id string, raw_index int"), paragraphs)
    assert [tuple(r) for r in fine.collect()] == [("d", "t", "p1")]
    with pytest.raises(Exception, match="without one paragraph"):
        candidates.annotations(spark.createDataFrame([("d", "t", 9)], "doc string, table_id string, raw_index int"), paragraphs).collect()


def test_nodes_and_paths(spark):
    nodes = spark.createDataFrame([("d", 0, "table", [7]), ("d", 1, "table", [3]), ("d", 2, "table", []), ("d", 3, "text", [1])], "doc string, preorder int, type string, block_ids array<int>")
    assert [(r["preorder"], r["node_id"]) for r in leaves.split_nodes(nodes, "table").orderBy("node_order").collect()] == [(1, "popo-table-0001"), (0, "popo-table-0002"), (2, "popo-table-0003")]
    paths = spark.createDataFrame([(["a"], "b"), (["a", "b"], "b"), ([], ""), ([], "x")], "a array<string>, t string").select(leaves.section_path(F.col("a"), F.col("t")).alias("p")).collect()
    assert [r["p"] for r in paths] == [["a", "b"], ["a", "b"], [], ["x"]]
    heads = spark.createDataFrame([("1.2",), ("A",), ("Intro",), (None,)], "label string")
    assert [r["label"] for r in leaves.heading_entries(heads).collect()] == ["1.2", "A"]


def test_lines_are_trimmed_of_blanks_alone(spark):
    # F.transform gives the place of an element to a function of two arguments: trim took it for the characters to trim
    df = spark.createDataFrame([("0 a\n1 b\n  c \nc\n4 d3\n \n\n66",), (" \n",), (None,)], "t string")
    got = [r["u"] for r in df.select(normalize.unique_texts(F.split("t", "\n")).alias("u")).collect()]
    assert got == [["0 a", "1 b", "c", "4 d3", "66"], [], None]


def test_leaves_go_to_their_sections(spark):
    sections = spark.createDataFrame([("d", 1, 1, 1, 9, False), ("d", 2, 2, 2, 5, True), ("d", 3, 2, 4, 6, False), ("d", 4, 2, 4, 6, False), ("e", 7, 1, 3, 3, False)], "doc string, node_id long, depth long, start_page long, end_page long, outline_only boolean")
    rows = [("d", 0, 2, "text", "a"), ("d", 1, 2, "table", "b"), ("d", 2, 5, "text", None), ("d", 3, 20, "text", "a"), ("d", 4, 20, "table", "a"), ("d", 5, 9, "table", "c"), ("e", 0, 1, "table", None), ("f", 0, 1, "table", "a"), ("d", 6, None, "table", "z")]
    own = spark.createDataFrame(rows, "doc string, content_index long, page long, kind string, label string")
    asked = spark.createDataFrame([("d", "a", 3), ("d", "a", 2), ("d", "c", 99), ("d", None, 1), ("g", "a", 1)], "doc string, label string, node_id long")
    got = {(r["doc"], r["content_index"]): (r["parent_node_id"], r["assignment_reason"]) for r in leaves.attach(own, sections, asked).collect()}
    assert got == {
        ("d", 1): (2, "page_range_deepest_match"), ("d", 2): (4, "page_range_deepest_match"), ("d", 4): (2, "manifest_override"), ("d", 5): (1, "page_range_deepest_match_after_missing_override"),
        ("e", 0): (7, "fallback_last_node"), ("d", 6): (4, "fallback_last_node"),
    }
    plain = {(r["doc"], r["content_index"]): r["parent_node_id"] for r in leaves.attach(own, sections).collect()}
    assert plain == {("d", 1): 2, ("d", 2): 4, ("d", 4): 4, ("d", 5): 1, ("e", 0): 7, ("d", 6): 4}


def test_ranges_end_at_the_next_entry_of_no_greater_depth(spark):
    r = random.Random(3)
    entries = [(d, i, r.choice([0, 1, 1, 2, 5]), i + r.randint(0, 1), 40) for d in "ab" for i in r.sample(range(40), 25)]
    got = leaves.draft_ranges(spark.createDataFrame(entries, "doc string, idx int, depth int, start_page int, page_count int"))
    ends = {(x["doc"], x["idx"]): x["end_page"] for x in got.collect()}
    for d, i, depth, start, pages in entries:
        after = min(((j, p) for e, j, k, p, _ in entries if e == d and j > i and k <= depth), default=(0, pages))
        assert ends[d, i] == max(start, after[1])
    assert got.columns == ["doc", "idx", "depth", "start_page", "page_count", "end_page"] and len(ends) == len(entries)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_lines_are_moved_once_for_each_part(spark):
    plan = on_layout.attach_leaves(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # sections, leaves, overrides
