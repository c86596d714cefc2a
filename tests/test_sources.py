"""Sources and sinks on small files."""

import sqlite3

import pytest

from evidentia.sources import io


def test_sqlite_memory(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "memory.db")
    con.execute("CREATE TABLE memories (memory_id TEXT, memory_type TEXT, text TEXT, tags_json TEXT, confidence REAL, updated_at_utc TEXT, status TEXT)")
    con.executemany("INSERT INTO memories VALUES (?, ?, ?, ?, ?, ?, ?)", [("m1", "lesson", "a", '["x", "y"]', 0.5, "2024", "active"), ("m2", "lesson", "b", None, 0.1, "2024", "retired"), ("m3", "rule", None, None, None, "2025", "active")])
    con.commit()
    con.close()
    got = io.active_memory(spark, str(tmp_path / "memory.db")).orderBy("memory_id").collect()
    assert [(r["memory_id"], r["text"], r["tags"], r["confidence"]) for r in got] == [("m1", "a", ["x", "y"], 0.5), ("m3", None, None, None)]


def test_reference_sets_and_samples(spark):
    sets = spark.createDataFrame([("p_fulltext_conditions", [("Table 1", [("e1", "a"), ("e2", "b")]), ("Table 2", [])])], "slug string, tables array<struct<label:string,evidence:array<struct<evidence_id:string,text:string>>>>")
    assert [tuple(r) for r in io.reference_rows(sets).orderBy("pos").collect()] == [("p", "Table 1", 0, "e1", "a"), ("p", "Table 1", 1, "e2", "b")]
    rows = spark.createDataFrame([("d", "t", [("p", [("c", "x", 0)]), ("q", [])])], "doc string, table_id string, parents array<struct<parent_id:string,children:array<struct<child_id:string,text:string,label:int>>>>")
    assert [tuple(r) for r in io.flattened_samples(rows).collect()] == [("d", "t", "p", "c", "x", 0)]


def test_sources_pair_by_prefix():
    assert io.paired_sources({"a_anchor_manifest": "m", "a_popo_tree_dir": "t", "b_anchor_manifest": "lone"}) == [{"slug": "a", "anchor_manifest": "m", "tree_dir": "t"}]
    with pytest.raises(ValueError, match="twice"):
        io.paired_sources({"sources": [{"slug": "a"}], "a_anchor_manifest": "m", "a_popo_tree_dir": "t"})


def test_decision_report_and_paths(spark):
    got = spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "k string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert sorted(map(tuple, io.decision_report(got, asked, "k").collect())) == [("b", "duplicate"), ("c", "missing"), ("x", "unknown")]
    paths = spark.createDataFrame([("a", None, "r", "d"), ("b", None, None, "d"), ("c", "e", "r", None)], "doc string, explicit string, reviewed string, draft string")
    assert [r["path"] for r in io.reviewed_paths(paths, False).orderBy("doc").collect()] == ["r", None, "e"]
    assert [r["path"] for r in io.reviewed_paths(paths, True).orderBy("doc").collect()] == ["r", "d", "e"]


def test_publish_is_all_or_nothing(spark, tmp_path):
    out = spark.createDataFrame([(1,)], "x int")
    folder = str(tmp_path / "out")
    assert io.publish({"rows": out}, spark.createDataFrame([("a", "pass")], "doc string, status string"), folder)
    assert spark.read.schema("x int").json(f"{folder}/rows").count() == 1
    assert not io.publish({"rows": out}, spark.createDataFrame([("a", "fail")], "doc string, status string"), folder)
    assert spark.read.schema("x int").json(f"{folder}/rows").count() == 0 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
