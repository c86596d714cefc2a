"""The evidence engine on small inputs with known results."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.functions import geometry, htmltable, jsonfix, mentions, scoring, spans, text
from evidentia.operators import coverage, datasets, inventory, matching, normalize, pairwise, policy, review, tree
from evidentia.plans import on_text
from evidentia.sources import io
from evidentia.streaming import decisions as stream


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return df.select(expression.alias("x")).first()["x"]


def test_spans_scope():
    body = "Dr. Smith used e.g. BLEU v1.2.<|txt_split|>结果稳定。下一句。"
    assert [body[a:b] for a, b in spans.spans_v2(body)] == ["Dr. Smith used e.g. BLEU v1.2.", "结果稳定。", "下一句。"]
    assert spans.spans_v2(None) == [] and spans.spans_v2(" \n\n ") == []
    long = "word, " * 300 + "end"
    parts = spans.spans_v2(long)
    assert max(b - a for a, b in parts) <= 875 and " ".join(long[a:b] for a, b in parts).replace(" ", "") == long.replace(" ", "")
    assert spans.cut_long("x" * 2000, 0, 2000, 480, ";,", False) == [(0, 2000)]
    assert max(b - a for a, b in spans.spans_v2("x" * 2000)) == 700
    assert "".join("A b, c. D e. f"[a:b] for a, b in spans.long_spans_v1("A b, c. D e. f")) == "A b, c. D e. f"


def test_children(spark):
    body = "All runs use five seeds. Table results follow."
    rows = spans.children(spark.createDataFrame([("P1", body)], "parent_id string, full_text string")).collect()
    assert [r["child_id"] for r in rows] == ["P1-child-0001", "P1-child-0002"]
    assert all(body[r["char_start"] : r["char_end"]] == r["text"] for r in rows)


def test_spans_are_found_in_pieces(spark, monkeypatch):
    # the spans of a whole batch were held as Python objects at once; text of a few characters goes out before the next is split
    monkeypatch.setattr(spans, "MOST_CHARS", 7)
    texts = ["One é𝄞 two. Three!", None, "", "x. Y", "Last one. End"]
    pieces = list(spans._pieces(pa.array(texts)))
    assert [len(p) for p in pieces] == [1, 3, 1] and [t for p in pieces for (t,) in p] == texts
    found = list(spans.text_spans_v2_udf.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [len(x) for x in found] == [1, 3, 1]
    assert [x and [s["text"] for s in x] for a in found for x in a.to_pylist()] == [["One é𝄞 two.", "Three!"], [], [], ["x. Y"], ["Last one.", "End"]]
    parents = spark.createDataFrame(list(enumerate(texts)), "parent_id int, full_text string")
    whole, cut_here = spans.children(parents), spans.children(parents, spans.spans_v2_udf("full_text"))
    assert sorted(whole.collect()) == sorted(cut_here.collect()) and whole.count() == 5


def test_offsets_of_all_children_of_a_parent(spark):
    offsets = [(0, 2, "é𝄞"), (2, 4, "bc"), (1, 3, "bc"), (-1, 2, "é𝄞"), (2, 2, ""), (2, 9, "bc"), (None, 2, "é𝄞"), (0, None, None), (0, 1, None)]
    schema = "k int, parent_text string, children array<struct<char_start:int,char_end:int,text:string>>"
    rows = spark.createDataFrame([(0, "é𝄞bc", offsets), (1, None, offsets), (2, "", []), (3, "x", None)], schema)
    got = {r["k"]: r["problems"] for r in normalize.parents_with_offsets(rows).collect()}
    one_by_one = normalize.texts_with_offsets(rows.select("k", "parent_text", F.posexplode("children").alias("pos", "x")).select("k", "pos", "parent_text", "x.*"))
    assert got[0][:6] == [None, None, "text_is_not_slice", "offset_out_of_range", "offset_out_of_range", "offset_out_of_range"]
    assert {(k, p): x for k in (0, 1) for p, x in enumerate(got[k])} == {(r["k"], r["pos"]): r["problem"] for r in one_by_one.collect()}
    assert got[2] == [] and got[3] is None


def test_offset_audit_reads_a_text_once(spark, tmp_path):
    docs = [(50, "A b. C d."), (51, "A b. C d."), (51, "other, longer text. With more."), (100, " "), (150, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = on_text.span_offset_audit(spark, str(tmp_path))
    assert [r["doc_id"] for r in got.collect()] == [50]  # texts that share an id are not checked against each other's spans
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_mentions():
    labels = {"t1": "Table 1", "t2": "Table 2", "t3": "Table 3", "ts1": "Table S1"}
    found = mentions.find_mentions("See Tables 1–3 and Tbl. S1.", labels)
    assert [m["table_ids"] for m in found] == [["t1", "t2", "t3"], ["ts1"]]
    assert mentions.find_mentions("table mixing", labels)[0]["designators"] == ["mixi"]
    assert mentions.find_mentions("Table 1 to 500", labels)[0]["table_ids"] == ["t1"]
    assert mentions.find_mentions(None, {}) == []


def test_text_columns(spark):
    assert one(spark, text.is_reference_path(F.array(F.lit("Paper"), F.lit("A. Bibliography"))))
    assert not one(spark, text.is_reference_path(F.array(F.lit("F Reference-free Evaluation"))))
    assert one(spark, text.collapse(F.lit(" a \n b "))) == "a b"
    assert one(spark, text.safe_stem(F.lit("paper/one"))) == "paper_one" and len(one(spark, text.safe_stem(F.lit("///")))) == 16
    assert one(spark, text.nfkc_casefold(F.col("t")), t="Ｇroße  ﬁ") == "grosse fi"
    assert one(spark, text.tokens(F.lit("<td>Table</td> Models models x-ray_2 this"))) == ["models", "x-ray_2"]
    assert one(spark, text.table_reference(F.lit("see tab. 3(a)"), F.lit("Table 3"))) and not one(spark, text.table_reference(F.lit("Table 33"), F.lit("Table 3")))
    assert one(spark, text.share_section(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) and not one(spark, text.share_section(F.array().cast("array<string>"), F.array(F.lit("a"))))
    assert one(spark, text.least_distance(F.array(F.lit(1), F.lit(9)), F.array(F.lit(6)))) == 3
    assert one(spark, text.clamp_score(F.lit("1.7"))) == 1.0 and one(spark, text.clamp_score(F.lit("x"))) is None
    assert one(spark, text.evidence_family(F.lit("Model_Architecture"))) == "model"
    assert one(spark, text.without_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, text.truncated(F.lit("abcdef"), 3)) == "abc\n...[TRUNCATED]"


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, geometry.normal_box(box(100, 100, 200, 300))) == [0.1, 0.1, 0.2, 0.3]
    assert one(spark, geometry.normal_box(box(0.5, 0, 0.5, 1))) is None
    assert one(spark, geometry.iou(box(0, 0, 1, 1), box(0.5, 0, 1.5, 1))) == pytest.approx(1 / 3)
    assert one(spark, geometry.vertical(box(0, 0, 9, 5), box(0, 8, 9, 9)))["relation"] == "above"


def test_matching(spark):
    ok = matching.complete_matchings({"a": {"x", "y"}, "b": {"x"}})
    assert ok == [{"a": "y", "b": "x"}] and len(matching.complete_matchings({"a": {"x", "y"}, "b": {"x", "y"}})) == 2
    assert matching.complete_matchings({"a": {"x"}, "b": {"x"}}) == []


def test_best_location_goes_before_guards(spark):
    anchors = spark.createDataFrame([("d", "t", 1, [0.0, 0.0, 0.4, 0.4])], "doc string, anchor_id string, page_index int, bbox array<double>")
    nodes = spark.createDataFrame([("d", "n", [(1, [0.0, 0.0, 0.4, 0.44]), (2, [0.0, 0.0, 0.4, 0.4])])], "doc string, node_id string, locations array<struct<page:int,bbox:array<double>>>")
    assert matching.pair_audit(anchors, nodes).first()["reason"] == "difference_too_large"


def test_nearest_and_completeness(spark):
    rows = spark.createDataFrame([("d", 1.0), ("d", 5.0)], "doc string, at double")
    marks = spark.createDataFrame([("d", 2.0, "s2"), ("d", 5.0, "s5")], "doc string, at double, section string")
    assert [r["section"] for r in matching.nearest_preceding(rows, marks, ["doc"], "at", "section").orderBy("at").collect()] == [None, "s5"]
    got = matching.completeness(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,), (3,)], "k int"), "k").collect()
    assert {(r["k"], r["problem"]) for r in got} == {(1, "missing"), (2, "duplicate"), (3, "unexpected")}


def test_html_and_json():
    assert htmltable.rows_as_text("<table><tr><th>A</th><th>A</th></tr><tr><td colspan=2>s</td></tr><tr><td>1</td><td></td></tr></table>")[0]["text"] == "Row 1 | A: s ; A: s"
    assert htmltable.rows_as_text(None) == []
    assert jsonfix.first_object('x {"a": "}"} y') == '{"a": "}"}' and jsonfix.parse("nothing") == {}


def test_tree(spark):
    rows = tree.flatten(spark.createDataFrame([("d", json.dumps({"title": "P", "children": [{"title": "A"}, {"title": "B", "children": [{"title": "C"}]}]}))], "doc string, tree string"))
    got = {r["title"]: (r["preorder"], r["parent_preorder"], r["ancestors"]) for r in rows.collect()}
    assert got == {"P": (0, -1, []), "A": (1, 0, ["P"]), "B": (2, 0, ["P"]), "C": (3, 2, ["P", "B"])}
    nodes = spark.createDataFrame([("d", k, x) for k, x in enumerate([0, 1, 1, 2, 0])], "doc string, idx int, depth int")
    assert [r["parent_idx"] for r in tree.parents_by_depth(nodes).orderBy("idx").collect()] == [None, 0, 0, 2, None]
    entries = spark.createDataFrame([("d", 0, "1", "A", 0, 9), ("d", 1, "1", "A", 3, 9), ("d", 2, "1", "A", 3, 9)], "doc string, idx int, label string, title string, page int, page_count int")
    assert [r["removed"] for r in tree.page_validity(entries).orderBy("idx").collect()] == ["page_out_of_range", None, "duplicate_entry"]
    sections = spark.createDataFrame([("d", 0, "a", 0, 1, 9), ("d", 1, "b", 1, 2, 4), ("d", 2, "b", 0, 5, 3)], "doc string, idx int, node_id string, depth int, start_page int, end_page int")
    assert {r["problem"] for r in tree.problems(sections).collect()} == {"duplicate_id", "range_reversed"}
    assert [r["node_id"] for r in tree.deepest_section(spark.createDataFrame([("d", 3)], "doc string, page int"), sections.where("idx < 2")).collect()] == ["b"]


def test_coverage(spark, monkeypatch):
    evidence = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, "alpha something wholly other"), (3, "beta gamma")], "evidence_id int, text string")
    parents = spark.createDataFrame([(10, "x ALPHA beta  gamma delta epsilon zeta eta y"), (11, "something wholly other here")], "parent_id int, text string")
    first = {r["evidence_id"]: r["parents"] for r in coverage.substring_coverage(evidence, parents).collect()}
    monkeypatch.setattr(coverage, "BROADCAST_ROWS", 0)
    assert first == {1: 1, 2: 0, 3: 1} == {r["evidence_id"]: r["parents"] for r in coverage.substring_coverage(evidence, parents).collect()}
    tiers = {r["evidence_id"]: r["tier"] for r in coverage.coverage_cascade(evidence, parents).collect()}
    assert tiers == {1: "substring", 2: "tokens", 3: "substring"}


def test_inventory(spark):
    blocks = spark.createDataFrame([("p", 0, "Known text", False), ("p", 1, "inside body", False), ("p", 2, "Table 1: scores", False), ("p", 3, "For all experiments, beam size was 4.", False), ("p", 4, "Ref one", True), ("p", 5, " ", False)], "doc string, content_index int, text string, in_references boolean")
    parents = spark.createDataFrame([("p", "Some inside  body here", [0])], "doc string, full_text string, block_ids array<int>")
    captions = spark.createDataFrame([("p", "table 1: scores of all")], "doc string, caption string")
    got = inventory.classify_blocks(blocks, parents, captions)
    assert [r["status"] for r in got.orderBy("content_index").collect()] == ["covered_by_block_id", "covered_by_content", "excluded_known_table_caption", "orphan_fallback", "excluded_reference_area", "excluded_empty_text"]
    assert inventory.coverage(got).first()["covered_ratio"] < 1


def test_policy(spark):
    schema = "k int, doc string, table_label string, candidate_id string, gold_label int, signals struct<exact_table_reference:boolean,table_text_overlap:array<string>,annotation_rationale_overlap:array<string>,evidence_family:string,evidence_family_match:boolean,condition_match:boolean,result_match:boolean>"
    rows = [(1, "d", "Table 1", "c", 0, (True, [], [], "method", False, False, False)), (2, "d", "Table 1", "c", 1, (False, [], [], "method", False, False, True))]
    scored = spark.createDataFrame(rows, schema).withColumn("score", scoring.policy_score(F.col("signals"), scoring.DEFAULT_WEIGHTS)).withColumn("selected", F.col("score") >= 0)
    m = policy.measured(policy.with_forced(scored, [], ["doc", "table_label", "candidate_id"], [F.col("k")]), []).first()
    assert (m["tp"], m["fp"], m["recall"]) == (1, 1, 1.0)
    best = policy.optimize(spark.createDataFrame(rows, schema), scoring.DEFAULT_WEIGHTS, policy.Guardrails(1), "k").first()
    assert (best["tp"], best["fp"], best["weight_set"], best["threshold"]) == (1, 0, 0, 100.0)
    assert len(policy.weight_sets(scoring.DEFAULT_WEIGHTS)) == 16
    assert one(spark, policy.bump_patch(F.lit("candidate-policy-1.0.9"))) == "candidate-policy-1.0.10"
    old = spark.createDataFrame([("m", "2024", "2024", 1)], "memory_id string, created_at_utc string, updated_at_utc string, v int")
    new = spark.createDataFrame([("m", "2025", "2025", 2)], old.schema)
    assert tuple(policy.upsert(old, new).first()) == ("m", "2024", "2025", 2)


def test_thresholds_are_counted_without_a_join(spark):
    r = random.Random(5)
    schema = "k int, doc string, table_label string, candidate_id string, gold_label int, signals struct<exact_table_reference:boolean,table_text_overlap:array<string>,annotation_rationale_overlap:array<string>,evidence_family:string,evidence_family_match:boolean,condition_match:boolean,result_match:boolean>"
    some = lambda n: ["w"] * r.randint(0, n)
    flag = lambda: r.choice([True, False, None])
    rows = [
        (k, r.choice("de"), r.choice(["1", "2", "3", None]), r.choice("abcd"), r.choice([0, 0, 1, None]), (r.choice([True, *[False] * 15, None]), some(7), some(6), r.choice(["result", "method"]), flag(), flag(), flag()))
        for k in range(120)
    ]
    df = spark.createDataFrame(rows, schema).cache()
    got = policy.optimize(df, scoring.DEFAULT_WEIGHTS, policy.Guardrails(1, 0.0, 0.0), "k")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    scored = policy.proposals(df, scoring.DEFAULT_WEIGHTS)
    cuts = scored.select("weight_set", F.explode(F.array("score", F.lit(0.0))).alias("threshold")).distinct()
    tried = scored.join(cuts, "weight_set").withColumn("selected", F.col("signals.exact_table_reference") | (F.col("score") >= F.col("threshold")))
    want = policy.measured(policy.with_forced(tried, ["weight_set", "threshold"], ["doc", "table_label", "candidate_id"], [F.col("k")]), ["weight_set", "threshold"])
    place = lambda x: (-x["precision"], x["selected"], -x["recall"], x["weight_set"], x["threshold"])
    assert [r.asDict() for r in got.collect()] == sorted((r.asDict() for r in want.collect()), key=place)


def test_review(spark):
    assert review.without_history(spark.createDataFrame([(1, 2, 3)], "child_id int, gold_label int, human_note int")).columns == ["child_id"]
    tables = spark.createDataFrame([("p", "T1"), ("p", "T3")], "paper_id string, table_id string")
    rel = spark.createDataFrame([("p", "C1", "P1", [("T1", 0, 1.0, "setup", "why")])], "paper_id string, child_id string, parent_id string, relevant_tables array<struct<table_id:string,label:int,confidence:double,evidence_role:string,rationale:string>>")
    got = {r["table_id"]: (r["relations"], r["child_ids"]) for r in review.table_summary(tables, review.relations(rel)).collect()}
    assert got == {"T1": (1, ["C1"]), "T3": (0, [])}


def test_pairwise(spark):
    facts = spark.createDataFrame([("s", "citekey evidence 1 (tab): first one citekey evidence 2: second")], "id string, facts string")
    assert [(r["number"], r["source"], r["segment"]) for r in pairwise.evidence_segments(facts, "id", "facts").orderBy("number").collect()] == [(1, "tab", "first one"), (2, "", "second")]
    assert one(spark, pairwise.tagged_section(F.lit("<Ground Truth> body </Ground Truth>"), "Ground Truth")) == "body"
    assert one(spark, pairwise.author_points(F.lit("Smith et al. (2020) 3.1"), F.lit("Smith et al., 2020"))) >= 4
    rows = spark.createDataFrame([("s", 0, 0.5), ("s", 1, 0.9), ("s", 2, 0.9)], "sample_id string, idx int, score double")
    assert [r["idx"] for r in pairwise.best_pairs(rows, 0.5).orderBy("review_rank").collect()] == [1, 2, 0]


def test_datasets(spark):
    assert one(spark, datasets.windows(F.sequence(F.lit(1), F.lit(7)), 3, 1)) == [[1, 2, 3], [3, 4, 5], [5, 6, 7]]
    assert sum(one(spark, datasets.softmax(F.array(F.lit(1.0), F.lit(3.0))))) == pytest.approx(1)
    rows = spark.createDataFrame([("g", k, k % 3 == 0) for k in range(6)], "g string, k int, good boolean")
    got = datasets.topk_with_refill(rows, "g", [F.col("k")], F.col("good"), 1, 3).orderBy("k").collect()
    assert [(r["k"], r["refill"]) for r in got] == [(0, False), (1, True), (3, False)] or len(got) == 3


def test_sources(spark, tmp_path):
    statuses = spark.createDataFrame([("d", "pass")], "doc string, status string")
    out = {"rows": spark.range(3)}
    assert io.publish(out, statuses, str(tmp_path)) and spark.read.json(f"{tmp_path}/rows").count() == 3
    assert not io.publish(out, statuses.withColumn("status", F.lit("fail")), str(tmp_path))
    assert spark.read.schema("id long").json(f"{tmp_path}/rows").count() == 0
    (tmp_path / "a_review.json").write_text('﻿[{"k": 1}, {"k": 2}]', encoding="utf-8")
    assert io.read_matching(spark, str(tmp_path), "*_review.json", "k int").count() == 2
    listing = spark.createDataFrame([("d", "txt", "p1"), ("d", "ocr", "p2"), ("d", "odd", "p0")], "doc string, mode string, path string")
    assert io.preferred_paths(listing).first()["path"] == "p2"
    chunks = spark.createDataFrame([("d", 1, 3, 0, 0), ("d", 0, 0, 0, 0)], "doc string, chunk int, start_page int, idx int, page_idx int")
    assert [(r["content_index"], r["page_idx"]) for r in io.merge_chunks(chunks).orderBy("content_index").collect()] == [(0, 0), (1, 3)]
    assert io.markdown(spark.createDataFrame([("g", 2, "b"), ("g", 1, "a")], "g string, k int, v string"), "g", ["k"], F.col("v")).first()["text"] == "# g\n\n- a\n- b"
    assert io.left_to_do(spark.range(3), spark.range(2), ["id"]).count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"child_id": "c", "at": "2024-01-01T00:00:00"}\n{"child_id": "c", "at": "2024-01-01T00:00:01"}\n')
    s = stream.decision_stream(spark, str(tmp_path / "in"), "child_id string, at timestamp")
    stream.ingest(stream.latest(s, "child_id", "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_context_windows_hold_whole_texts(spark, tmp_path):
    import hashlib

    import __spark_entry__ as entry

    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} of a conversation " + "and more " * k) for k in range(12)]
    changed = [(2, k, role, text + " end" if k == 5 else text) for _, k, role, text in turns]
    spark.createDataFrame(turns + changed, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["context_sha256"] for r in entry.queries()["block_context_window"](spark, str(tmp_path)).collect()}
    for rows in (turns, changed):
        for conv, k, _, _ in rows:
            near = "\n".join(f"{j}:{text}" for _, j, _, text in rows[max(0, k - 4) : k + 5])
            assert got[conv, k] == hashlib.sha256(near.encode()).hexdigest()
    assert [k for k in range(12) if got[1, k] != got[2, k]] == list(range(1, 10))
