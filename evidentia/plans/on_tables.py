"""Queries on the relational tables, labels, events and embeddings, and on literal inputs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import geometry, htmltable, jsonfix, mentions, scoring, text
from evidentia.operators import captions, datasets, inventory, matching, paragraphs, policy, review, training, tree
from evidentia.plans.on_text import t


def deepest_range_match(spark, sf_dir):
    """Orders to price bands that nest: the narrowest band over a price."""
    bands = [(0, "all", 0, 10_000_000, 0), (1, "low", 0, 150_000, 1), (2, "high", 150_000, 10_000_000, 1), (3, "mid", 100_000, 200_000, 2), (4, "core", 140_000, 160_000, 3)]
    sections = spark.createDataFrame([("o", n, d, a, b) for _, n, a, b, d in bands], "doc string, node_id string, depth int, start_page int, end_page int")
    pages = t(spark, sf_dir, "orders").groupBy(F.floor("o_totalprice").cast("int").alias("page")).agg(F.count("*").alias("n")).withColumn("doc", F.lit("o"))
    best = tree.deepest_section(pages, F.broadcast(sections))  # five bands
    return best.groupBy("node_id").agg(F.sum("n").alias("n_orders"))


DEEPEST = """WITH b(node_id, lo, hi, depth) AS (VALUES ('all', 0, 10000000, 0), ('low', 0, 150000, 1), ('high', 150000, 10000000, 1), ('mid', 100000, 200000, 2), ('core', 140000, 160000, 3)),
 o AS (SELECT row_number() OVER () AS k, CAST(floor(o_totalprice) AS INT) AS page FROM orders),
 r AS (SELECT k, node_id, row_number() OVER (PARTITION BY k ORDER BY hi - lo, depth DESC, node_id) AS n FROM o JOIN b ON page BETWEEN lo AND hi)
 SELECT node_id, count(*) AS n_orders FROM r WHERE n = 1 GROUP BY node_id"""


def asof_section(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id")).groupBy("user_id", "ts").agg(F.max("signup_id").alias("signup_id"))
    out = matching.nearest_preceding(e.where("event_type <> 'signup'").select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", "signup_id")
    return out.select("event_id", "user_id", "signup_id")


ASOF = """WITH s AS (SELECT user_id, ts, max(event_id) AS signup_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts)
 SELECT e.event_id, e.user_id, s.signup_id FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts"""


def fallback_lookup(spark, sf_dir):
    """Per nation the best-funded supplier's name, else the best customer's, else the region's."""
    s = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max_by("s_name", F.struct("s_acctbal", "s_name")).alias("supplier"))
    c = t(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.max_by("c_name", F.struct("c_acctbal", "c_name")).alias("customer"))
    n = t(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "k").join(t(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    joined = n.join(s, "k", "left").join(c, "k", "left")
    source = F.when(F.col("supplier").isNotNull(), "primary").when(F.col("customer").isNotNull(), "fallback").otherwise("default")
    return joined.select("n_name", F.coalesce("supplier", "customer", "r_name").alias("contact"), source.alias("source"))


FALLBACK = """WITH s AS (SELECT s_nationkey AS k, arg_max(s_name, (s_acctbal, s_name)) AS supplier FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, arg_max(c_name, (c_acctbal, c_name)) AS customer FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
 SELECT n_name, coalesce(supplier, customer, r_name) AS contact, CASE WHEN supplier IS NOT NULL THEN 'primary' WHEN customer IS NOT NULL THEN 'fallback' ELSE 'default' END AS source
 FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN s ON s.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey"""


def completeness_check(spark, sf_dir):
    return matching.completeness(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id").groupBy("problem").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id"))


COMPLETE = """WITH l AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), d AS (SELECT DISTINCT doc_id, true AS e FROM documents),
 j AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' END AS problem FROM d FULL JOIN l ON d.doc_id = l.doc_id)
 SELECT problem, count(*) AS n, min(doc_id) AS first_doc_id FROM j WHERE problem IS NOT NULL GROUP BY problem"""


def bbox_pair_audit(spark, sf_dir):
    """Boxes from line items: each against itself, moved a little by its discount and tax."""
    x, y = F.col("l_quantity") * 10, F.col("l_discount") * 1000
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    a = geometry.normal_box(F.array(x, y, x + 200, y + 100))
    b = geometry.normal_box(F.array(x + F.col("l_tax") * 500, y + F.col("l_tax") * 100, x + 200 + F.col("l_tax") * 500, y + 100))
    rated = lines.select("l_orderkey", geometry.iou(a, b).alias("iou"), geometry.largest_delta(a, b).alias("delta"))
    verdict = F.when(F.col("iou") < matching.MIN_IOU, "overlap_too_small").when(F.col("delta") > matching.MAX_DELTA, "difference_too_large").otherwise("eligible")
    return rated.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.round(F.sum("iou"), 3).alias("sum_iou"), F.round(F.max("delta"), 6).alias("max_delta"))


BBOX = """WITH b AS (SELECT l_quantity * 10 AS x, l_discount * 1000 AS y, l_tax * 500 AS dx, l_tax * 100 AS dy FROM lineitem),
 n AS (SELECT CASE WHEN greatest(abs(x), abs(y), abs(x + 200), abs(y + 100)) > 1.5 THEN 1000.0 ELSE 1.0 END AS s1, CASE WHEN greatest(abs(x + dx), abs(y + dy), abs(x + 200 + dx), abs(y + 100)) > 1.5 THEN 1000.0 ELSE 1.0 END AS s2, * FROM b),
 c AS (SELECT x / s1 AS a0, y / s1 AS a1, (x + 200) / s1 AS a2, (y + 100) / s1 AS a3, (x + dx) / s2 AS b0, (y + dy) / s2 AS b1, (x + 200 + dx) / s2 AS b2, (y + 100) / s2 AS b3 FROM n),
 i AS (SELECT *, greatest(0.0, least(a2, b2) - greatest(a0, b0)) * greatest(0.0, least(a3, b3) - greatest(a1, b1)) AS inter FROM c),
 r AS (SELECT inter / ((a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - inter) AS iou, greatest(abs(a0 - b0), abs(a1 - b1), abs(a2 - b2), abs(a3 - b3)) AS delta FROM i)
 SELECT CASE WHEN iou < 0.70 THEN 'overlap_too_small' WHEN delta > 0.03 THEN 'difference_too_large' ELSE 'eligible' END AS verdict, count(*) AS n, round(sum(iou), 3) AS sum_iou, round(max(delta), 6) AS max_delta FROM r GROUP BY 1"""

_ANCHORS = [("a", "Table 1", 4, [100, 300, 400, 500]), ("a", "Table 2", 9, [500, 300, 900, 500]), ("b", "Table 1", 1, [100, 100, 400, 200]), ("c", "Table 1", 1, [100, 100, 400, 200]), ("c", "Table 2", 1, [100, 100, 400, 200]), ("d", "Table 1", 4, [100, 100, 400, 200])]
_NODES = [("a", "n9", 9, [0.501, 0.3, 0.9, 0.5]), ("a", "n4", 4, [0.1, 0.301, 0.4, 0.5]), ("c", "n1", 1, [0.1, 0.1, 0.4, 0.2]), ("c", "n2", 1, [0.1, 0.1, 0.4, 0.2]), ("d", "n1", 5, [0.1, 0.1, 0.4, 0.2])]


def unique_matching(spark, sf_dir):
    anchors = spark.createDataFrame([(d, a, p, list(map(float, b))) for d, a, p, b in _ANCHORS], "doc string, anchor_id string, page_index int, bbox array<double>")
    nodes = spark.createDataFrame([(d, n, [(p, b)]) for d, n, p, b in _NODES], "doc string, node_id string, locations array<struct<page:int,bbox:array<double>>>")
    return matching.match_anchors(anchors, nodes)


MATCHING = """SELECT * FROM (VALUES ('a', 'pass', NULL, 'Table 1', 'n4'), ('a', 'pass', NULL, 'Table 2', 'n9'), ('b', 'fail', 'table_count_mismatch', NULL, NULL),
 ('c', 'fail', 'ambiguous_multiple_complete_matchings', NULL, NULL), ('d', 'fail', 'anchor_has_no_eligible_node', NULL, NULL)) v(doc, status, reason, anchor_id, node_id)"""

_MENTIONS = ["See Tables 1–3 and Tbl. S1.", "Table 2(a), 3 and 4 to 6", "no mention here", "table mixing", "Tab. 1 & 2; Tables 3-1"]


def table_mentions(spark, sf_dir):
    labels = [("t1", "Table 1"), ("t2", "Table 2"), ("t3", "Table 3"), ("ts1", "Table S1")]
    rows = spark.createDataFrame([(k, x, labels) for k, x in enumerate(_MENTIONS)], "k int, text string, tables array<struct<table_id:string,label:string>>")
    m = rows.select("k", F.posexplode(mentions.mentions("text", "tables")).alias("pos", "m"))
    return m.select("k", "pos", "m.char_start", "m.char_end", F.array_join("m.designators", ",").alias("written"), F.array_join("m.table_ids", ",").alias("table_ids"))


MENTIONS = """SELECT * FROM (VALUES (0, 0, 4, 14, '1,3', 't1,t2,t3'), (0, 1, 19, 26, 's1', 'ts1'), (1, 0, 0, 24, '2,3,4,6', 't2,t3'), (3, 0, 0, 10, 'mixi', ''),
 (4, 0, 0, 10, '1,2', 't1,t2'), (4, 1, 12, 22, '3,1', 't3,t1')) v(k, pos, char_start, char_end, written, table_ids)"""

_TABLE = "<table><thead><tr><th rowspan=2>Model</th><th colspan=2>BLEU</th></tr><tr><th>dev</th><th>test</th></tr></thead><tbody><tr><td>Base</td><td>1</td><td>2</td></tr><tr><td>large models</td><td></td><td></td></tr><tr><td rowspan=2>Big</td><td>3</td><td>4</td></tr><tr><td>5</td><td></td></tr></tbody></table>"


def html_grid(spark, sf_dir):
    rows = spark.createDataFrame([("x", _TABLE), ("y", "<table><tr><td>A</td><td>B</td></tr><tr><td>1</td><td>2</td></tr></table>"), ("z", None)], "table_id string, html string")
    return htmltable.table_rows(rows)


GRID = """SELECT * FROM (VALUES ('x', 1, NULL, 'Row 1 | Model: Base ; BLEU / dev: 1 ; BLEU / test: 2'), ('x', 2, 'large models', 'Row 2 | Section context: large models | Model: Big ; BLEU / dev: 3 ; BLEU / test: 4'),
 ('x', 3, 'large models', 'Row 3 | Section context: large models | Model: Big ; BLEU / dev: 5'), ('y', 1, NULL, 'Row 1 | A: 1 ; B: 2')) v(table_id, row, section, text)"""


def json_props(spark, sf_dir):
    parsed = F.try_parse_json("props")
    keys = F.array_sort(F.json_object_keys("props"))
    e = t(spark, sf_dir, "events").select(F.array_join(keys, ",").alias("keys"), parsed.isNull().alias("bad"))
    return e.groupBy("keys", "bad").agg(F.count("*").alias("n"))


JSON_PROPS = "SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys, try_cast(props AS JSON) IS NULL AS bad, count(*) AS n FROM events GROUP BY 1, 2"

_ANSWERS = ['ok {"a": {"b": "}"}} rest', "```json\n{'x': [1, 2]}\n```", '{"p": "C:\\temp"}', "no object", '{"a": 1']


def json_repair(spark, sf_dir):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(_ANSWERS)], "k int, answer string")
    return rows.select("k", jsonfix.repaired_json("answer").alias("json"))


JSON_REPAIR = r"""SELECT * FROM (VALUES (0, '{"a": {"b": "}"}}'), (1, '{"x": [1, 2]}'), (2, '{"p": "C:\temp"}'), (3, '{}'), (4, '{}')) v(k, json)"""


def _feedback(spark, sf_dir):
    """Labels as feedback (0 relevant) on documents as children; a source is a document, a language its table."""
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id")
    found = text.tokens(F.col("text"))
    shared = F.array_intersect(found, F.array(*map(F.lit, ("stupid", "idiot", "scum", "there", "thing", "erha", "this"))))
    signals = F.struct(
        F.col("text").contains("License").alias("exact_table_reference"), shared.alias("table_text_overlap"),
        F.slice(found, 1, F.pmod(F.col("doc_id"), F.lit(3)).cast("int")).alias("annotation_rationale_overlap"), F.lit("result").alias("evidence_family"),
        (F.col("n_chars") > 1500).alias("evidence_family_match"), (F.pmod("doc_id", F.lit(4)) == 0).alias("condition_match"), (F.col("quality") == 1).alias("result_match"),
    )
    return d.select("doc_id", F.col("source").alias("doc"), F.col("lang").alias("table_label"), F.pmod("doc_id", F.lit(50)).cast("string").alias("candidate_id"), (1 - F.col("toxic")).alias("gold_label"), signals.alias("signals"))


def policy_grid(spark, sf_dir):
    """Every weight set at two fixed thresholds, with forced choices."""
    scored = policy.proposals(_feedback(spark, sf_dir), scoring.DEFAULT_WEIGHTS)
    tried = scored.withColumn("threshold", F.explode(F.array(F.lit(20.0), F.lit(45.0)))).withColumn("selected", F.col("signals.exact_table_reference") | (F.col("score") >= F.col("threshold")))
    forced = policy.with_forced(tried, ["weight_set", "threshold"], ["doc", "table_label", "candidate_id"], [F.col("doc_id")])
    out = policy.measured(forced, ["weight_set", "threshold"])
    return out.select("weight_set", "threshold", "tp", "fp", "fn", "tn", "selected", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "table_coverage")])


def _policy_sql():
    from evidentia.plans.on_text import sql_tokens

    sets = ", ".join("(" + ", ".join([str(k), *(f"{w[n]}::DOUBLE" for n in policy.VARIED)]) + ")" for k, w in enumerate(policy.weight_sets(scoring.DEFAULT_WEIGHTS)))
    return f"""WITH w(weight_set, wt, wr, wf, wc, wres) AS (VALUES {sets}), th(threshold) AS (VALUES (20.0::DOUBLE), (45.0::DOUBLE)),
 d AS (SELECT doc_id, source, lang, CAST(doc_id % 50 AS VARCHAR) AS cand, 1 - toxic AS gold, quality, n_chars, contains(text, 'License') AS exact, {sql_tokens('text')} AS tk FROM documents JOIN labels USING (doc_id)),
 f AS (SELECT *, len(list_intersect(tk, ['stupid', 'idiot', 'scum', 'there', 'thing', 'erha', 'this'])) AS n1, least(len(tk), doc_id % 3) AS n2 FROM d),
 s AS (SELECT f.*, weight_set, threshold, round(CASE WHEN exact THEN 100 ELSE 0 END + least(30.0, n1 * wt) + least(25.0, n2 * wr) + CASE WHEN n_chars > 1500 THEN wf ELSE 0 END
  + CASE WHEN doc_id % 4 = 0 THEN wc ELSE 0 END + CASE WHEN quality = 1 THEN wres ELSE 0 END, 6) AS score FROM f, w, th),
 c AS (SELECT *, exact OR score >= threshold AS sel FROM s),
 g AS (SELECT *, sel OR (NOT bool_or(sel) OVER p AND row_number() OVER (PARTITION BY weight_set, threshold, source, lang, cand ORDER BY score DESC, doc_id) = 1) AS chosen FROM c WINDOW p AS (PARTITION BY weight_set, threshold, source, lang, cand)),
 m AS (SELECT weight_set, threshold, count(*) FILTER (gold = 0 AND chosen) AS tp, count(*) FILTER (gold <> 0 AND chosen) AS fp, count(*) FILTER (gold = 0 AND NOT chosen) AS fn, count(*) FILTER (gold <> 0 AND NOT chosen) AS tn,
  count(DISTINCT CASE WHEN gold = 0 AND chosen THEN source || '|' || lang END) AS cov, count(DISTINCT CASE WHEN gold = 0 THEN source || '|' || lang END) AS tabs FROM g GROUP BY 1, 2)
 SELECT weight_set, threshold, tp, fp, fn, tn, tp + fp AS selected, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN tabs > 0 THEN cov / tabs ELSE 0.0 END, 6) AS table_coverage FROM m"""


def policy_best(spark, sf_dir):
    best = policy.optimize(_feedback(spark, sf_dir), scoring.DEFAULT_WEIGHTS, policy.Guardrails(30, 0.9, 0.9), "doc_id").limit(1)
    return best.select("weight_set", "threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "table_coverage")])


_LINE_ORDER = ["l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"]


def child_topk_refill(spark, sf_dir):
    """Up to three discounted lines per order, refilled from the others up to two."""
    order = [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber"]
    out = datasets.topk_with_refill(t(spark, sf_dir, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), *map(F.col, order[1:])], F.col("l_discount") >= 0.05, 3, 2)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "refill", "rank")


REFILL = """WITH o AS (SELECT *, l_discount >= 0.05 AS good, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount >= 0.05 DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS r,
 count(*) FILTER (l_discount >= 0.05) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
 SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, NOT good AS refill, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rank FROM o WHERE r <= greatest(least(3, n), 2)"""


def cap_sensitivity(spark, sf_dir):
    """Lines kept and orders cut for caps of two to six: one pass over counts, not one per cap."""
    n = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("orders"))
    caps = n.withColumn("cap", F.explode(F.sequence(F.lit(2), F.lit(6))))
    return caps.groupBy("cap").agg(F.sum(F.least("n", "cap") * F.col("orders")).alias("kept"), F.sum(F.when(F.col("n") > F.col("cap"), F.col("orders")).otherwise(0)).alias("cut_orders"))


CAPS = """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), c(cap) AS (VALUES (2), (3), (4), (5), (6))
 SELECT cap, CAST(sum(least(n, cap)) AS BIGINT) AS kept, count(*) FILTER (n > cap) AS cut_orders FROM n, c GROUP BY cap"""


def folds(spark, sf_dir):
    rows = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return datasets.folds(datasets.majority(rows, "source", "quality", "doc_id")).select("article", "size", "label", "fold")


_FOLDS = """j AS (SELECT l.doc_id, l.quality, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id), c AS (SELECT source, quality, count(*) AS n, min(doc_id) AS seen FROM j GROUP BY 1, 2),
 m AS (SELECT source AS article, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS size, quality AS label, min(seen) OVER (PARTITION BY source) AS first, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS k FROM c),
 f AS (SELECT article, size, label, (row_number() OVER (PARTITION BY label ORDER BY size DESC, first) - 1) % 5 AS fold FROM m WHERE k = 1)"""
FOLDS = f"WITH {_FOLDS} SELECT article, size, label, fold FROM f"


def fold_stats(spark, sf_dir):
    rows = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("article")), "doc_id")
    by_fold = rows.join(folds(spark, sf_dir).select("article", "fold"), "article").groupBy("fold").agg(F.count("*").alias("validation"), F.sum("quality").alias("positive"))
    everything = Window.partitionBy(F.lit(1))  # five rows at most
    return by_fold.select("fold", "validation", (F.sum("validation").over(everything) - F.col("validation")).alias("training"), F.round(F.col("positive") / F.col("validation"), 6).alias("positive_share"))


FOLD_STATS = f"""WITH {_FOLDS}, v AS (SELECT fold, count(*) AS validation, sum(quality) AS p FROM j JOIN f ON j.source = f.article GROUP BY fold)
 SELECT fold, validation, CAST(sum(validation) OVER () - validation AS BIGINT) AS training, round(p / validation, 6) AS positive_share FROM v"""


def class_metrics(spark, sf_dir):
    out = datasets.class_metrics(t(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


CLASS_METRICS = """WITH k(label) AS (VALUES (0), (1)), c AS (SELECT label, count(*) FILTER (quality = label AND toxic = label) AS hit, count(*) FILTER (toxic = label) AS guessed, count(*) FILTER (quality = label) AS support FROM labels, k GROUP BY label),
 r AS (SELECT label, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS r, support FROM c)
 SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, support FROM r"""


def macro_metrics(spark, sf_dir):
    out = datasets.class_metrics(t(spark, sf_dir, "labels"), "quality", "toxic")
    macro = out.agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("f1"), 6).alias("f1"))
    right = t(spark, sf_dir, "labels").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("double")), 6).alias("accuracy"))
    return macro.join(right, macro["precision"].isNotNull() | macro["precision"].isNull())  # one row each


MACRO = """WITH k(label) AS (VALUES (0), (1)), c AS (SELECT label, count(*) FILTER (quality = label AND toxic = label) AS hit, count(*) FILTER (toxic = label) AS guessed, count(*) FILTER (quality = label) AS support FROM labels, k GROUP BY label),
 r AS (SELECT label, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS r FROM c)
 SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS f1, (SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) FROM labels) AS accuracy FROM r"""


def class_weights(spark, sf_dir):
    counts = t(spark, sf_dir, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per class
    return counts.select("label", "n", F.round(datasets.class_weight(F.col("n"), total), 6).alias("weight"))


CLASS_WEIGHTS = "WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1) SELECT label, n, round(sum(n) OVER () / (2 * n), 6) AS weight FROM c"


def label_distribution(spark, sf_dir):
    j = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return j.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 4).alias("mean"))


DISTRIBUTION = "SELECT lang, toxic, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY lang, toxic"


def group_softmax(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("label", datasets.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    out = datasets.group_scores(e, "label", F.get("p", F.lit(1)))
    return out.select("label", F.round("mean_p1", 6).alias("mean_p1"), F.round("max_p1", 6).alias("max_p1"), F.round("min_p1", 6).alias("min_p1"), "chunks", "label_mean")


SOFTMAX = """WITH m AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings), p AS (SELECT label, exp(e[2] - top) / list_sum(list_transform(e, lambda x: exp(x - top))) AS p1 FROM m)
 SELECT label, round(avg(p1), 6) AS mean_p1, round(max(p1), 6) AS max_p1, round(min(p1), 6) AS min_p1, count(*) AS chunks, CAST(avg(p1) >= 0.5 AS INT) AS label_mean FROM p GROUP BY label"""


def memory_by_type(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("last_ts"))


BY_TYPE = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS last_ts FROM events GROUP BY event_type"


def memory_upsert(spark, sf_dir):
    """Events as versions of a memory item per user and type: the newest value, the first time."""
    e = t(spark, sf_dir, "events").groupBy("user_id", "event_type", "ts").agg(F.max("value").alias("value"))
    items = e.select(text.memory_id(F.col("user_id").cast("string"), F.col("event_type")).alias("memory_id"), F.col("ts").alias("created_at_utc"), F.col("ts").alias("updated_at_utc"), "value")
    half = F.col("updated_at_utc") < F.lit("2024-01-15").cast("timestamp")
    return policy.upsert(items.where(half), items.where(~half))


UPSERT = """WITH e AS (SELECT user_id, event_type, ts, max(value) AS value FROM events GROUP BY 1, 2, 3), i AS (SELECT substr(sha256(CAST(user_id AS VARCHAR) || chr(10) || event_type), 1, 20) AS memory_id, ts, value FROM e),
 r AS (SELECT memory_id, min(ts) OVER (PARTITION BY memory_id) AS created_at_utc, ts AS updated_at_utc, value, row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC) AS k FROM i)
 SELECT memory_id, created_at_utc, updated_at_utc, value FROM r WHERE k = 1"""


def summary_rollup(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    late = F.count(F.when(F.col("o_orderstatus") == "F", True))
    return o.rollup("o_orderpriority").agg(F.count("*").alias("orders"), late.alias("done"), F.round(late / F.count("*"), 4).alias("done_ratio"), F.round(F.sum("o_totalprice"), 2).alias("total"))


ROLLUP = "SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS done, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS done_ratio, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)"


def zero_relation_tables(spark, sf_dir):
    """Parts as tables with their strong relations; parts without any stay."""
    parts = t(spark, sf_dir, "part").select(F.lit("p").alias("paper_id"), F.col("p_partkey").alias("table_id"))
    accepted = t(spark, sf_dir, "lineitem").where("l_quantity >= 48 AND l_discount >= 0.08").select(F.lit("p").alias("paper_id"), F.col("l_partkey").alias("table_id"), F.col("l_orderkey").cast("string").alias("child_id"))
    out = review.table_summary(parts, accepted)
    return out.groupBy("relations").agg(F.count("*").alias("n_tables"), F.min("table_id").alias("first_table"))


ZERO = """WITH a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity >= 48 AND l_discount >= 0.08 GROUP BY 1)
 SELECT coalesce(n, 0) AS relations, count(*) AS n_tables, min(p_partkey) AS first_table FROM part LEFT JOIN a ON p_partkey = l_partkey GROUP BY 1"""


def package_nesting(spark, sf_dir):
    items = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("paper_id"), F.col("l_orderkey").alias("parent_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("child_id"))
    nested = review.packages(items.withColumn("char_start", F.lit(0)).withColumn("char_end", F.lit(0)).withColumn("text", F.lit("")))
    line = lambda p: F.concat_ws("=", p["parent_id"].cast("string"), F.array_join(F.transform(p["children"], lambda c: c["child_id"]), ","))
    return nested.select("paper_id", F.size("parents").cast("long").alias("parents"), F.sha2(F.array_join(F.transform("parents", line), ";"), 256).alias("nested_sha256"))


NESTING = """WITH i AS (SELECT l_orderkey % 100 AS paper_id, l_orderkey AS parent_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS child_id FROM lineitem),
 c AS (SELECT paper_id, parent_id, string_agg(child_id, ',' ORDER BY child_id) AS children FROM i GROUP BY 1, 2)
 SELECT paper_id, count(*) AS parents, sha256(string_agg(parent_id || '=' || children, ';' ORDER BY parent_id)) AS nested_sha256 FROM c GROUP BY paper_id"""


def validation_failures(spark, sf_dir):
    c = F.col
    failed = review.failed_rules({"quantity_range": ~c("l_quantity").between(2, 49), "discount_high": c("l_discount") > 0.09, "tax_zero": c("l_tax") == 0, "flag_status": (c("l_returnflag") == "N") & (c("l_linestatus") == "F")})
    return t(spark, sf_dir, "lineitem").select(F.explode(failed).alias("failure"), "l_orderkey").groupBy("failure").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


FAILURES = """WITH f AS (SELECT l_orderkey, unnest([CASE WHEN NOT l_quantity BETWEEN 2 AND 49 THEN 'quantity_range' END, CASE WHEN l_discount > 0.09 THEN 'discount_high' END, CASE WHEN l_tax = 0 THEN 'tax_zero' END,
 CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'flag_status' END]) AS failure FROM lineitem) SELECT failure, count(*) AS n, min(l_orderkey) AS first_order FROM f WHERE failure IS NOT NULL GROUP BY failure"""


def normalize_scores(spark, sf_dir):
    raw = F.when(F.pmod("event_id", F.lit(7)) == 0, "n/a").when(F.pmod("event_id", F.lit(7)) == 1, "-0.5").otherwise((F.col("value") / 100).cast("string"))
    e = t(spark, sf_dir, "events").select(text.clamp_score(raw).alias("score"), text.as_bool(F.when(F.pmod("event_id", F.lit(2)) == 0, " True ").otherwise("no")).alias("yes"))
    return e.groupBy("yes").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.round(F.sum("score"), 4).alias("total"), F.count(F.when(F.col("score") > 0.5, True)).alias("matched"))


NORMALIZE = """WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 7 = 1 THEN '-0.5' ELSE CAST(value / 100 AS VARCHAR) END AS raw, event_id % 2 = 0 AS yes FROM events),
 s AS (SELECT yes, greatest(0.0, least(1.0, try_cast(raw AS DOUBLE))) AS c, try_cast(raw AS DOUBLE) IS NULL AS bad FROM r), v AS (SELECT yes, CASE WHEN bad THEN NULL ELSE c END AS score FROM s)
 SELECT yes, count(*) AS n, count(score) AS scored, round(sum(score), 4) AS total, count(*) FILTER (score > 0.5) AS matched FROM v GROUP BY yes"""


def split_disjointness(spark, sf_dir):
    """Documents in both parts of a split: every 97th is put in both on purpose."""
    d = t(spark, sf_dir, "documents").select("doc_id")
    return training.overlap(d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0 OR doc_id % 97 = 0"), "doc_id")


def parent_scores(spark, sf_dir):
    """Line items as paragraphs of their order: every rule of the priority score, and tiers."""
    c = F.col
    rules = (c("l_discount") >= 0.09, c("l_returnflag") == "R", F.pmod("l_partkey", F.lit(5)).cast("int"), F.pmod("l_suppkey", F.lit(20)).cast("int"), c("l_linestatus") == "O", c("l_tax") > 0.04, F.pmod("l_orderkey", F.lit(9)).cast("int"))
    rated = t(spark, sf_dir, "lineitem").select(scoring.parent_score(*rules).alias("score"), scoring.parent_tier(*rules).alias("tier"))
    return rated.groupBy("tier").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"))


PARENT_SCORES = """WITH r AS (SELECT l_discount >= 0.09 AS ref, l_returnflag = 'R' AS sec, l_partkey % 5 AS pg, l_suppkey % 20 AS bl, l_linestatus = 'O' AS st, l_tax > 0.04 AS co, l_orderkey % 9 AS ov FROM lineitem),
 s AS (SELECT *, CASE WHEN ref THEN 100.0 ELSE 0 END + CASE WHEN sec THEN 40.0 ELSE 0 END + CASE pg WHEN 0 THEN 35.0 WHEN 1 THEN 25.0 WHEN 2 THEN 15.0 ELSE 0 END + CASE WHEN bl <= 8 THEN 20.0 ELSE 0 END
  + CASE WHEN st THEN 20.0 ELSE 0 END + CASE WHEN co THEN 10.0 ELSE 0 END + least(30.0, ov * 5.0) AS score,
  CASE WHEN ref THEN 'tier_1_explicit_reference' WHEN sec OR pg <= 1 OR bl <= 8 THEN 'tier_2_local_context' WHEN st OR co OR ov > 0 THEN 'tier_3_experiment_condition' ELSE 'tier_4_background' END AS tier FROM r)
 SELECT tier, count(*) AS n, CAST(sum(score) AS DOUBLE) AS total, CAST(max(score) AS DOUBLE) AS best FROM s GROUP BY tier"""


def child_scores(spark, sf_dir):
    """Child scores of literal sentences against a table."""
    rows = spark.createDataFrame([(0, "Table 3 shows that accuracy improves.", "Table 3"), (1, "See tab. 3 for the corpus.", "Table 3"), (2, "Nothing.", "Table 3"), (3, "Table 33 is another.", "Table 3")], "k int, text string, label string")
    overlap = F.size(F.array_intersect(text.tokens(F.col("text")), text.tokens(F.lit("Accuracy of models on the corpus"))))
    return rows.select("k", scoring.child_score(F.col("text"), text.table_reference(F.col("text"), F.col("label")), overlap).alias("score"), F.array_join(text.family_hits(F.col("text")), ",").alias("families"))


CHILD_SCORES = """SELECT * FROM (VALUES (0, CAST(151.0 AS DOUBLE), 'metric,result'), (1, CAST(128.0 AS DOUBLE), 'dataset'), (2, CAST(0.0 AS DOUBLE), ''), (3, CAST(0.0 AS DOUBLE), '')) v(k, score, families)"""


def suggestion_scores(spark, sf_dir):
    kids = [("p", "c1", "Tables 1 and 2 use the test set.", ["paper", "experiments"], [1], [11]), ("p", "c2", "Beam size was 4.", ["paper", "other"], [5], [80])]
    tables = [("p", "t1", "Table 1", ["paper", "experiments"], [1], [21], ["test", "beam"]), ("p", "t2", "Table 2", ["paper", "results"], [3], [22], ["size"])]
    a = spark.createDataFrame(kids, "doc string, child_id string, text string, section_path array<string>, pages array<int>, block_ids array<int>")
    b = spark.createDataFrame(tables, "doc string, table_id string, label string, section_path array<string>, pages array<int>, block_ids array<int>, tokens array<string>")
    out = inventory.suggestions(a, b)
    return out.select("child_id", "table_id", "ordering_score", F.array_join(F.array_sort(F.map_keys("score_components")), ",").alias("channels"))


SUGGESTIONS = """SELECT * FROM (VALUES ('c1', 't1', CAST(1355.0 AS DOUBLE), 'condition_hints,nearby_page,nearby_reading_order,same_section,structured_table_reference,table_text_lexical_overlap'),
 ('c1', 't2', CAST(1060.0 AS DOUBLE), 'condition_hints,nearby_page,nearby_reading_order,structured_table_reference'), ('c2', 't1', CAST(15.0 AS DOUBLE), 'condition_hints,table_text_lexical_overlap'),
 ('c2', 't2', CAST(45.0 AS DOUBLE), 'condition_hints,nearby_page,table_text_lexical_overlap')) v(child_id, table_id, ordering_score, channels)"""


def caption_choice(spark, sf_dir):
    tables = spark.createDataFrame([("d", "t1", 2, 10, [100.0, 300.0, 400.0, 500.0], "Table 1")], "doc string, table_id string, page int, idx int, bbox array<double>, label string")
    rows = [("d", 10, 2, [100.0, 300.0, 400.0, 500.0], "Table 1", "own_table_caption", True, 0), ("d", 9, 2, [100.0, 250.0, 400.0, 290.0], "Table 2", "text", True, 0), ("d", 14, 3, None, "table 1", "text", False, 60), ("d", 40, 4, None, "Table 1", "text", True, 0)]
    texts = spark.createDataFrame(rows, "doc string, idx int, page int, bbox array<double>, label string, kind string, caption_like boolean, label_start int")
    return captions.resolve(captions.candidates(tables, texts)).select("table_id", "idx", F.round("score", 3).alias("score"), "rank", "competing", "confidence")


CAPTIONS = """SELECT * FROM (VALUES ('t1', 10, CAST(132.0 AS DOUBLE), 1, false, 'high'), ('t1', 9, CAST(89.5 AS DOUBLE), 2, false, 'medium'), ('t1', 14, CAST(2.0 AS DOUBLE), 3, false, 'low')) v(table_id, idx, score, rank, competing, confidence)"""


def decision_rules(spark, sf_dir):
    items = spark.createDataFrame([("p", "C1", "P1"), ("p", "C2", "P1"), ("p", "C3", "P1")], "paper_id string, child_id string, parent_id string")
    tables = spark.createDataFrame([("p", "T1"), ("p", "T2")], "paper_id string, table_id string")
    rel = "array<struct<table_id:string,label:int,confidence:double,evidence_role:string,rationale:string>>"
    rows = [("p", "C1", "P1", [("T1", 0, 1.0, "setup", "r"), ("T9", 0, 1.01, "setup", "r")], None), ("p", "C2", "P2", [], "Pure pointer."), ("p", "C2", "P2", [], ""), ("p", "C8", "P1", [], "x")]
    decisions = spark.createDataFrame(rows, f"paper_id string, child_id string, parent_id string, relevant_tables {rel}, rejection_reason string")
    return review.validate_decisions(items, tables, decisions).groupBy("child_id", "failure").agg(F.count("*").alias("n"))


DECISIONS = """SELECT * FROM (VALUES ('C1', 'unknown_table', 1), ('C1', 'confidence_out_of_range', 1), ('C2', 'duplicate_decision', 1), ('C2', 'parent_mismatch', 2), ('C2', 'rejection_reason_missing', 1), ('C3', 'missing_decision', 1), ('C8', 'unknown_child', 1)) v(child_id, failure, n)"""

_TREE = '{"title": "Paper", "type": "root", "children": [{"title": "1 Intro", "type": "text", "content": "a", "children": []}, {"title": "2 Method", "type": "text", "children": [{"title": "2.1 Data", "type": "table"}]}]}'


def tree_flatten(spark, sf_dir):
    rows = spark.createDataFrame([("d", _TREE), ("e", None)], "doc string, tree string")
    return tree.flatten(rows).select("doc", "preorder", "parent_preorder", "depth", "title", F.array_join("ancestors", ">").alias("ancestors"))


TREE = """SELECT * FROM (VALUES ('d', 0, -1, 0, 'Paper', ''), ('d', 1, 0, 1, '1 Intro', 'Paper'), ('d', 2, 0, 1, '2 Method', 'Paper'), ('d', 3, 2, 2, '2.1 Data', 'Paper>2 Method')) v(doc, preorder, parent_preorder, depth, title, ancestors)"""


def layout_paragraphs(spark, sf_dir):
    rows = [("d", 0, "text", "We train on", 1, [100, 600, 480, 690], "s1"), ("d", 1, "table", "", 1, [100, 700, 480, 800], "s1"), ("d", 2, "text", "the full set.", 1, [100, 700, 480, 730], "s1"),
            ("d", 3, "text", "Next one:", 1, [100, 760, 480, 790], "s1"), ("d", 4, "heading", "2 Results", 1, [100, 800, 480, 820], "s1"), ("d", 5, "text", "which continues", 2, [100, 100, 480, 130], "s2")]
    blocks = spark.createDataFrame([(*r[:5], list(map(float, r[5])), r[6]) for r in rows], "doc string, content_index int, kind string, text string, page_index int, bbox array<double>, section string")
    out = paragraphs.merge_paragraphs(blocks)
    return out.select("text", F.array_join(F.transform("content_indexes", lambda x: x.cast("string")), ",").alias("blocks"), "page_start", "page_end")


LAYOUT = """SELECT * FROM (VALUES ('We train on the full set.', '0,2', 1, 1), ('Next one:', '3', 1, 1), ('which continues', '5', 2, 2)) v(text, blocks, page_start, page_end)"""

QUERIES = {f.__name__: f for f in (
    deepest_range_match, asof_section, fallback_lookup, completeness_check, bbox_pair_audit, unique_matching, table_mentions, html_grid, json_props, json_repair,
    policy_grid, policy_best, child_topk_refill, cap_sensitivity, folds, fold_stats, class_metrics, macro_metrics, class_weights, label_distribution, group_softmax, memory_by_type,
    memory_upsert, summary_rollup, zero_relation_tables, package_nesting, validation_failures, normalize_scores, split_disjointness, parent_scores, child_scores,
    suggestion_scores, caption_choice, decision_rules, tree_flatten, layout_paragraphs,
)}
SQL = {
    "deepest_range_match": DEEPEST, "asof_section": ASOF, "fallback_lookup": FALLBACK, "completeness_check": COMPLETE, "bbox_pair_audit": BBOX, "unique_matching": MATCHING,
    "table_mentions": MENTIONS, "html_grid": GRID, "json_props": JSON_PROPS, "json_repair": JSON_REPAIR, "policy_grid": _policy_sql(), "child_topk_refill": REFILL, "cap_sensitivity": CAPS,
    "folds": FOLDS, "fold_stats": FOLD_STATS, "class_metrics": CLASS_METRICS, "macro_metrics": MACRO, "class_weights": CLASS_WEIGHTS, "label_distribution": DISTRIBUTION,
    "group_softmax": SOFTMAX, "memory_by_type": BY_TYPE, "memory_upsert": UPSERT, "summary_rollup": ROLLUP, "zero_relation_tables": ZERO, "package_nesting": NESTING,
    "validation_failures": FAILURES, "normalize_scores": NORMALIZE, "split_disjointness": "SELECT DISTINCT doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 97 = 0", "parent_scores": PARENT_SCORES,
    "child_scores": CHILD_SCORES, "suggestion_scores": SUGGESTIONS, "caption_choice": CAPTIONS, "decision_rules": DECISIONS, "tree_flatten": TREE, "layout_paragraphs": LAYOUT,
}
