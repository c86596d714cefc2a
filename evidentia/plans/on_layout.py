"""Queries of layout and candidate operators over the driver's tables, which stand in for documents, with their SQL.

Orders are documents and their lines are blocks: odd lines are sections (a page each), even ones leaves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import candidates, labels, leaves, normalize
from evidentia.plans.on_text import t

c = F.col


def _lines(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc"), c("l_linenumber").cast("long").alias("idx"), "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_extendedprice")


def _unique_lines(spark, sf_dir):
    """One line of each number in an order: that of the least part. The lines of an order lie together for what follows."""
    return _lines(spark, sf_dir).repartition("doc").groupBy("doc", "idx").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_extendedprice")).alias("x")).select("doc", "idx", "x.*")


_LINES = """u AS (SELECT doc, idx, x.l_partkey AS l_partkey, x.l_suppkey AS l_suppkey, x.l_quantity AS l_quantity, x.l_tax AS l_tax, x.l_extendedprice AS l_extendedprice FROM (
 SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS idx, min({'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_quantity': l_quantity, 'l_tax': l_tax, 'l_extendedprice': l_extendedprice}) AS x FROM lineitem GROUP BY 1, 2))"""


def _sections(lines):
    own = lines.where("idx % 2 = 1").select("doc", "idx", (c("l_partkey") % 3).cast("long").alias("depth"), c("idx").alias("start_page"), F.lit(7).cast("long").alias("page_count"), (c("l_tax") > 0.07).alias("outline_only"))
    return leaves.draft_ranges(own).withColumn("node_id", c("idx"))


_SECTIONS = f"""{_LINES}, e AS (SELECT doc, idx, CAST(l_partkey % 3 AS BIGINT) AS depth, l_tax > 0.07 AS outline_only FROM u WHERE idx % 2 = 1),
 s AS (SELECT a.doc, a.idx, a.depth, a.outline_only, greatest(a.idx, coalesce(min(b.idx), 7)) AS end_page FROM e a LEFT JOIN e b ON a.doc = b.doc AND b.idx > a.idx AND b.depth <= a.depth GROUP BY a.doc, a.idx, a.depth, a.outline_only)"""


def draft_ranges(spark, sf_dir):
    return _sections(_unique_lines(spark, sf_dir)).select("doc", "idx", "depth", "end_page")


def _leaf_rows(lines):
    return lines.where("idx % 2 = 0").select(
        "doc", c("idx").alias("content_index"), (c("idx") + c("l_suppkey") % 2 * 6).alias("page"), F.when(c("l_partkey") % 2 == 0, "table").otherwise("text").alias("kind"),
        F.concat(F.lit("Table "), c("idx").cast("string")).alias("label"), c("l_suppkey"), c("l_quantity"),
    )


def _attached(spark, sf_dir):
    lines = _unique_lines(spark, sf_dir)
    rows = _leaf_rows(lines)
    asked = rows.where("l_suppkey % 5 < 2").select("doc", "label", F.when(c("l_suppkey") % 5 == 0, 1).otherwise(99).cast("long").alias("node_id"))
    return leaves.attach(rows, _sections(lines), asked)


_ATTACHED = f"""{_SECTIONS}, f AS (SELECT doc, idx AS content_index, idx + l_suppkey % 2 * 6 AS page, l_partkey % 2 = 0 AS is_table, l_suppkey, l_quantity FROM u WHERE idx % 2 = 0),
 o AS (SELECT f.doc, f.content_index, arg_max({{'n': s.idx, 'o': s.outline_only}}, (s.depth, s.idx - s.end_page, s.idx)) AS best FROM f JOIN s ON f.doc = s.doc AND f.page BETWEEN s.idx AND s.end_page GROUP BY 1, 2),
 z AS (SELECT doc, max(idx) AS last_id, bool_or(idx = 1) AS has_one FROM s GROUP BY doc),
 q AS (SELECT f.*, o.best.n AS page_id, o.best.o AS outline, z.last_id, coalesce(is_table AND l_suppkey % 5 = 0 AND has_one, false) AS own, l_suppkey % 5 < 2 AS asked FROM f LEFT JOIN o ON o.doc = f.doc AND o.content_index = f.content_index LEFT JOIN z ON z.doc = f.doc),
 a AS (SELECT doc, content_index, page, is_table, l_quantity, CASE WHEN NOT is_table THEN page_id WHEN own THEN 1 ELSE coalesce(page_id, last_id) END AS parent_node_id,
 CASE WHEN NOT is_table THEN 'page_range_deepest_match' WHEN own THEN 'manifest_override' WHEN page_id IS NOT NULL AND asked THEN 'page_range_deepest_match_after_missing_override' WHEN page_id IS NOT NULL THEN 'page_range_deepest_match' ELSE 'fallback_last_node' END AS assignment_reason
 FROM q WHERE is_table OR NOT coalesce(outline, false))"""


def attach_leaves(spark, sf_dir):
    return _attached(spark, sf_dir).select("doc", "content_index", "parent_node_id", "assignment_reason")


def sibling_order(spark, sf_dir):
    own = _attached(spark, sf_dir).select("doc", "parent_node_id", "page", c("l_quantity").cast("double").alias("y"), c("kind").alias("node_type"), c("content_index").alias("node_id"))
    return leaves.child_order(own).select("doc", "parent_node_id", "node_id", "place")


def descendant_counts(spark, sf_dir):
    """Customers below each region and nation."""
    tree = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    key = lambda kind, col: F.concat(F.lit(kind), c(col).cast("string"))
    nodes = tree.select(F.lit("world").alias("doc"), F.lit("customer").alias("node_type"), F.array(key("r", "n_regionkey"), key("n", "n_nationkey")).alias("path"))
    return leaves.descendant_counts(nodes).select("node_id", "n")


DESCENDANTS = """SELECT 'r' || n_regionkey AS node_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
 UNION ALL SELECT 'n' || n_nationkey, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""


def page_texts(spark, sf_dir):
    """Conversations as documents of two turns a page."""
    blocks = t(spark, sf_dir, "conversations").select(c("conv_id").alias("doc"), c("turn").alias("content_index"), F.floor(c("turn") / 2).cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return leaves.page_texts(blocks).select("doc", "page", "first_index", F.sha2("page_text", 256).alias("page_sha256"))


PAGE_TEXTS = """SELECT conv_id AS doc, turn // 2 AS page, min(turn) AS first_index, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS page_sha256 FROM conversations WHERE trim(text, ' ') <> '' GROUP BY 1, 2"""


def page_start_flags(spark, sf_dir):
    """Whether an item's first three words stand early in the text of the page of the same number."""
    pages = t(spark, sf_dir, "documents").select(F.lit("d").alias("doc"), c("doc_id").alias("page"), F.lit(0).alias("first_index"), c("text").alias("page_text"))
    entries = t(spark, sf_dir, "documents").select(F.lit("d").alias("doc"), c("doc_id").alias("start_page"), F.substring_index("text", " ", 3).alias("title"), F.lit("1").alias("label"), (c("doc_id") % 4).alias("content_index"))
    shifted = entries.withColumn("title", F.when(c("start_page") % 2 == 0, c("title")).otherwise("not there"))
    return leaves.page_start_flags(shifted, pages).select("start_page", "at_page_start")


PAGE_START = """SELECT doc_id AS start_page, coalesce(doc_id % 4 <= 1 OR contains(lower(substr(text, 1, 700)), CASE WHEN doc_id % 2 = 0 THEN lower(array_to_string(string_split(text, ' ')[1:3], ' ')) ELSE 'not there' END)
 OR contains(lower(substr(text, 1, 700)), '1 ' || CASE WHEN doc_id % 2 = 0 THEN lower(array_to_string(string_split(text, ' ')[1:3], ' ')) ELSE 'not there' END), false) AS at_page_start FROM documents"""


def candidate_pairs(spark, sf_dir):
    lines = _unique_lines(spark, sf_dir)
    tables = lines.where("idx % 2 = 1").select("doc", c("idx").alias("table_id"), c("l_quantity").alias("q"))
    parents = lines.where("idx % 2 = 0").select("doc", c("idx").alias("parent_id"), (c("l_partkey") % 4).alias("page"), c("idx").alias("content_index"), (c("l_suppkey") % 7 == 0).alias("excluded"), c("l_quantity").alias("p"))
    return candidates.pairs(tables, parents, F.floor(c("q") / 10) - F.floor(c("p") / 20)).select("doc", "table_id", "parent_id", c("score").cast("long").alias("score"), "place")


PAIRS = f"""WITH {_LINES}, p AS (SELECT a.doc, a.idx AS table_id, b.idx AS parent_id, CASE WHEN b.l_suppkey % 7 = 0 THEN -1 ELSE CAST(floor(a.l_quantity / 10) - floor(b.l_quantity / 20) AS BIGINT) END AS score, b.l_partkey % 4 AS page
 FROM u a JOIN u b ON a.doc = b.doc AND a.idx % 2 = 1 AND b.idx % 2 = 0)
 SELECT doc, table_id, parent_id, score, row_number() OVER (PARTITION BY doc, table_id ORDER BY score DESC, page, parent_id) AS place FROM p"""


def strict_candidates(spark, sf_dir):
    """Lines as children of an order's table: gates, then the three best by nine keys."""
    own = _unique_lines(spark, sf_dir).select(
        "doc", F.lit("t").alias("table_id"), c("idx").alias("child_id"), (c("l_partkey") % 11 == 0).alias("exact_reference"), (c("l_quantity") * 4).alias("parent_score"),
        (c("l_suppkey") % 6).alias("tier"), (c("l_extendedprice") % 100).alias("child_score"), (c("l_partkey") % 2 == 0).alias("condition_match"), (c("l_partkey") % 3 == 0).alias("result_match"),
        (c("l_suppkey") % 3).alias("n_families"), F.when(c("idx") > 2, c("idx")).alias("page_distance"), c("idx").alias("block_distance"), F.lit("x").alias("child_text"),
    )
    return candidates.best_k(candidates.strict(own), 3).select("doc", "child_id", "gate", "rank")


STRICT = f"""WITH {_LINES}, g AS (SELECT *, l_partkey % 11 = 0 AS r, l_partkey % 11 = 0 OR l_quantity * 4 >= 120 OR l_suppkey % 6 IN (1, 2) AS pg, l_partkey % 11 = 0 OR l_extendedprice % 100 >= 60 AS cg FROM u),
 k AS (SELECT doc, idx AS child_id, CASE WHEN cg THEN 'selected' ELSE 'fallback' END AS gate, row_number() OVER (PARTITION BY doc ORDER BY cg DESC, r DESC, l_extendedprice % 100 DESC, l_quantity DESC, l_partkey % 2 = 0 DESC, l_partkey % 3 = 0 DESC,
 l_suppkey % 3 DESC, CASE WHEN idx > 2 THEN idx ELSE 999999 END, idx) AS rank FROM g WHERE pg) SELECT doc, child_id, gate, rank FROM k WHERE rank <= 3"""


def projected_selection(spark, sf_dir):
    own = _unique_lines(spark, sf_dir).select("doc", F.lit("t").alias("table_id"), (c("idx") % 2).alias("parent_id"), c("idx").alias("child_id"), (c("l_partkey") % 13 == 0).alias("exact_reference"), c("l_quantity").alias("score"))
    return candidates.projected(own, 40).where("selected").select("doc", "child_id", "selection_reason")


PROJECTED = f"""WITH {_LINES}, g AS (SELECT *, l_partkey % 13 = 0 OR l_quantity >= 40 AS own FROM u), w AS (SELECT *, bool_or(own) OVER (PARTITION BY doc, idx % 2) AS any_own, row_number() OVER (PARTITION BY doc, idx % 2 ORDER BY l_quantity DESC, idx) AS k FROM g)
 SELECT doc, idx AS child_id, CASE WHEN own THEN 'score_or_reference' ELSE 'fallback_best_child' END AS selection_reason FROM w WHERE own OR (NOT any_own AND k = 1)"""


def candidate_audit(spark, sf_dir):
    """Slices of documents, of which every 11th has an offset too high, every 7th a label that is not its parent's."""
    d = t(spark, sf_dir, "documents").where(c("text").isNotNull())
    own = d.select(
        c("doc_id").alias("doc"), c("doc_id").alias("child_id"), c("text").alias("parent_text"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"),
        F.when(c("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(c("text")).alias("child_text"), F.lit(0).alias("parent_label"),
        F.when(c("doc_id") % 7 == 0, 1).otherwise(0).alias("child_label"), (c("doc_id") % 5 != 0).alias("selected"),
    )
    return candidates.audit(own).groupBy("failure").agg(F.count("*").alias("n"), F.min("child_id").alias("first_child"))


AUDIT = """WITH d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'offset_mismatch' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'child_label_not_inherited' END, CASE WHEN doc_id % 5 = 0 THEN 'label_without_selection' END], lambda x: x IS NOT NULL)) AS failure FROM d)
 SELECT failure, count(*) AS n, min(doc_id) AS first_child FROM f GROUP BY failure"""


def first_reviews(spark, sf_dir):
    """Toxicity labels as reviews of documents whose gold label is their quality."""
    rows = t(spark, sf_dir, "documents").select(c("doc_id").alias("key"), "text").join(t(spark, sf_dir, "labels").select(c("doc_id").alias("key"), c("quality").alias("gold_label")), "key")
    said = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id").select(
        c("doc_id").alias("key"), F.when(c("doc_id") % 9 == 0, "x").otherwise(F.sha2("text", 256)).alias("text_sha256"), c("toxic").alias("label"),
        F.when(c("doc_id") % 4 != 0, "result").alias("role"), F.lit("s").alias("support"), F.when(c("doc_id") % 6 != 0, "because").otherwise(" ").alias("rationale"),
    )
    return candidates.first_reviews(rows, said).groupBy("failure").agg(F.count("*").alias("n"))


REVIEWS = """WITH r AS (SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id)), f AS (SELECT unnest(list_filter([CASE WHEN doc_id % 9 = 0 AND text IS NOT NULL THEN 'text_hash_mismatch' END,
 CASE WHEN toxic IS NULL THEN 'label_not_0_or_1' END, CASE WHEN toxic = 0 AND doc_id % 4 = 0 THEN 'role_missing' END, CASE WHEN doc_id % 6 = 0 THEN 'rationale_missing' END, CASE WHEN quality <> toxic THEN 'conflict_with_gold' END], lambda x: x IS NOT NULL)) AS failure FROM r)
 SELECT failure, count(*) AS n FROM f GROUP BY failure"""


def caption_grammar(spark, sf_dir):
    """Labels of captions made of part names."""
    own = t(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.when(c("p_partkey") % 3 == 0, "as ").otherwise(""), F.lit("Table "), (c("p_partkey") % 40).cast("string"), F.lit(": "), "p_name", F.lit(" see Tab. S"), c("p_size").cast("string"), F.lit(" and Supplementary Table A.1 (Fig. 3)")).alias("caption"))
    found = labels.labels(c("caption"))
    return own.select(
        "p_partkey", F.array_join(found, "|").alias("written"), F.array_join(F.transform(found, labels.canonical), "|").alias("canonical"), labels.caption_like(c("caption")).alias("caption_like"),
        F.array_join(labels.caption_labels(c("caption")), "|").alias("named"), labels.unused_label(c("caption"), F.array(F.lit("Table 1"), F.lit("Table 2")), c("p_size")).alias("unused"),
    )


CAPTIONS = """WITH p AS (SELECT p_partkey, CAST(p_partkey % 40 AS VARCHAR) AS n, 'S' || p_size AS s FROM part)
 SELECT p_partkey, 'Table ' || n || '|Tab. ' || s || '|Supplementary Table A.1' AS written, 'Table ' || n || '|Table ' || s || '|Table A1' AS canonical, p_partkey % 3 <> 0 AS caption_like,
 'Table ' || n || '|Table ' || s AS named, CASE WHEN n IN ('1', '2') THEN 'Table ' || s ELSE 'Table ' || n END AS unused FROM p"""


def normalized_tables(spark, sf_dir):
    """Suppliers and parts as tables of two sources that name their fields differently."""
    a = t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.when(c("s_suppkey") % 2 == 0, c("s_name")).alias("label"), c("s_name").alias("caption"))
    b = t(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("table_id"), c("p_name").alias("canonical_label"), c("p_brand").alias("table_html"))
    return normalize.tables(a).unionByName(normalize.tables(b))


NORMALIZED = """SELECT 's' || s_suppkey AS table_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 's' || s_suppkey END AS label, s_name AS caption, '' AS body FROM supplier
 UNION ALL SELECT 'p' || p_partkey, p_name, '', p_brand FROM part"""


def unique_lines_of_documents(spark, sf_dir):
    own = normalize.unique_texts(F.split("text", "\n"))
    return t(spark, sf_dir, "documents").where(c("text").isNotNull()).select("doc_id", F.size(own).cast("long").alias("n"), F.sha2(F.array_join(own, "\n"), 256).alias("sha256"))


UNIQUE_LINES = """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS x FROM documents WHERE text IS NOT NULL),
 f AS (SELECT doc_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS x FROM l) SELECT doc_id, CAST(len(x) AS BIGINT) AS n, sha256(array_to_string(x, chr(10))) AS sha256 FROM f"""


def label_set_difference(spark, sf_dir):
    return normalize.same_sets(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), ["doc_id"]).groupBy("problem").agg(F.count("*").alias("n"))


SET_DIFFERENCE = "WITH d AS (SELECT doc_id, 'missing' AS problem FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) SELECT problem, count(*) AS n FROM d GROUP BY problem"


def filled_prompts(spark, sf_dir):
    prompt = normalize.filled("Q{{item}}: {{text}} ({{item}})", item=c("item_id"), text=c("text"))
    return t(spark, sf_dir, "benchmark").select("item_id", F.sha2(prompt, 256).alias("prompt_sha256"))


PROMPTS = "SELECT item_id, sha256('Q' || item_id || ': ' || coalesce(text, '') || ' (' || item_id || ')') AS prompt_sha256 FROM benchmark"

QUERIES = {f.__name__: f for f in (draft_ranges, attach_leaves, sibling_order, descendant_counts, page_texts, page_start_flags, candidate_pairs, strict_candidates, projected_selection, candidate_audit, first_reviews, caption_grammar, normalized_tables, unique_lines_of_documents, label_set_difference, filled_prompts)}
SQL = {
    "draft_ranges": f"WITH {_SECTIONS} SELECT doc, idx, depth, end_page FROM s", "attach_leaves": f"WITH {_ATTACHED} SELECT doc, content_index, parent_node_id, assignment_reason FROM a WHERE parent_node_id IS NOT NULL",
    "sibling_order": f"WITH {_ATTACHED} SELECT doc, parent_node_id, content_index AS node_id, row_number() OVER (PARTITION BY doc, parent_node_id ORDER BY page, l_quantity, CASE WHEN is_table THEN 'table' ELSE 'text' END, CAST(content_index AS VARCHAR)) AS place FROM a WHERE parent_node_id IS NOT NULL",
    "descendant_counts": DESCENDANTS, "page_texts": PAGE_TEXTS, "page_start_flags": PAGE_START, "candidate_pairs": PAIRS, "strict_candidates": STRICT, "projected_selection": PROJECTED, "candidate_audit": AUDIT,
    "first_reviews": REVIEWS, "caption_grammar": CAPTIONS, "normalized_tables": NORMALIZED, "unique_lines_of_documents": UNIQUE_LINES, "label_set_difference": SET_DIFFERENCE, "filled_prompts": PROMPTS,
}
