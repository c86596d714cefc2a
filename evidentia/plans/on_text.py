"""Queries on documents, benchmark, pages and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import spans, text
from evidentia.operators import coverage, inventory, matching, normalize, paragraphs, pairwise, tree


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPLIT = r"""string_split(regexp_replace(text, '([.!?])(\s+["''(\[]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"""
_BLANK = r"""regexp_replace(regexp_replace({c}, '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"""
_SPANS = f"""p AS (SELECT doc_id, lang, {_SPLIT} AS parts FROM documents),
 s AS (SELECT doc_id, lang, CAST(unnest(range(len(parts))) AS INT) AS pos, unnest(parts) AS span FROM p),
 o AS (SELECT *, CAST(coalesce(sum(length(span)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS char_start FROM s)"""


def blank(c):
    return _BLANK.format(c=c)


def span_inventory(spark, sf_dir):
    own = spans.sentence_spans(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return own.select("doc_id", "pos", "char_start", "char_end", F.sha2("span", 256).alias("span_sha256"))


SPAN_INVENTORY = f"WITH {_SPANS} SELECT doc_id, pos, char_start, CAST(char_start + length(span) AS INT) AS char_end, sha256(span) AS span_sha256 FROM o WHERE length({blank('span')}) > 0"


def span_stats_by_lang(spark, sf_dir):
    parts = t(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", spans.BOUNDARY)).alias("span"))
    own = parts.where(F.length(text.collapse(F.col("span"))) > 0)
    return own.groupBy("lang").agg(F.count("*").alias("n_spans"), F.sum(F.length("span")).alias("chars"), F.max(F.length("span")).alias("longest"))


SPAN_STATS = f"WITH {_SPANS} SELECT lang, count(*) AS n_spans, CAST(sum(length(span)) AS BIGINT) AS chars, max(length(span)) AS longest FROM o WHERE length({blank('span')}) > 0 GROUP BY lang"


def span_offset_audit(spark, sf_dir):
    """Documents with a span whose text is not the slice at its offsets: those of every 50th, whose offsets are moved on purpose."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("parent_text"), spans.text_spans_v2_udf("text").alias("own"))
    by = F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)
    moved = F.transform("own", lambda x: F.struct((x["start"] + by).alias("char_start"), x["end"].alias("char_end"), x["text"].alias("text")))
    checked = normalize.parents_with_offsets(docs.select("doc_id", "parent_text", moved.alias("children")))
    return checked.where(F.exists("problems", lambda x: x.isNotNull())).select("doc_id").distinct()


def spans_scope(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("parent_id"), F.col("text").alias("full_text"))
    return spans.children(docs).select("parent_id", "child_id", "char_start", "char_end", "text_sha256")


def spans_long(spark, sf_dir):
    own = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans.spans_v1_udf("text")).alias("pos", "s"))
    return own.select("doc_id", "pos", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"))


def doc_fingerprint(spark, sf_dir):
    own = t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(text.collapse(F.col("text"))), 256).alias("fingerprint"))
    return own.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"))


DOC_FINGERPRINT = f"SELECT sha256(lower({blank('text')})) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents GROUP BY 1"


def normalized_fingerprint(spark, sf_dir):
    own = t(spark, sf_dir, "documents").select("doc_id", F.sha2(text.nfkc_casefold("text"), 256).alias("fingerprint"))
    return own.groupBy("fingerprint").agg(F.count("*").alias("copies"))


NORMALIZED_FINGERPRINT = f"SELECT sha256(replace(lower({blank('text')}), 'ß', 'ss')) AS fingerprint, count(*) AS copies FROM documents GROUP BY 1"

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def sql_tokens(c):
    found = rf"list_distinct(list_transform(regexp_extract_all(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '{text.TOKEN_V1}'), lambda x: lower(x)))"
    return f"list_filter({found}, lambda x: NOT list_contains({_STOP}, x))"


_OVERLAPS = f"""e AS (SELECT item_id, {sql_tokens('text')} AS tk FROM benchmark),
 d AS (SELECT doc_id, {sql_tokens('text')} AS tk FROM documents),
 ew AS (SELECT item_id, len(tk) AS total, unnest(tk) AS w FROM e), dw AS (SELECT doc_id, unnest(tk) AS w FROM d),
 o AS (SELECT item_id, doc_id, count(*) AS shared, min(total) AS total FROM ew JOIN dw USING (w) GROUP BY item_id, doc_id)"""


def _evidence(spark, sf_dir):
    evidence = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("evidence_id"), "text")
    return evidence, t(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), "text")


def lexical_overlap_topk(spark, sf_dir):
    evidence, parents = _evidence(spark, sf_dir)
    score = F.least(F.lit(30), F.col("shared") * 5)
    w = Window.partitionBy("evidence_id").orderBy(F.desc("score"), F.desc("shared"), "parent_id")
    ranked = coverage.token_overlaps(evidence, parents).withColumn("score", score).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return ranked.select(F.col("evidence_id").alias("item_id"), F.col("parent_id").alias("doc_id"), "shared", "score", "rank")


LEXICAL_TOPK = f"""WITH {_OVERLAPS}, r AS (SELECT item_id, doc_id, shared, least(30, shared * 5) AS score,
 row_number() OVER (PARTITION BY item_id ORDER BY least(30, shared * 5) DESC, shared DESC, doc_id) AS rank FROM o) SELECT * FROM r WHERE rank <= 5"""


def token_containment_match(spark, sf_dir):
    out = coverage.best_evidence(*_evidence(spark, sf_dir))
    return out.select(F.col("evidence_id").alias("item_id"), F.col("parent_id").alias("doc_id"), F.round("share", 6).alias("share"), "status")


TOKEN_MATCH = f"""WITH {_OVERLAPS}, r AS (SELECT item_id, doc_id, shared / total AS share,
 row_number() OVER (PARTITION BY item_id ORDER BY shared / total DESC, doc_id) AS k FROM o)
 SELECT b.item_id, r.doc_id, round(r.share, 6) AS share, CASE WHEN share >= 0.65 THEN 'covered' WHEN share >= 0.45 THEN 'weak' ELSE 'uncovered' END AS status
 FROM benchmark b LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (item_id)"""

_COVER = f"SELECT b.item_id, count(d.doc_id) AS parents FROM benchmark b LEFT JOIN documents d ON contains(lower({blank('d.text')}), lower({blank('b.text')})) GROUP BY b.item_id"


def reference_coverage(spark, sf_dir):
    out = coverage.substring_coverage(*_evidence(spark, sf_dir))
    return out.select(F.col("evidence_id").alias("item_id"), "parents", (F.col("parents") > 0).alias("covered"))


REFERENCE_COVERAGE = f"SELECT item_id, parents, parents > 0 AS covered FROM ({_COVER})"


def unique_evidence_coverage(spark, sf_dir):
    evidence, parents = _evidence(spark, sf_dir)
    joined = coverage.substring_coverage(evidence, parents).join(evidence, "evidence_id")
    distinct = joined.groupBy(F.lower(text.collapse(F.col("text"))).alias("k")).agg(F.bool_or(F.col("parents") > 0).alias("covered"), F.count("*").alias("n"))
    hit = F.count(F.when(F.col("covered"), True))
    return distinct.agg(F.sum("n").alias("evidence"), F.count("*").alias("distinct_evidence"), hit.alias("covered_evidence"), F.round(hit / F.count("*"), 6).alias("coverage"))


UNIQUE_COVERAGE = f"""WITH c AS ({_COVER}), u AS (SELECT lower({blank('text')}) AS k, bool_or(parents > 0) AS covered, count(*) AS n FROM benchmark JOIN c USING (item_id) GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS evidence, count(*) AS distinct_evidence, count(*) FILTER (covered) AS covered_evidence, round(count(*) FILTER (covered) / count(*), 6) AS coverage FROM u"""


def coverage_tiers(spark, sf_dir):
    out = coverage.coverage_cascade(*_evidence(spark, sf_dir))
    return out.groupBy("tier").agg(F.count("*").alias("n"))


def _re(body, both):
    return f"(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(?:{body})" + ("($|[^\\p{L}\\p{M}\\p{N}_])" if both else "")


def _hit_sql(c, patterns, both):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, '{_re(p, both)}') THEN '{k}' END" for k, p in sorted(patterns.items())) + "], lambda x: x IS NOT NULL)"


# Literal texts beside the documents, so that every family and hint occurs.
_PROBES = [
    "All runs use the test set with five seeds and a batch size of 8.",
    "Accuracy improves over the baseline; the encoder is frozen.",
    "Few-shot prompts, greedy decoding at temperature 0, and top-k sampling.",
    "Unless otherwise noted we use the same setting, cross-validation and held-out splits.",
    "Nothing to see here.",
]


def _probed(spark, sf_dir):
    rows = spark.createDataFrame([(-1 - k, x) for k, x in enumerate(_PROBES)], "doc_id long, text string")
    return t(spark, sf_dir, "documents").select("doc_id", "text").unionByName(rows)


_PROBED = "x AS (SELECT doc_id, text FROM documents UNION ALL VALUES " + ", ".join(f"({-1 - k}, '{x}')" for k, x in enumerate(_PROBES)) + ")"


def condition_hints(spark, sf_dir):
    out = _probed(spark, sf_dir).select("doc_id", F.array_join(text.condition_hints(F.col("text")), ",").alias("hints"))
    return out.where("hints <> ''")


CONDITION_HINTS = f"WITH {_PROBED} SELECT doc_id, array_to_string({_hit_sql('text', text.CONDITION_HINTS, True)}, ',') AS hints FROM x WHERE hints <> ''"


def family_hits(spark, sf_dir):
    out = _probed(spark, sf_dir).select("doc_id", F.array_join(text.family_hits(F.col("text")), ",").alias("families"))
    return out.where("families <> ''")


FAMILY_HITS = f"WITH {_PROBED} SELECT doc_id, array_to_string({_hit_sql('text', text.EVIDENCE_FAMILIES, False)}, ',') AS families FROM x WHERE families <> ''"


def orphan_classification(spark, sf_dir):
    """Turns as blocks: system text counts as a caption, later turns of a long conversation as its references."""
    c = t(spark, sf_dir, "conversations")
    system = c.where("role = 'system'").groupBy("conv_id").agg(F.min(F.lower(text.collapse(F.col("text")))).alias("caption"))
    first = c.where("turn = 0").groupBy("conv_id").agg(F.min(F.lower(text.collapse(F.col("text")))).alias("lead"))
    own = c.join(system, "conv_id", "left").join(first, "conv_id", "left").withColumn("n", F.lower(text.collapse(F.col("text"))))
    status = inventory.orphan_status(F.col("n"), F.contains("caption", F.col("n")) | F.contains("n", F.col("caption")), F.col("turn") >= 6, F.col("role") == "assistant", F.contains("lead", F.col("n")))
    return own.withColumn("status", status).groupBy("status").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("chars"))


ORPHANS = f"""WITH c AS (SELECT *, lower({blank('text')}) AS n FROM conversations),
 s AS (SELECT conv_id, min(n) AS caption FROM c WHERE role = 'system' GROUP BY 1), f AS (SELECT conv_id, min(n) AS lead FROM c WHERE turn = 0 GROUP BY 1),
 j AS (SELECT c.*, CASE WHEN n = '' OR n IS NULL THEN 'excluded_empty_text' WHEN contains(caption, n) OR contains(n, caption) THEN 'excluded_known_table_caption'
  WHEN turn >= 6 THEN 'excluded_reference_area' WHEN role = 'assistant' THEN 'covered_by_block_id' WHEN contains(lead, n) THEN 'covered_by_content' ELSE 'orphan_fallback' END AS status
  FROM c LEFT JOIN s USING (conv_id) LEFT JOIN f USING (conv_id))
 SELECT status, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM j GROUP BY status"""


def block_context_window(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-4, 4)
    near = F.transform(F.collect_list(F.struct("turn", "text")).over(w), lambda x: F.concat_ws(":", x["turn"].cast("string"), x["text"]))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.array_join(near, "\n"), 256).alias("context_sha256"))


CONTEXT = """SELECT conv_id, turn, sha256(string_agg(CAST(turn AS VARCHAR) || ':' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS context_sha256 FROM conversations"""


def paragraph_merge(spark, sf_dir):
    """Turns join the turn before while it is long and ends in a letter, or they start in lower case."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("text").over(w)
    joined = F.coalesce(~before.rlike(r"[.!?]\s*$") | F.col("text").rlike(r"^\s*[a-z]") | (F.length(before) > 400), F.lit(False))
    numbered = paragraphs.sessions(t(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], joined, "paragraph")
    return numbered.groupBy("conv_id", "paragraph").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


PARAGRAPHS = r"""WITH b AS (SELECT *, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
 n AS (SELECT *, CASE WHEN coalesce(NOT regexp_matches(before, '[.!?]\s*$') OR regexp_matches(text, '^\s*[a-z]') OR length(before) > 400, false) THEN 0 ELSE 1 END AS fresh FROM b),
 s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM n)
 SELECT conv_id, paragraph, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY conv_id, paragraph"""


def section_ranges(spark, sf_dir):
    """User turns as sections: each runs to the next one, which shares its own page unless it is long."""
    c = t(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("page_count"))
    own = c.where("role = 'user'").join(last, "conv_id").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.col("turn").alias("start_page"), (F.length("text") > 200).alias("at_page_start"), "page_count")
    return tree.page_ranges(own).select(F.col("doc").alias("conv_id"), "start_page", "end_page")


SECTIONS = """WITH c AS (SELECT conv_id, turn, role, length(text) > 200 AS fresh, max(turn) OVER (PARTITION BY conv_id) AS pages FROM conversations),
 e AS (SELECT conv_id, turn, pages, lead(turn) OVER w AS after, lead(fresh) OVER w AS after_fresh FROM c WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn AS start_page, greatest(turn, CASE WHEN after IS NULL THEN pages WHEN after_fresh THEN after - 1 ELSE after END) AS end_page FROM e"""


def html_outline(spark, sf_dir):
    items = F.regexp_extract_all("html", F.lit(r"(?s)<(li|p|h[1-6])\b[^>]*>(.*?)</\1>"), F.lit(2))
    own = t(spark, sf_dir, "pages").select("page_id", items.alias("items"))
    return own.select("page_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", "\n"), 256).alias("items_sha256"))


HTML_OUTLINE = """WITH m AS (SELECT page_id, regexp_extract_all(html, '(?s)<li\\b[^>]*>.*?</li>|<p\\b[^>]*>.*?</p>|<h1\\b[^>]*>.*?</h1>|<h2\\b[^>]*>.*?</h2>|<h3\\b[^>]*>.*?</h3>|<h4\\b[^>]*>.*?</h4>|<h5\\b[^>]*>.*?</h5>|<h6\\b[^>]*>.*?</h6>') AS raw FROM pages),
 i AS (SELECT page_id, list_transform(raw, lambda x: regexp_replace(x, '(?s)^<[^>]*>(.*)</[^>]*>$', '\\1')) AS items FROM m)
 SELECT page_id, CAST(len(items) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, chr(10)), '')) AS items_sha256 FROM i"""


def best_pair(spark, sf_dir):
    """User and assistant turns of a conversation as claims and tables, scored by shared tokens."""
    c = t(spark, sf_dir, "conversations")
    side = lambda role, n: c.where(F.col("role") == role).select("conv_id", F.col("turn").alias(n), text.tokens(F.col("text")).alias(f"{n}_tokens"))
    pairs = side("user", "u").join(side("assistant", "a"), "conv_id")
    score = F.size(F.array_intersect("u_tokens", "a_tokens")) / F.greatest(F.size("u_tokens"), F.lit(1))
    scored = pairs.select(F.concat_ws(":", "conv_id", "u").alias("sample_id"), F.col("a").alias("idx"), F.round(score, 9).alias("score"))
    return pairwise.best_pairs(scored, 0.1).where("review_rank = 1").select("sample_id", "idx", F.round("best_score", 6).alias("best_score"), "matched")


BEST_PAIR = f"""WITH u AS (SELECT conv_id, turn AS u, {sql_tokens('text')} AS utk FROM conversations WHERE role = 'user'),
 a AS (SELECT conv_id, turn AS a, {sql_tokens('text')} AS atk FROM conversations WHERE role = 'assistant'),
 p AS (SELECT conv_id || ':' || u AS sample_id, a AS idx, round(len(list_intersect(utk, atk)) / greatest(len(utk), 1), 9) AS score FROM u JOIN a USING (conv_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, idx) AS k FROM p)
 SELECT sample_id, idx, round(score, 6) AS best_score, score > 0.1 AS matched FROM r WHERE k = 1"""


def memory_pack(spark, sf_dir):
    from evidentia.operators import policy

    items = t(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("haystack"), F.lit(0.5).alias("confidence"))
    score = policy.memory_score(F.col("haystack"), F.col("confidence"), ["the", "ing", "edst", "thing"], "benchmark", "there")
    return items.select("item_id", score.alias("score")).orderBy(F.desc("score"), "item_id").limit(10)


MEMORY_PACK = """WITH m AS (SELECT item_id, lower(text) AS h FROM benchmark), s AS (SELECT item_id, 0.5::DOUBLE + CASE WHEN contains(h, 'benchmark') THEN 8.0 ELSE 0.0 END
 + CASE WHEN contains(h, 'there') THEN 10.0 ELSE 0.0 END + CASE WHEN contains(h, 'the') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(h, 'ing') THEN 1.0 ELSE 0.0 END
 + CASE WHEN contains(h, 'edst') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(h, 'thing') THEN 1.0 ELSE 0.0 END AS score FROM m)
 SELECT item_id, CAST(score AS DOUBLE) AS score FROM s ORDER BY score DESC, item_id LIMIT 10"""


def fallback_best_span(spark, sf_dir):
    """The first span of each document with a number in it, else its longest span."""
    own = spans.sentence_spans(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    scored = own.withColumn("hit", F.col("span").rlike("[0-9]").cast("int"))
    order = [F.desc("hit"), F.when(F.col("hit") == 1, F.col("pos")), F.desc(F.length("span")), F.col("pos")]
    return matching.best_per_group(scored, ["doc_id"], order).select("doc_id", "pos", (F.col("hit") == 1).alias("by_rule"))


FALLBACK_SPAN = f"""WITH {_SPANS}, k AS (SELECT doc_id, pos, regexp_matches(span, '[0-9]') AS by_rule,
 row_number() OVER (PARTITION BY doc_id ORDER BY regexp_matches(span, '[0-9]') DESC, CASE WHEN regexp_matches(span, '[0-9]') THEN pos END NULLS FIRST, length(span) DESC, pos) AS r
 FROM o WHERE length({blank('span')}) > 0) SELECT doc_id, pos, by_rule FROM k WHERE r = 1"""

QUERIES = {f.__name__: f for f in (
    span_inventory, span_stats_by_lang, span_offset_audit, spans_scope, spans_long, doc_fingerprint, normalized_fingerprint, lexical_overlap_topk, token_containment_match,
    reference_coverage, unique_evidence_coverage, coverage_tiers, condition_hints, family_hits, orphan_classification, block_context_window, paragraph_merge,
    section_ranges, html_outline, best_pair, memory_pack, fallback_best_span,
)}
SQL = {
    "span_inventory": SPAN_INVENTORY, "span_stats_by_lang": SPAN_STATS, "span_offset_audit": f"SELECT DISTINCT doc_id FROM documents WHERE doc_id % 50 = 0 AND length({blank('text')}) > 0",
    "doc_fingerprint": DOC_FINGERPRINT, "normalized_fingerprint": NORMALIZED_FINGERPRINT, "lexical_overlap_topk": LEXICAL_TOPK, "token_containment_match": TOKEN_MATCH,
    "reference_coverage": REFERENCE_COVERAGE, "unique_evidence_coverage": UNIQUE_COVERAGE, "condition_hints": CONDITION_HINTS, "family_hits": FAMILY_HITS,
    "orphan_classification": ORPHANS, "block_context_window": CONTEXT, "paragraph_merge": PARAGRAPHS, "section_ranges": SECTIONS, "html_outline": HTML_OUTLINE,
    "best_pair": BEST_PAIR, "memory_pack": MEMORY_PACK, "fallback_best_span": FALLBACK_SPAN,
}
