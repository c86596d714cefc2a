"""Scores of evidence as columns. Weights are arguments; the defaults are the fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry, text

_flag = lambda c, points: F.when(F.coalesce(c, F.lit(False)), float(points)).otherwise(0.0)


def by_steps(distance: Column, steps: list[tuple[int, float]]) -> Column:
    """Points of the first step that a distance does not exceed; none for a null."""
    out = F
    for most, points in steps:
        out = out.when(distance <= most, float(points))
    return out.otherwise(0.0)


# Points by distance in pages and in reading order.
PAGE_STEPS = [(0, 35), (1, 25), (2, 15)]
SUGGESTION_PAGE_STEPS = [(0, 100), (1, 60), (2, 30)]
SUGGESTION_BLOCK_STEPS = [(5, 80), (10, 40), (20, 20)]
DEFAULT_WEIGHTS = {
    "exact_table_reference": 100.0,
    "table_text_overlap_per_token": 5.0,
    "table_text_overlap_cap": 30.0,
    "annotation_rationale_overlap_per_token": 5.0,
    "annotation_rationale_overlap_cap": 25.0,
    "evidence_family_match": 25.0,
    "condition_match": 15.0,
    "result_match": 15.0,
}


def capped(count: Column, each: float, most: float) -> Column:
    return F.least(F.lit(float(most)), count * F.lit(float(each)))


def suggestion_parts(explicit: Column, same_section: Column, pages: Column, blocks: Column, hints: Column, overlap: Column) -> Column:
    """Points of a table suggestion by channel, as a map; channels without points are left out."""
    parts = {
        "structured_table_reference": _flag(explicit, 1000),
        "same_section": _flag(same_section, 200),
        "nearby_page": by_steps(pages, SUGGESTION_PAGE_STEPS),
        "nearby_reading_order": by_steps(blocks, SUGGESTION_BLOCK_STEPS),
        "condition_hints": capped(hints, 10, 90),
        "table_text_lexical_overlap": capped(overlap, 5, 50),
    }
    return F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]), lambda _, v: v > 0)


def total(parts: Column) -> Column:
    return F.aggregate(F.map_values(parts), F.lit(0.0), lambda a, x: a + x)


def parent_score(reference: Column, same_section: Column, pages: Column, blocks: Column, section: Column, condition: Column, overlap: Column) -> Column:
    """Priority of a paragraph for a table."""
    near = _flag(blocks <= 8, 20)
    return _flag(reference, 100) + _flag(same_section, 40) + by_steps(pages, PAGE_STEPS) + near + _flag(section, 20) + _flag(condition, 10) + capped(overlap, 5, 30)


def parent_tier(reference: Column, same_section: Column, pages: Column, blocks: Column, section: Column, condition: Column, overlap: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(reference), "tier_1_explicit_reference")
        .when(yes(same_section) | yes(pages <= 1) | yes(blocks <= 8), "tier_2_local_context")
        .when(yes(section) | yes(condition) | (overlap > 0), "tier_3_experiment_condition")
        .otherwise("tier_4_background")
    )


def layout_parent_score(reference: Column, nested: Column, shared_depth: Column, pages: Column, blocks: Column, section: Column, condition: Column, overlap: Column) -> Column:
    """Priority of a layout node for a table: the section counts by depth, reading order in two steps."""
    place = F.when(F.coalesce(nested, F.lit(False)), 35.0).otherwise(capped(shared_depth, 10, 30))
    return _flag(reference, 100) + place + by_steps(pages, PAGE_STEPS) + by_steps(blocks, [(8, 20), (20, 10)]) + _flag(section, 20) + _flag(condition, 10) + capped(overlap, 5, 30)


def child_score(body: Column, reference: Column, overlap: Column) -> Column:
    """Score of a child span: reference, shared tokens, result words, condition words, families."""
    families = text.family_hits(body)
    return _flag(reference, 100) + capped(overlap, 5, 30) + _flag(F.array_contains(families, "result"), 15) + _flag(body.rlike(text.whole_words(text.CONDITION_WORDS)), 15) + capped(F.size(families), 8, 30)


def policy_score(signals: Column, weights: dict[str, float] | Column) -> Column:
    """Weighted score of child signals; result words count for the family result only."""
    w = (lambda k: F.lit(float(weights[k]))) if isinstance(weights, dict) else (lambda k: weights[k])
    many = lambda name: F.least(w(f"{name}_cap"), F.size(signals[name]) * w(f"{name}_per_token"))
    one = lambda c, k: F.when(F.coalesce(c, F.lit(False)), w(k)).otherwise(0.0)
    return (
        one(signals["exact_table_reference"], "exact_table_reference") + many("table_text_overlap") + many("annotation_rationale_overlap")
        + one(signals["evidence_family_match"], "evidence_family_match") + one(signals["condition_match"], "condition_match")
        + one(signals["result_match"] & (signals["evidence_family"] == "result"), "result_match")
    )


def caption_score(kind: Column, caption_like: Column, page: Column, table_page: Column, same_label: Column, box: Column, table_box: Column, index: Column, table_index: Column, late_label: Column) -> Column:
    """Score of a caption candidate for a table."""
    place = geometry.vertical(box, table_box)
    near = F.coalesce(page, F.lit(0)) - F.coalesce(table_page, F.lit(0))
    steps = F.abs(F.coalesce(index, F.lit(0)) - F.coalesce(table_index, F.lit(0)))
    source = F.when(kind.isin("own_table_caption", "own_code_caption"), 45.0).when(caption_like, 25.0).otherwise(-20.0)
    pages = F.when(page.eqNullSafe(table_page), 20.0).when(F.abs(near) == 1, 4.0).otherwise(0.0)
    side = F.when(place["relation"] == "above", 8.0).when(place["relation"] == "below", 6.0).when(place["relation"] == "overlap", 4.0)
    gap = F.greatest(F.lit(0.0), 18 - F.least(place["distance"], F.lit(360.0)) / 20)
    return source + pages + _flag(same_label, 25) + F.coalesce(side + gap, F.lit(0.0)) + 8 * F.least(F.lit(1.0), geometry.overlap_share(box, table_box)) + F.greatest(F.lit(0.0), 12.0 - steps) - _flag(late_label, 15)


def confidence(score: Column) -> Column:
    return F.when(score >= 95, "high").when(score >= 70, "medium").otherwise("low")
