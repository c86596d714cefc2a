"""Content blocks as columns: their text, what kind they are, what is no evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text

# Titles of sections that carry no evidence, and labels of tables and figures.
OUTLINE_WORDS = r"(?iU)\b(?:references?|bibliograph(?:y|ies)|author list|contributions?|acknowledg(?:e)?ments?|ethics statement|license)\b"
NO_EVIDENCE_WORDS = r"(?iU)\b(?:references?|bibliography|acknowledg|author list|contributions?)\b|^preface$"
TABLE_WORDS, FIGURE_WORDS = r"(?iU)\btab(?:le|\.)\s*[A-Z]?\.?\d", r"(?iU)\bfig(?:ure|\.)\s*[A-Z]?\.?\d"
FRONT_PAGE_CHARS, LICENSE_CHARS = 600, 500


def block_text(kind: Column, body: Column, items: Column, caption: Column, content: Column) -> Column:
    """A block's text by kind: prose as it is, list items as lines, captions before the content of media and code."""
    head = F.coalesce(F.array_join(caption, " "), F.lit(""))
    both = F.trim(F.concat_ws("\n", head, F.coalesce(content, F.lit(""))), F.lit(" \n"))
    return (
        F.when(kind.isin("text", "page_footnote", "aside_text"), F.coalesce(body, F.lit(""))).when(kind == "list", F.coalesce(F.array_join(items, "\n"), F.lit("")))
        .when(kind.isin("chart", "image", "code"), both).when(kind == "table", F.trim(head)).otherwise(F.lit(""))
    )


def prose(kind: Column, body: Column, items: Column) -> Column:
    """The text of blocks that are read as prose; null for all others. Blank list items are left out."""
    filled = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(kind.isin("text", "page_footnote"), body).when(kind == "list", F.array_join(filled, "\n"))


def is_table(kind: Column, caption: Column) -> Column:
    """Tables but those that only name a figure, and code whose caption names a table."""
    named = caption.rlike(TABLE_WORDS)
    return ((kind == "table") & ~(caption.rlike(FIGURE_WORDS) & ~named)) | ((kind == "code") & named)


def is_outline_only(title: Column) -> Column:
    return title.rlike(OUTLINE_WORDS)


def exclusion_reason(body: Column, page: Column) -> Column:
    """Why a paragraph is no body text: an author block on page 1, or a note on licences; null if it is."""
    author = (page == 1) & (F.length(body) < FRONT_PAGE_CHARS) & body.rlike("(?i)" + text.AUTHOR_WORDS)
    licence = (F.length(body) < LICENSE_CHARS) & body.rlike("(?i)" + text.LICENSE_WORDS)
    return F.when(author, "front_page_author_or_affiliation").when(licence, "license_or_release_metadata")


def in_reference_area(page: Column, y: Column, first_page: Column, first_y: Column, last_page: Column, slack: float = 0.02) -> Column:
    """Whether a block lies in the span of the reference list: strictly inside, or below its start on the first page."""
    return ((page > first_page) & (page <= last_page)) | ((page == first_page) & (y >= first_y - slack))


def evidence_units(body: Column, least: int = 8) -> Column:
    """Units between sentence marks and line ends; decimals stay whole, and units of ``least`` characters or fewer join the one before."""
    parts = F.split(body, r"(?<=[。！？；;：:\n])|(?<=[.!?])(?!(?<=\d[.!?])\d)")
    units = F.filter(F.transform(parts, lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    joined = lambda acc, x: F.when((F.size(acc) > 0) & (F.length(x) <= least), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.get(acc, F.size(acc) - 1), x)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(units, F.array().cast("array<string>"), joined)


def label_of(value: Column) -> Column:
    """0 for match, 1 for mismatch; null for anything else."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("0", "true", "match", "matched"), 0).when(v.isin("1", "false", "mismatch", "not matched"), 1)


def predicted_label(result: Column, final_match: Column, final_score: Column, threshold: float) -> Column:
    """The result goes before the match flag, and that before the score, which matches from the threshold on."""
    by_score = F.when(F.coalesce(final_score.cast("double"), F.lit(0.0)) >= threshold, 0).otherwise(1)
    return F.when(result.isNotNull(), label_of(result)).when(final_match.isNotNull(), F.when(final_match, 0).otherwise(1)).otherwise(by_score)
