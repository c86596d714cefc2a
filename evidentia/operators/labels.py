"""Labels of tables in captions and prose: grammar, canonical form, titles, and which text is a caption."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What introduces a table's label, its number, and what may follow.
PREFIX = r"extended\s+data\s+table|supplementary\s+table|supplemental\s+table|table|tab\.?"
NUMBER = r"S?\d+[A-Za-z]?|[A-Z]\.?\d+[A-Za-z]?"
FOLLOWS = r"(?=\s*[:：.\-–—)]|\s|$)"
LABEL = rf"(?iu)\b(?:{PREFIX})\s*(?:{NUMBER}|[IVXLCDM]+){FOLLOWS}|表\s*(?:{NUMBER}){FOLLOWS}"
STRICT_START, LOOSE_START = 5, 25


def labels(text: Column) -> Column:
    """All labels in a text, as written."""
    return F.regexp_extract_all(text, F.lit(LABEL), F.lit(0))


def number_of(label: Column) -> Column:
    return F.regexp_replace(label, rf"(?iu)^(?:{PREFIX}|表)\s*", "")


def canonical(label: Column) -> Column:
    """``Table`` and the number; one dot in a number of up to three characters goes."""
    n = number_of(label)
    dots = F.length(n) - F.length(F.replace(n, F.lit("."), F.lit("")))
    return F.concat(F.lit("Table "), F.when((F.length(n) <= 3) & (dots == 1), F.replace(n, F.lit("."), F.lit(""))).otherwise(n))


def same_label(a: Column, b: Column) -> Column:
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return bare(a) == bare(b)


def segments(text: Column) -> Column:
    """(label, title) for each label: its title runs up to the next label. White space is one blank."""
    marked = F.regexp_replace(text, rf"(?={LABEL.replace('(?iu)', '')})".join(["(?iu)", ""]), "\u0001")
    parts = F.slice(F.split(marked, "\u0001"), 2, 1_000_000)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, LABEL, 0).alias("label"), F.trim(F.regexp_replace(p, r"\s+", " ")).alias("title")))


def caption_like(text: Column) -> Column:
    """Whether a text reads as a caption: it begins with what introduces a label, and the label is near its start."""
    start = F.regexp_instr(text, F.lit(LABEL)) - 1
    strict = (start <= STRICT_START) & text.rlike(rf"(?iu)^\s*(?:{PREFIX}|表)\b")
    loose = (start <= LOOSE_START) & text.rlike(r"(?iu)^\s*(\(?[a-z]\)\s*)?(extended|supplementary|supplemental|table|tab\.?|表)")
    return F.coalesce((start >= 0) & (strict | loose), F.lit(False))


def caption_labels(caption: Column) -> Column:
    """Labels ``Table n`` or ``Figure n`` of a caption, tables first choice: figures only where no table is named."""
    found = lambda kinds: F.regexp_extract_all(caption, F.lit(rf"(?i)\b(?:{kinds})\s*([A-Za-z]?\d+[A-Za-z]?)"), F.lit(1))
    tables, figures = found(r"Table|Tab\."), found(r"Figure|Fig\.")
    named = lambda a, kind: F.transform(a, lambda n: F.concat(F.lit(kind), n))
    return F.when(F.size(tables) > 0, named(tables, "Table ")).otherwise(named(figures, "Figure "))


def unused_label(caption: Column, used: Column, number: Column) -> Column:
    """The first label of a caption that ``used`` (array) lacks, else its last, else ``Table`` and the block's number."""
    own = caption_labels(caption)
    free = F.filter(own, lambda x: ~F.array_contains(used, x))
    return F.coalesce(F.get(free, F.lit(0)), F.get(own, F.size(own) - 1), F.concat(F.lit("Table "), number.cast("string")))
