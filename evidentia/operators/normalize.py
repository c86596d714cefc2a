"""One schema from records of several: key aliases, required ids, composite keys, prompts from templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import spans

# Keys under which sources name the same thing, first choice first.
PAPER_ID = ("paper_id", "slug", "document_id")
TABLE_ID = ("table_id", "id", "table_label")
TABLE_LABEL = ("table_label", "label", "canonical_label")
TABLE_CAPTION = ("table_caption", "caption")
TABLE_BODY = ("table_body", "body", "table_html")


def first_of(df: DataFrame, keys: tuple[str, ...], default: Column | None = None) -> Column:
    """The first of the columns ``keys`` that ``df`` has and that is not null."""
    there = [F.col(k) for k in keys if k in df.columns]
    return F.coalesce(*there, *([] if default is None else [default]), F.lit(None))


def required_id(df: DataFrame, keys: tuple[str, ...], context: str) -> Column:
    """``first_of`` as text; a row where it is null or blank fails the query with a message."""
    value = first_of(df, keys).cast("string")
    message = f"{context}: missing stable id ({', '.join(keys)})"
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def tables(raw: DataFrame) -> DataFrame:
    """Tables of any source with table_id, label, caption, body; the label falls back to the id, texts to empty ones."""
    own = required_id(raw, TABLE_ID, "table")
    named = raw.select(
        own.alias("table_id"), first_of(raw, TABLE_LABEL, own).cast("string").alias("label"),
        first_of(raw, TABLE_CAPTION, F.lit("")).alias("caption"), first_of(raw, TABLE_BODY, F.lit("")).alias("body"),
    )
    return named


def _offset_problem(size: Column, slice_: Column, start: Column, end: Column, text: Column) -> Column:
    """Null if ``text`` is the slice of a text of ``size`` characters between its offsets."""
    return F.when((start < 0) | (end <= start) | (end > size), "offset_out_of_range").when(~slice_.eqNullSafe(text), "text_is_not_slice")


def texts_with_offsets(raw: DataFrame) -> DataFrame:
    """``raw(parent_text, char_start, char_end, text)`` with ``problem``: offsets out of order or range, or a text that is not the slice."""
    c = F.col
    slice_ = F.substr(c("parent_text"), c("char_start") + 1, c("char_end") - c("char_start"))
    return raw.withColumn("problem", _offset_problem(F.length("parent_text"), slice_, c("char_start"), c("char_end"), c("text")))


def parents_with_offsets(parents: DataFrame) -> DataFrame:
    """``parents(parent_text, children array<struct<char_start, char_end, text>>)`` with ``problems``, one for each child as in ``texts_with_offsets``.

    A parent's text is read once for all its children, not once for each.
    """
    cut = parents.withColumn("_slices", spans.slices_udf("parent_text", F.col("children.char_start"), F.col("children.char_end")))
    problems = lambda size: F.zip_with("children", "_slices", lambda x, own: _offset_problem(size, own, x["char_start"], x["char_end"], x["text"]))
    once = F.transform(F.array(F.length("parent_text")), lambda size: problems(size))  # else the optimizer puts the measuring into the inner loop
    return cut.withColumn("problems", F.element_at(once, 1)).drop("_slices")


def composite_key(*parts: str) -> Column:
    """``a::b::c``; a null part is an empty one, so that keys of the same parts are equal."""
    return F.concat_ws("::", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def unique_texts(values: Column) -> Column:
    """Trimmed texts without blanks and repetitions, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def filled(template: str, **values: Column) -> Column:
    """A template with its ``{{name}}`` filled in; a name without a value is an error at once."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    if missing := set(parts[1::2]) - set(values):
        raise ValueError(f"unresolved placeholders: {sorted(missing)}")
    return F.concat(*[F.lit(x) if k % 2 == 0 else F.coalesce(values[x].cast("string"), F.lit("")) for k, x in enumerate(parts)])


def minimal_rows(rows: DataFrame, pair: bool) -> DataFrame:
    """What training needs of a row: id, label and text, or the two texts of a pair."""
    return rows.select("id", "label", *(["text_a", "text_b"] if pair else ["text"]))


def same_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): keys of one side only. No row means that the sets are equal."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.subtract(right).withColumn("problem", F.lit("missing")).unionByName(right.subtract(left).withColumn("problem", F.lit("unexpected")))


def workspace_path(path: Column, root: str) -> Column:
    """A legacy absolute path in the workspace at ``root``: what follows the workspace's own folder name; relative paths are put below it."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    tail = F.regexp_extract(path, rf"^/(?:.*/)?{re.escape(name)}/(.*)$", 1)
    return F.when(path.isNull() | (path == ""), None).when(tail != "", F.concat(F.lit(root.rstrip("/") + "/"), tail)).when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
