"""Spans of sentences with exact offsets: a native splitter, and an abbreviation-aware one as an Arrow UDF."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUNDARY = r"(?<=[.!?])(?=\s+[\"\x27(\[]*[A-Z0-9])"
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("al.", "approx.", "cf.", "dr.", "e.g.", "eq.", "eqs.", "etc.", "fig.", "figs.", "i.e.", "mr.", "mrs.", "ms.", "no.", "prof.", "sec.", "secs.", "st.", "tab.", "tbl.", "vs.")
_BOUNDARY = re.compile(BOUNDARY)
_CLOSERS, _ENDERS = "\"'’”)]}", "!?。！？"
_PARAGRAPH = re.compile(r"<\|(?:txt_)?split\|>|\n\s*\n", re.IGNORECASE)
_STOP = re.compile(rf"[{_ENDERS}.]")
_SHORT = re.compile(r"(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r"|(?:\b[a-z]\.){2,}|(?<![A-Za-z])[a-z]\.)\Z")
_AFTER = re.compile(rf"[{re.escape(_CLOSERS)}]*(?:\Z|[\r\n]|\s+(?:\Z|[^\W_]|[\"'(\[{{‘“]))")
_CLOSE = re.compile(rf"[{re.escape(_CLOSERS)}]*")


def sentence_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, char_start, char_end, span): native split at sentence ends; spans keep the blanks before them.

    Blank spans keep their numbers out of the result, so pos has gaps there. Offsets are code points.
    """
    parts = df.select(key, F.posexplode(F.split(text, BOUNDARY)).alias("pos", "span"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("char_start", F.coalesce(F.sum(F.length("span")).over(before), F.lit(0)).cast("int"))
    return placed.withColumn("char_end", F.col("char_start") + F.length("span")).where(F.length(F.trim(F.regexp_replace("span", r"(?U)\s+", " "))) > 0)


def _trimmed(text: str, start: int, end: int) -> list[tuple[int, int]]:
    part = text[start:end]
    a = start + len(part) - len(part.lstrip())
    b = end - (len(part) - len(part.rstrip()))
    return [(a, b)] if a < b else []


class _Places:
    """Where a text may be cut: after marks, and at blanks. Listed once, then looked up by bisection."""

    def __init__(self, text: str, marks: str, at_edge: bool):
        # A mark counts if blanks follow it within reach, or (``at_edge``) if it is the last character in reach.
        self.at_edge = at_edge
        self.marks = [m.start() for m in re.finditer(f"[{re.escape(marks)}]", text)]
        self.blanks = [(m.start(), m.end()) for m in re.finditer(r"\s+", text)]
        self.blank_starts = [a for a, _ in self.blanks]
        self.after = dict(self.blanks)

    def mark(self, lo: int, hi: int) -> int | None:
        """The end of the last mark, with its blanks, that begins and ends from ``lo`` to ``hi``."""
        for k in range(bisect_left(self.marks, hi) - 1, -1, -1):
            i = self.marks[k]
            if i < lo:
                return None
            if (i + 1 == hi and self.at_edge) or (i + 1 < hi and i + 1 in self.after):
                return min(hi, self.after.get(i + 1, hi))
        return None

    def blank(self, lo: int, hi: int) -> int | None:
        """The start of the last run of blanks in reach."""
        k = bisect_left(self.blank_starts, hi) - 1
        return max(lo, self.blanks[k][0]) if k >= 0 and self.blanks[k][1] > lo else None


def cut_long(text: str, start: int, end: int, target: int, marks: str, on_blank: bool) -> list[tuple[int, int]]:
    """Cuts a span near ``target``: after the last of ``marks`` between 65 and 125 % of it, else (``on_blank``) at a blank or hard."""
    if end - start <= target:
        return [(start, end)]
    places = _Places(text[start:end], marks, at_edge=not on_blank)
    edges, size = [0], end - start
    while size - edges[-1] > target:
        lo, hi = edges[-1] + max(1, target * 65 // 100), min(size, edges[-1] + target * 125 // 100)
        stop = places.mark(lo, hi)
        if stop is None and not on_blank:
            break
        if stop is None:
            stop = places.blank(lo, hi)
        edges.append(stop if stop is not None else min(size, edges[-1] + target))
    return [(start + a, start + b) for a, b in pairwise([*edges, size])]


def long_spans_v1(text: str, target: int = 480) -> list[tuple[int, int]]:
    """Sentence spans, those over ``target`` cut after commas and semicolons."""
    edges = sorted({0, len(text), *(m.start() for m in _BOUNDARY.finditer(text))})
    return [x for a, b in pairwise(edges) for x in cut_long(text, a, b, target, ";,", False) if text[slice(*x)].strip()]


def sentence_ends(text: str) -> list[int]:
    """Offsets after which a new sentence begins: behind a stop and what closes after it.

    ``!`` and ``?`` (also full width) always end one. A full stop does unless it is a decimal point, belongs to an
    abbreviation or initial, or what follows does not begin anew.
    """
    ends = []
    for m in _STOP.finditer(text):
        i = m.start()
        if m[0] == ".":
            known = _SHORT.search(text[max(0, i - 39) : i + 1].casefold())
            decimal = text[i - 1 : i].isdigit() and text[i + 1 : i + 2].isdigit()
            if decimal or known or not _AFTER.match(text, i + 1):
                continue
        ends.append(_CLOSE.match(text, i + 1).end())
    return ends


def spans_v2(text: str | None, target: int = 700) -> list[tuple[int, int]]:
    """Paragraphs, then sentences (abbreviations and CJK stops known), then long ones near ``target``; trimmed offsets.

    All edges are listed first: paragraph marks with both their ends, and the ends of sentences between them.
    """
    text = text or ""
    breaks = [0, *(x for m in _PARAGRAPH.finditer(text) for x in m.span()), len(text)]
    ends, out = sentence_ends(text), []
    for lo, hi in zip(breaks[::2], breaks[1::2], strict=True):
        inner = ends[bisect_right(ends, lo) : bisect_left(ends, hi)]
        for a, b in pairwise([lo, *inner, hi]):
            for x, y in _trimmed(text, a, b):
                out += [z for own in cut_long(text, x, y, target, ";,:；，", True) for z in _trimmed(text, *own)]
    return out


_FIELDS = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
SPAN_TYPE = T.ArrayType(T.StructType(_FIELDS))
TEXT_SPAN_TYPE = T.ArrayType(T.StructType([*_FIELDS, T.StructField("text", T.StringType())]))
# Fixed value: characters of texts whose spans are held in Python at once; a longer text is held alone.
MOST_CHARS = 1 << 18


def _pieces(*columns: pa.Array) -> Iterator[list[tuple]]:
    """Rows of the columns, the first of them texts, in lists of about MOST_CHARS characters."""
    rows, size = [], 0
    for row in zip(*columns, strict=True):
        rows.append(tuple(x.as_py() for x in row))
        size += len(rows[-1][0] or "") + 1
        if size >= MOST_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _listed(values: list[list], array: Callable[[list], pa.Array]) -> pa.Array:
    """A list array of ``values``, whose elements ``array`` makes one after the other."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), array([x for own in values for x in own]))


def _udf(split, with_text: bool = False):
    """Spans of texts as Arrow arrays. Batches go out in pieces, so that the memory held does not follow the batch's size."""

    def array(flat: list[tuple]) -> pa.Array:
        columns = [pa.array([x[k] for x in flat], kind) for k, kind in enumerate([pa.int32(), pa.int32(), pa.string()][: 2 + with_text])]
        return pa.StructArray.from_arrays(columns, names=["start", "end", "text"][: 2 + with_text])

    @F.arrow_udf(TEXT_SPAN_TYPE if with_text else SPAN_TYPE)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for rows in _pieces(texts):
                yield _listed([[(a, b, t[a:b]) if with_text else (a, b) for a, b in split(t)] for t in (t or "" for (t,) in rows)], array)

    return spans


spans_v1_udf, spans_v2_udf, text_spans_v2_udf = _udf(long_spans_v1), _udf(spans_v2), _udf(spans_v2, with_text=True)


@F.arrow_udf(T.ArrayType(T.StringType()))
def slices_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The slices of each text from ``starts`` to ``ends``, two arrays of as many offsets; null where an offset or the text is."""
    for columns in batches:
        for rows in _pieces(*columns):
            yield _listed([[None if None in (t, a, b) else t[max(a, 0) : max(b, 0)] for a, b in zip(starts or [], ends or [], strict=True)] for t, starts, ends in rows], lambda flat: pa.array(flat, pa.string()))


def children(parents: DataFrame, spans: Column | None = None) -> DataFrame:
    """Child rows of ``parents(parent_id, full_text)``: ids, offsets, text and hash. The text is the slice at its offsets.

    It is cut where the spans are found; ``spans`` without texts are cut here, which reads a text once for each of its spans.
    """
    found = text_spans_v2_udf("full_text") if spans is None else spans
    own = parents.select("parent_id", "full_text", F.posexplode(found).alias("k", "s"))
    text = F.col("s.text") if spans is None else F.substr(F.col("full_text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    child = F.format_string("%s-child-%04d", F.col("parent_id"), F.col("k") + 1)
    return own.select("parent_id", child.alias("child_id"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), text.alias("text")).withColumn("text_sha256", F.sha2("text", 256))
