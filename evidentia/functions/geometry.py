"""Boxes on pages as columns: normal form, overlap and distances. A box is an array (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_at = lambda b, k: F.get(b, F.lit(k))


def normal_box(b: Column, keep_flat: bool = False) -> Column:
    """A box on the scale 0 to 1; boxes on 0 to 1000 are told by a value over 1.5. Boxes without extent are null, unless kept."""
    # Written out by corner, so that it stays in generated code.
    scale = F.when(F.greatest(*[F.abs(_at(b, k)) for k in range(4)]) > 1.5, 1000.0).otherwise(1.0)
    scaled = F.array(*[_at(b, k) / scale for k in range(4)])
    fine = F.size(b) == 4
    return F.when(fine if keep_flat else fine & (_at(b, 2) > _at(b, 0)) & (_at(b, 3) > _at(b, 1)), scaled)


def iou(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(_at(a, hi), _at(b, hi)) - F.greatest(_at(a, lo), _at(b, lo)))
    area = lambda x: (_at(x, 2) - _at(x, 0)) * (_at(x, 3) - _at(x, 1))
    both = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def largest_delta(a: Column, b: Column) -> Column:
    return F.greatest(*[F.abs(_at(a, k) - _at(b, k)) for k in range(4)])


def overlap_share(a: Column, b: Column) -> Column:
    """Shared width, as a share of the narrower box (of a width of 1 at least); 0 without two boxes."""
    width = F.greatest(F.lit(0.0), F.least(_at(a, 2), _at(b, 2)) - F.greatest(_at(a, 0), _at(b, 0)))
    least = F.greatest(F.lit(1.0), F.least(_at(a, 2) - _at(a, 0), _at(b, 2) - _at(b, 0)))
    return F.when((F.size(a) >= 4) & (F.size(b) >= 4), width / least).otherwise(0.0)


def vertical(a: Column, b: Column) -> Column:
    """(relation, distance) of box a to box b: above, below, overlap, or unknown without two boxes."""
    pair = lambda r, d: F.struct(F.lit(r).alias("relation"), d.cast("double").alias("distance"))
    known = (F.size(a) >= 4) & (F.size(b) >= 4)
    return (
        F.when(~F.coalesce(known, F.lit(False)), pair("unknown", F.lit(None)))
        .when(_at(a, 3) <= _at(b, 1), pair("above", _at(b, 1) - _at(a, 3)))
        .when(_at(a, 1) >= _at(b, 3), pair("below", _at(a, 1) - _at(b, 3)))
        .otherwise(pair("overlap", F.lit(0.0)))
    )
