"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints of 64 bits are cut into segments of two bits; a segment's popcount (0, 1 or 2) is a coordinate.
The Manhattan distance of two embeddings never exceeds the Hamming distance, so it is a lower bound by which
candidates are found: of two fingerprints within 4 bits, one half of 16 coordinates is within Manhattan
distance 2. On the unit grid over a half, every fingerprint is entered in its own cell and in all cells at
distance 1, so such a pair shares a cell. Pairs that share a cell are verified exactly on the bits.

Cells never emit all pairs. Documents of one fingerprint are one member. Rows come sorted by cell, so a task
holds one cell at a time; in a large cell, members are first compared with the cell's first, and after that
only members outside its largest component with the members of other components. Every pair in a cell is thus
either in one component already or verified, and a cell emits links that span its components, one less than
its members at most. The components over all cells are those of all links.

Cases: null texts and texts without a word have fingerprint 0 and link like any other; texts are read whole;
a null doc_id
counts as the smallest; repeated rows (the same doc_id twice) give one row each, with the same result if their texts agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NO_ID, components, cut, read, with_id, with_null_id

RADIUS = 4
SHINGLE = 4
SEED = 42
_UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER)) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    stops = (ends[width - 1 :] - 1).tolist()
    for at in range(0, len(starts), 65536):  # bounded memory for very long texts
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)})

    return with_id(documents).mapInPandas(run, "doc_id long, fp long")


def _low_bits(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0x5555555555555555))


def embedding(fp: Column) -> Column:
    """32 popcounts of two-bit segments, two bits each, packed in a long: segment k in bits 2k and 2k+1.

    As plain bit arithmetic: the sum of both bits of every segment, without carries between segments.
    """
    a, b = _low_bits(fp), _low_bits(F.shiftrightunsigned(fp, 1))
    both, one = a.bitwiseAND(b), a.bitwiseXOR(b)
    return F.shiftleft(both, 1).bitwiseOR(one)


def cells(fp: Column) -> Column:
    """The grid cells of both halves in which a fingerprint is entered: its own and those at distance 1.

    A cell is a long: the half's 16 popcounts in the low 32 bits, the half's number above.
    """
    def of_half(half: int) -> Column:
        own = F.shiftrightunsigned(embedding(fp), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        parts = [F.array(own)]
        for k in range(16):
            count = F.shiftrightunsigned(own, 2 * k).bitwiseAND(F.lit(3))
            step = F.lit(1 << (2 * k))
            parts.append(F.array(F.when(count < 2, own + step), F.when(count > 0, own - step)))
        return F.transform(F.array_compact(F.flatten(F.array(*parts))), lambda c: c + F.lit(half << 32))

    return F.concat(of_half(0), of_half(1))


def cell_links(cell: np.ndarray, fp: np.ndarray, radius: int, small: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells, for rows sorted by cell with distinct fingerprints in each: spanning ones in large cells."""
    near = lambda a, b: np.bitwise_count(a ^ b) <= radius
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for d in range(1, small):  # cells of few members, all at once
        pair = (size_of[:-d] <= small) & (cell[d:] == cell[:-d]) if len(cell) > d else np.zeros(0, bool)
        at = np.flatnonzero(pair)
        at = at[near(fp[at], fp[at + d])]
        left.append(fp[at])
        right.append(fp[at + d])
    for k in np.flatnonzero(sizes > small):
        own = fp[starts[k] : starts[k] + sizes[k]]
        comp = np.arange(len(own))

        def compare(i: int, own=own, comp=comp) -> None:
            other = np.flatnonzero(comp != comp[i])
            hit = other[near(own[other], own[i])]
            for c in np.unique(comp[hit]):
                j = hit[comp[hit] == c][0]
                left.append(own[[i]])
                right.append(own[[j]])
                comp[comp == c] = comp[i]

        compare(0)
        main = np.bincount(comp).argmax()
        for i in np.flatnonzero(comp != main):
            compare(i)
    return np.concatenate(left), np.concatenate(right)


def link_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) for each distinct fp of ``prints`` that has a link within ``radius`` (4 at most)."""
    if radius > RADIUS:
        raise ValueError("the grid holds pairs up to 4 bits apart")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            cell = np.concatenate([cell, b["cell"].to_numpy()])
            fp = np.concatenate([fp, b["fp"].to_numpy().view(np.uint64)])
            whole = np.searchsorted(cell, cell[-1]) if len(cell) else 0  # the last cell may go on in the next batch
            if whole:
                left, right = cell_links(cell[:whole], fp[:whole], radius)
                yield pd.DataFrame({"a": left.view(np.int64), "b": right.view(np.int64)})
                cell, fp = cell[whole:], fp[whole:]
        if len(cell):
            left, right = cell_links(cell, fp, radius)
            yield pd.DataFrame({"a": left.view(np.int64), "b": right.view(np.int64)})

    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each row becomes many: small tables are not left in few tasks
    entered = prints.select("fp").distinct().repartition(spread, "fp").select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    ordered = entered.repartition("cell").sortWithinPartitions("cell", "fp")
    return components(ordered.select("cell", "fp").mapInPandas(run, "a long, b long"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    prints = cut(fingerprints(documents))
    roots = link_components(prints, radius)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(heads, "root").select("fp", "component_id")
    named = F.nullif("component_id", F.lit(NO_ID)).alias("component_id")
    return with_null_id(prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: The fingerprint in SQL has no XXH64, so the query is tested against brute force instead.
SQL = None
