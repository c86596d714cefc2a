"""Pattern packing: few-document length patterns, fitted to the length histogram by non-negative least squares.

Texts become token ids; a document's ids end with a separator. Only documents longer than a sequence are cut.
The histogram of piece lengths has at most one count per length, so the plan is made on the driver from
bounded data, whatever the corpus holds: patterns of up to three lengths that fill a sequence exactly are
enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded down within
what is there; pieces left over are packed best-fit, whole patterns at a time. Pieces then find their place by
their rank among pieces of their length, which is counted per salt, so no length gathers in one task.

Cases: a null or empty text is one piece with the separator alone; a text of any length is tokenized whole;
repeated rows are packed each, as are rows with a null doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, read, with_id, with_null_id

# What the vocabulary's normalization leaves as it is and what its pattern cuts into runs of letters, digits, runs of marks.
# Apostrophes (contractions) and "<" (control tokens) are left to the tokenizer itself.
_PLAIN = re.compile(r"[!-&(-;=-@\[-~\xdf-\xf6\xf8-\xff]+")
_PIECE = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level vocabularies name a printable byte by its own character, the others in order by those from 256 on.
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_ROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
SEPARATOR = b"\0\0\0\0"  # id 0, as four little-endian bytes


class ChunkTokenizer:
    """Token ids as little-endian bytes. Remembers white-space chunks, since no token of the vocabulary crosses white space.

    What is remembered is bounded by ``memory`` bytes; chunks over ``longest`` bytes are tokenized each time.
    """

    ENTRY = 180  # bytes that an entry takes beside its text and ids, about

    def __init__(self, path: str, memory: int = 150_000_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory, self.longest, self.seen, self.used = Tokenizer.from_file(path), memory, longest, {}, 0
        self.model = self.tokenizer.model

    def plain(self, chunk: str, new: dict[bytes, bytes]) -> bytes:
        """The ids of a chunk that normalization leaves alone: its pieces go to the vocabulary's merges directly."""
        out = []
        for piece in _PIECE.findall(chunk):
            key = piece.encode()
            if (ids := new.get(key) or self.seen.get(key)) is None:
                ids = new[key] = array("I", [t.id for t in self.model.tokenize(key.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            out.append(ids)
        return b"".join(out)

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """The ids of ``chunks``; those that are short are remembered."""
        new, whole = {}, []
        for c in chunks:
            if _PLAIN.fullmatch(text := c.decode()):
                new[c] = self.plain(text, new)
            else:
                whole.append(c)
        for at in range(0, len(whole), 20_000):
            part = whole[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
            new.update((c, array("I", e.ids).tobytes()) for c, e in zip(part, found, strict=True))
        if self.used > self.memory:
            self.seen.clear()
            self.used = 0
        short = {c: ids for c, ids in new.items() if len(c) <= self.longest}
        self.seen.update(short)
        self.used += sum(len(c) + len(ids) + self.ENTRY for c, ids in short.items())
        return new

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        # The vocabulary is lower case; marks of control tokens are not, so texts that may hold one stay as they are.
        get, found, missing = self.seen.get, [], set()
        for t in texts:
            chunks = (t.encode() if "<|" in t else t.encode().lower()).split() if t else []
            ids = list(map(get, chunks))
            holes = [(k, chunks[k]) for k, x in enumerate(ids) if x is None] if None in ids else []
            missing.update(c for _, c in holes)
            found.append((ids, holes))
        new = self.learn(missing) if missing else {}
        for ids, holes in found:
            for k, c in holes:
                ids[k] = new[c]
            yield b"".join(ids)


_tokenizers: dict[str, ChunkTokenizer] = {}


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token pieces of at most ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = ChunkTokenizer(tokenizer_path)
        tokenizer = _tokenizers[tokenizer_path]
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                columns = [[] for _ in range(5)]
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist()), strict=True):
                    ids += SEPARATOR
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        for column, x in zip(columns, (doc_id, k, a // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ROW.types, strict=True)], schema=_ROW)

    return with_id(documents).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def enumerate_patterns(histogram: np.ndarray, stride: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, with a + b + c the capacity and every length in the histogram.

    All single and paired lengths are there; of triples, those whose second length is on a grid of ``stride``.
    """
    full = len(histogram) - 1
    a = np.arange(1, full + 1)
    pairs = np.stack([a, full - a, np.zeros_like(a)], axis=1)
    first, second = np.meshgrid(a, np.arange(stride, full, stride))
    triples = np.stack([first.ravel(), second.ravel(), full - first.ravel() - second.ravel()], axis=1)
    rows = np.concatenate([pairs[pairs[:, 0] >= pairs[:, 1]], triples[(triples[:, 0] >= triples[:, 1]) & (triples[:, 1] >= triples[:, 2]) & (triples[:, 2] > 0)]])
    there = np.concatenate([[True], histogram[1:] > 0])
    return rows[there[rows].all(axis=1)]


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram, by accelerated projected gradients.

    Long lengths weigh more: short pieces fit in anywhere later, long ones do not.
    """
    if not len(patterns):
        return np.zeros(0)
    n = len(histogram)
    weight = np.sqrt(np.arange(n) / n)
    weight[0] = 0.0
    used = weight[patterns]
    bound = np.bincount(patterns.ravel(), weights=(used**2).ravel(), minlength=n).max() * 3
    x = y = np.zeros(len(patterns))
    pace = 1.0
    for _ in range(steps):
        made = np.bincount(patterns.ravel(), weights=np.repeat(y, 3), minlength=n)
        miss = (made - histogram) * weight**2
        nxt = np.maximum(0.0, y - miss[patterns].sum(axis=1) / bound)
        new_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y, x, pace = nxt + (pace - 1) / new_pace * (nxt - x), nxt, new_pace
    return x


@dataclass
class Plan:
    """Slots by length: pieces of ``length`` with ranks from ``rank`` on go to sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def make_plan(histogram: np.ndarray, stride: int = 32) -> Plan:
    """Packs a histogram (counts by length, index 0 unused) into sequences of the capacity, its last index."""
    left, full = histogram.astype(np.int64).copy(), len(histogram) - 1
    given, slots, sequences = np.zeros(full + 1, dtype=np.int64), [], 0

    def take(lengths, times: int) -> None:
        nonlocal sequences
        at = 0
        for ell in lengths:
            slots.append((ell, int(given[ell]), sequences, at))
            given[ell] += times
            left[ell] -= times
            at += ell
        sequences += times

    if left[full]:
        take([full], int(left[full]))
    patterns = enumerate_patterns(left, stride)
    counts = fit_counts(patterns, left)
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] < 1:
            break
        lengths = [int(v) for v in patterns[k] if v]
        times = min([int(counts[k]), *(int(left[v]) // lengths.count(v) for v in set(lengths))])
        if times > 0:
            take(lengths, times)
    below = np.arange(full + 1)  # below[v]: the longest remaining length of at most v, by path halving

    def longest(v: int) -> int:
        while v > 0 and not left[v]:
            below[v] = below[below[v] - 1] if below[v] == v else below[below[v]]
            v = int(below[v])
        return v

    while top := longest(full):
        lengths, room, planned = [top], full - top, {top: 1}
        while room > 0:
            v = longest(room)
            while v and planned.get(v, 0) >= left[v]:
                v = longest(v - 1)
            if not v:
                break
            lengths.append(v)
            planned[v] = planned.get(v, 0) + 1
            room -= v
        take(lengths, min(int(left[v]) // n for v, n in planned.items()))
    own = np.array(slots, dtype=np.int64).reshape(-1, 4)
    own = own[np.lexsort((own[:, 1], own[:, 0]))]
    return Plan(own[:, 0], own[:, 1], own[:, 2], own[:, 3], sequences)


def pack(made: DataFrame, capacity: int = 2048, rows_per_salt: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``; ``made`` should be cut, as it is read three times."""
    spark = made.sparkSession
    total = made.count()
    salts = max(16, total // rows_per_salt)
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length at most
        histogram[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(make_plan(histogram))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(order) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before")).drop("salt", "own", "before")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        keys = (p.length << 44) + p.rank
        for b in batches:
            at = np.searchsorted(keys, (b["length"].to_numpy() << 44) + b["rank"].to_numpy(), side="right") - 1
            yield b.assign(sequence_id=p.sequence[at] + b["rank"].to_numpy() - p.rank[at], offset=p.offset[at])[names]

    return with_null_id(ranked.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    return pack(cut(pieces(documents, tokenizer_path, capacity)), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), default_tokenizer())
