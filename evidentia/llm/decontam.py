"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are compared as sequences of lower-case words. Every run of ``SEED`` words of a benchmark item is a seed;
a seed is rare if its words alone make it unlikely by chance: the product of their shares in the corpus, times
the corpus's number of words, is under ``CHANCE`` expected occurrences per million words. (A passage may be
copied any number of times without its seeds becoming common.) Items left without a rare seed use all their
seeds. Where a document has seeds of an item, the passages around them are aligned with the item by local
alignment over words, in which two words that differ in few letters count in part, so that edited copies still
score; the score is the share of the item's best possible score. An item matches from ``THRESHOLD`` on.

Word counts and matching read whole texts of all documents. The seeds are sent to all executors while there
are at most ``BROADCAST_SEEDS`` of them; a larger benchmark is split into parts that are scanned in turn.

In scripts without blanks between words every letter is a word.

Cases: null and empty texts, on either side, match nothing; items of fewer than ``SEED`` words are one seed, and
are not looked for if all their words are common (``SHORT_COUNT``), as any text may hold them;
the distinct texts of one item id are aligned each by itself, and the id counts once, with the best of their scores
and the seeds hit of all; repeated documents are matched each, as are those with a null doc_id; an empty benchmark
or corpus gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read, with_id, with_null_id

SEED = 3
CHANCE = 0.05
THRESHOLD = 0.45
BROADCAST_SEEDS = 2_000_000
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
_WORDS = re.compile(r"[^\W_]+")
#: Letters of scripts that set no blanks between words (kana, Han, Thai, Lao, Burmese, Khmer): each is a word of its own.
_UNSPACED = "\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_MIXED = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")
#: Items of fewer than SEED words count as copied only if their rarest word occurs at most so often in the corpus, and so often per million words.
SHORT_COUNT, SHORT_PER_MILLION = 3, 1


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (_WORDS if text.isascii() or not _ANY_UNSPACED.search(text) else _MIXED).findall(text)


def similar(a: str, b: str) -> float:
    """What an aligned pair of words scores: MATCH if equal, half of it if they share an end and most letter pairs, else MISMATCH."""
    if a == b:
        return MATCH
    if (a[0] != b[0] and a[-1] != b[-1]) or abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4:
        return MISMATCH
    x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return MATCH / 2 if 2 * len(x & y) >= 1.2 * (len(x) + len(y)) / 2 else MISMATCH


def align(item: list[str], passage: list[str], memo: dict | None = None) -> tuple[float, int, int]:
    """Smith-Waterman over words: the best local score, and where in the passage it starts and ends (exclusive)."""
    memo = {} if memo is None else memo
    best, where = 0.0, (0, 0)
    above: list[tuple[float, int]] = [(0.0, 0)] * (len(passage) + 1)
    for a in item:
        row, left = [(0.0, 0)], (0.0, 0)
        corner = above[0]
        for j, b in enumerate(passage):
            if a == b:
                gain = MATCH
            elif a[0] != b[0] and a[-1] != b[-1]:
                gain = MISMATCH
            elif (gain := memo.get((a, b))) is None:
                gain = memo[a, b] = similar(a, b)
            start = corner[1] if corner[0] > 0 else j
            cell = (corner[0] + gain, start)
            corner = above[j + 1]
            if corner[0] + GAP > cell[0]:
                cell = (corner[0] + GAP, corner[1])
            if left[0] + GAP > cell[0]:
                cell = (left[0] + GAP, left[1])
            if cell[0] <= 0:
                cell = (0.0, j + 1)
            elif cell[0] > best:
                best, where = cell[0], (cell[1], j + 1)
            row.append(cell)
            left = cell
        above = row
    return best, *where


@dataclass
class Seeds:
    """``vocabulary``: word to number from 1; ``seeds``: numbers of SEED words to (item, place) pairs; ``items``: key to words; ``ids``: key to item id."""

    vocabulary: dict[str, int]
    seeds: dict[tuple, list[tuple[int, int]]]
    short: dict[tuple, list[int]]
    items: dict[int, list[str]]
    ids: dict[int, int]


def _word_counts(documents: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How often the benchmark's words occur in the corpus, and the corpus's words in all. Counts combine per batch."""
    wanted = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, count, total = wanted.value, Counter(), 0
        for b in batches:
            for t in b["text"]:
                if t:
                    own = words_of(t)
                    total += len(own)
                    count.update(filter(known.__contains__, own))
        yield pd.DataFrame({"word": ["", *count.keys()], "n": [total, *count.values()]})

    counted = documents.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # one row per word of the benchmark at most
    return found, found.pop("", 0)


def make_seeds(items: dict[int, list[str]], counts: dict[str, int], total: int, seed: int = SEED, chance: float = CHANCE, ids: dict[int, int] | None = None) -> Seeds:
    """``ids`` tells the item id of each key of ``items`` where these are not ids themselves."""
    vocabulary = {w: k for k, w in enumerate(sorted({w for ws in items.values() for w in ws}), 1)}
    share = {w: (counts.get(w, 0) + 1) / (total + 1) for w in vocabulary}
    out = Seeds(vocabulary, {}, {}, items, ids or {k: k for k in items})
    for item, ws in items.items():
        if len(ws) < seed:
            if ws and min(counts.get(w, 0) for w in ws) <= SHORT_COUNT + SHORT_PER_MILLION * total / 1e6:
                out.short.setdefault(tuple(vocabulary[w] for w in ws), []).append(item)
            continue
        runs = [(k, ws[k : k + seed]) for k in range(len(ws) - seed + 1)]

        def expected(run: list[str]) -> float:
            p = 1e6
            for w in run:
                p *= share[w]
            return p

        rare = [r for r in runs if expected(r[1]) < chance] or runs
        for k, run in rare:
            out.seeds.setdefault(tuple(vocabulary[w] for w in run), []).append((item, k))
    return out


class Matcher:
    """Finds the items that a text holds, with their scores and places."""

    def __init__(self, seeds: Seeds, seed: int = SEED, threshold: float = THRESHOLD, memory: int = 50_000):
        self.s, self.seed, self.threshold, self.memory = seeds, seed, threshold, memory
        self.word_memo: dict = {}
        self.scores: dict = {}

    def score(self, item: int, passage: tuple[str, ...]) -> tuple[float, int, int]:
        """Alignment of an item with a passage; repeated passages are remembered."""
        key = (item, passage)
        if (known := self.scores.get(key)) is None:
            if len(self.scores) > self.memory:
                self.scores.clear()
            if len(self.word_memo) > 20 * self.memory:
                self.word_memo.clear()
            raw, a, b = align(self.s.items[item], list(passage), self.word_memo)
            known = self.scores[key] = (raw / (MATCH * len(self.s.items[item])), a, b)
        return known

    def matches(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item id, score, first word, last word exclusive, seeds hit) per matching item id: the best passage of its texts."""
        words = words_of(text)
        get, n = self.s.vocabulary.get, self.seed
        ids = [get(w, 0) for w in words]
        known = np.array(ids, dtype=np.int64) > 0
        runs = known[: max(0, len(ids) - n + 1)].copy()
        for i in range(1, n):
            runs &= known[i : i + len(runs)]
        hits: dict[int, list[tuple[int, int]]] = {}
        seeds = self.s.seeds
        for k in np.flatnonzero(runs).tolist():  # runs of words that the benchmark knows
            if (found := seeds.get(tuple(ids[k : k + n]))) is not None:
                for item, place in found:
                    hits.setdefault(item, []).append((k, place))
        out = []
        for run, items in self.s.short.items():
            for k in range(len(ids) - len(run) + 1):
                if tuple(ids[k : k + len(run)]) == run:
                    out += [(item, 1.0, k, k + len(run), 1) for item in items]
                    break
        for item, places in hits.items():
            size = len(self.s.items[item])
            slack = 3 + size // 4
            best, end = (0.0, 0, 0), -1
            lo = hi = None
            spans = []
            for k, place in sorted(places):
                a, b = max(0, k - place - slack), min(len(words), k - place + size + slack)
                if lo is None or a > hi:
                    if lo is not None:
                        spans.append((lo, hi))
                    lo, hi = a, b
                else:
                    hi = max(hi, b)
            spans.append((lo, hi))
            for lo, hi in spans:
                step = 4 * size + 4 * slack  # long spans of overlapping hits are aligned in overlapping parts
                for at in range(lo, hi, max(1, step // 2)):
                    score, a, b = self.score(item, tuple(words[at : min(hi, at + step)]))
                    if score > best[0]:
                        best = (score, at + a, at + b)
                    if at + step >= hi:
                        break
            if best[0] >= self.threshold:
                out.append((item, *best, len(places)))
        return self.by_id(out, hits)

    def by_id(self, found: list[tuple], hits: dict[int, list]) -> list[tuple[int, float, int, int, int]]:
        """The best of the matches of each item id's texts, with the seeds hit of all of these."""
        ids, best, n = self.s.ids, {}, Counter()
        for item, score, a, b, own in found:
            if item not in hits:
                n[ids[item]] += own
            best[ids[item]] = max(best.get(ids[item], (0.0, 0, 0)), (score, -a, -b))
        for item, places in hits.items():
            n[ids[item]] += len(places)
        return sorted((item, score, -a, -b, n[item]) for item, (score, a, b) in best.items())


_SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long, seeds_hit long"


def find_contamination(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, score, the passage's words, seeds hit."""
    spark = documents.sparkSession
    sized = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text")
    weight = sized.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-weight // BROADCAST_SEEDS))
    out = None
    for part in range(parts):
        own = sized if parts == 1 else sized.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        texts = sorted({(r["item_id"], tuple(words_of(r["text"]))) for r in own.collect()})  # at most about BROADCAST_SEEDS words
        items = {k: list(ws) for k, (_, ws) in enumerate(texts)}
        ids = {k: item for k, (item, _) in enumerate(texts)}
        counts, total = _word_counts(documents, {w for ws in items.values() for w in ws})
        seeds = spark.sparkContext.broadcast(make_seeds(items, counts, total, ids=ids))

        def run(batches: Iterator[pd.DataFrame], seeds=seeds) -> Iterator[pd.DataFrame]:
            matcher = Matcher(seeds.value, threshold=threshold)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b["doc_id"], b["text"], strict=True) for m in matcher.matches(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "last_word", "seeds_hit"])

        found = with_null_id(with_id(documents).mapInPandas(run, _SCHEMA))
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    hit = cut(find_contamination(documents, benchmark, threshold).select("doc_id").distinct())
    return documents.join(hit, documents["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
