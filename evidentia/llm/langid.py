"""Language ID by word-first backoff.

A model holds, per language, log frequencies of its commonest words and of character n-grams of 4 down to 1
(words are framed by spaces). A word the model knows scores by its log frequencies; any other word backs off
to its longest n-grams of which the model knows one, and scores by their mean. A document's scores are summed
over all its words; the language with the largest sum wins and ``score`` is its share after tempering.

The fit takes a bounded sample of labelled documents outside the held-out fold (``max_docs``, those of least
id hash) and keeps at most ``max_entries`` words and n-grams per language and order, so a model's size is
bounded. Predictions see the text alone.

Cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language first in the
alphabet; texts of any length are read whole; with nothing to learn from, all is ``und``. A repeated row is
predicted each time; a null doc_id is not held out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LETTER_RUN, fold_of, held_out, read

ORDERS = (4, 3, 2, 1)


@dataclass(frozen=True)
class LanguageModel:
    """``tables[0]`` is for words, ``tables[n]`` for n-grams: text to a tuple of log frequencies by language."""

    langs: tuple[str, ...]
    tables: dict[int, dict[str, tuple[float, ...]]]


def fit(documents: DataFrame, max_docs: int = 4000, max_entries: int = 20000) -> LanguageModel:
    """Learns from text and non-null lang of documents outside fold 0."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    chosen = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).distinct()
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    words = (
        sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("gram"))
        .where("gram <> ''").groupBy("lang", "gram").agg(F.count("*").alias("c")).withColumn("n", F.lit(0))
    )
    framed = F.concat(F.lit(" "), F.col("gram"), F.lit(" "))
    pieces = F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(1), F.length(framed) - n + 1), lambda i, n=n: F.struct(F.substr(framed, i, F.lit(n)).alias("gram"), F.lit(n).alias("n")))
        for n in ORDERS
    ]))
    grams = words.select("lang", "c", F.explode(pieces).alias("p")).groupBy("lang", "p.gram", "p.n").agg(F.sum("c").alias("c"))
    best = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram")
    kept = words.where("c > 1").unionByName(grams).withColumn("r", F.row_number().over(best)).where(F.col("r") <= max_entries)
    return model_of([(r["lang"], r["n"], r["gram"], r["c"]) for r in kept.select("lang", "n", "gram", "c").collect()])


def model_of(counts: list[tuple[str, int, str, int]]) -> LanguageModel:
    langs = tuple(sorted({lang for lang, *_ in counts}))
    place = {lang: k for k, lang in enumerate(langs)}
    tables: dict[int, dict] = {}
    for n in (0, *ORDERS):
        raw: dict[str, list[float]] = {}
        for lang, m, gram, c in counts:
            if m == n:
                raw.setdefault(gram, [0.0] * len(langs))[place[lang]] += c
        totals = [sum(v[k] for v in raw.values()) for k in range(len(langs))]
        v = max(1, len(raw))
        tables[n] = {g: tuple(math.log((x + 0.5) / (t + 0.5 * v)) for x, t in zip(c, totals, strict=True)) for g, c in raw.items()}
    return LanguageModel(langs, tables)


class Scorer:
    """Scores texts; remembers the scores of white-space chunks of at most ``longest`` characters, up to ``memory`` of them."""

    def __init__(self, model: LanguageModel, memory: int = 400_000, longest: int = 64):
        self.model, self.memory, self.longest = model, memory, longest
        self.reset()

    def reset(self) -> None:
        self.rows = np.zeros((1024, len(self.model.langs) + 1))  # last column: words
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> tuple[float, ...] | np.ndarray:
        if (known := self.model.tables[0].get(word)) is not None:
            return known
        framed = f" {word} "
        for n in ORDERS:
            table = self.model.tables[n]
            if found := [s for i in range(len(framed) - n + 1) if (s := table.get(framed[i : i + n])) is not None]:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return (0.0,) * len(self.model.langs)

    def scored(self, chunk: str) -> np.ndarray:
        row = np.zeros(self.rows.shape[1])
        for w in LETTER_RUN.findall(chunk):
            row[:-1] += self.word(w)
            row[-1] += 1
        return row

    def chunk(self, chunk: str) -> int:
        k = len(self.seen)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.scored(chunk)
        self.seen[chunk] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.model.langs:
            return "und", 0.0
        if len(self.seen) > self.memory:
            self.reset()
        get, chunk = self.seen.get, self.chunk
        chunks = text.lower().split()
        long = [c for c in chunks if len(c) > self.longest]
        if long:  # scripts without blanks, or junk: not remembered
            chunks = [c for c in chunks if len(c) <= self.longest]
        at = [chunk(c) if (k := get(c)) is None else k for c in chunks]
        total = self.rows[at].sum(axis=0) if at else np.zeros(self.rows.shape[1])
        for c in long:
            total = total + self.scored(c)
        if not total[-1]:
            return "und", 0.0
        gap = total[:-1] - total[:-1].max()
        share = np.exp(gap / math.sqrt(total[-1]))
        best = int(np.argmax(gap))
        return self.model.langs[best], float(1 / share.sum())


_scorers: dict[int, Scorer] = {}


def _scorer_of(model: LanguageModel) -> Scorer:
    """This worker's scorer; one that serves many tasks keeps what it has learned of chunks."""
    if id(model) not in _scorers:
        _scorers.clear()
        _scorers[id(model)] = Scorer(model)
    return _scorers[id(model)]


def language_column(spark: SparkSession, model: LanguageModel):
    """A function from a text column to a column of (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        scorer = _scorer_of(shared.value)
        return pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang_pred", "score"])

    return guess


def identify_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score per document. One pass, no shuffle."""
    guess = language_column(documents.sparkSession, model)
    return documents.select("doc_id", guess("text").alias("g")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "g.lang_pred", "g.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return identify_languages(documents, fit(documents))
