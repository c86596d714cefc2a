"""Toxicity by compression distance: separate zstandard dictionaries of toxic and of ordinary text.

A fit takes a bounded sample of labelled rows outside the held-out fold (``max_toxic`` and ``max_ordinary``
documents of least id hash, of at most ``max_bytes`` each). Of near copies in it only one counts. Both
dictionaries are trained by zstandard: the ordinary one on passages of ordinary documents, the toxic one on
passages of toxic documents, less what ordinary documents have as often (toxic documents are mostly ordinary text,
which would fill the dictionary). A window of ``WINDOW`` words is compressed twice, once with the ordinary
dictionary alone and once with the toxic one before it; the bytes saved are its gain. A document's excess is the
sum of its windows' gains beyond a threshold. The threshold, and the logistic curve that turns the excess into a
score, are calibrated on documents of the sample that no dictionary was trained on.

Cases: null and empty texts have no gain and score as such; texts of any length are read whole; without labels
of both kinds every score is the labels' mean (0 without any). Repeated rows score alike; a null doc_id is
not held out. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold_of, held_out, read, with_id, with_null_id

WINDOW = 6
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 24_576, 2_048
GRAM, SLOT_BITS, SEGMENT = 6, 22, 24


@dataclass(frozen=True)
class ToxicityModel:
    """Contents of both dictionaries, the calibrated threshold of a window's gain, and the slope and constant of the score."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    curve: tuple[float, float]


def windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    words = text.lower().split() if text else []
    return [f" {' '.join(words[i : i + width])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), width)]


class Compressor:
    def __init__(self, content: bytes):
        # Zstandard takes contents of 8 bytes or more.
        own = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    def lengths(self, parts: list[bytes]) -> np.ndarray:
        done = self.compressor.compress
        return np.fromiter((len(done(p)) for p in parts), np.int64, len(parts))


class Gains:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = Compressor(ordinary), Compressor(ordinary + toxic)

    def of(self, text: str | None) -> np.ndarray:
        parts = windows(text)
        return self.plain.lengths(parts) - self.both.lengths(parts) if parts else np.zeros(0, np.int64)


def excess(gains: np.ndarray, threshold: int) -> float:
    """How far a document's windows exceed the threshold together, on a log scale."""
    return float(np.log1p(np.maximum(0, gains - threshold).sum())) if len(gains) else 0.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (constant last) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(curve, slope)
    return w


def distinct_texts(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones: no two share one of their twelve least 5-word shingle hashes."""
    seen: set[int] = set()
    out = []
    for t in texts:
        words = t.lower().split()
        least = sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))})[:12]
        if seen.isdisjoint(least):
            out.append(t)
        seen.update(least)
    return out


def _gram_slots(part: bytes) -> np.ndarray:
    """Slots of the GRAM-byte strings of ``part`` in a table of counts."""
    data = np.frombuffer(part, np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(data) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + data[k : k + len(h)] + np.uint64(1)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _gram_rates(texts: list[str]) -> tuple[np.ndarray, float]:
    """In how many texts each slot occurs, and the number of texts' bytes."""
    counts, size = np.zeros(1 << SLOT_BITS, np.int32), 0
    for t in texts:
        whole = b"".join(windows(t, 64))
        counts[np.unique(_gram_slots(whole))] += 1
        size += len(whole)
    return counts, max(1, size)


def toxic_stretches(toxic: list[str], ordinary: list[str], ratio: float = 4.0) -> list[bytes]:
    """Passages of toxic texts less what ordinary texts have as often: stretches of strings that are ``ratio`` times as frequent, with two standard errors."""
    (a, size_a), (b, size_b) = _gram_rates(toxic), _gram_rates(ordinary)
    telling = (a - 2 * np.sqrt(a)) / size_a > ratio * (b + 2 * np.sqrt(b + 1)) / size_b
    out = []
    for t in toxic:
        for w in windows(t, 64):
            hit = telling[_gram_slots(w)]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
            out += [w[i : j + GRAM - 1] for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return out


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a trained dictionary; of samples too few to train on, the samples themselves."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    # What precedes the content are entropy tables; the content starts at the first printed stretch.
    start = re.search(rb"[\x20-\x7e\xc2-\xf4][\x20-\x7e\x80-\xf4]{15}", trained)
    return trained[start.start() if start else 0 :]


def train(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Dictionaries from three fifths of either kind, threshold and curve from the rest."""
    toxic, ordinary = distinct_texts(toxic), distinct_texts(ordinary)
    if min(len(toxic), len(ordinary)) < 4:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        return ToxicityModel(b"", b"", 0, (0.0, float(np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9)))))
    split = lambda texts: (texts[: len(texts) * 3 // 5], texts[len(texts) * 3 // 5 :])
    (t_fit, t_cal), (o_fit, o_cal) = split(toxic), split(ordinary)
    plain = _dictionary([w for t in o_fit for w in windows(t, 64)], ORDINARY_BYTES, 32)
    stretches = toxic_stretches(t_fit, o_fit)
    # Zstandard trains on samples of some length: several stretches, in an order of chance, are one.
    order = np.random.default_rng(5).permutation(len(stretches))
    bad = _dictionary([b"".join(stretches[k] for k in order[i : i + 8]) for i in range(0, len(order), 8)], TOXIC_BYTES, SEGMENT)
    gains = Gains(plain, bad)
    g = [gains.of(t) for t in t_cal] + [gains.of(t) for t in o_cal]
    y = np.array([1.0] * len(t_cal) + [0.0] * len(o_cal))
    best = None
    for threshold in range(8):
        x = np.array([[excess(v, threshold)] for v in g])
        w = logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x[:, 0] * w[0] + w[1], -30, 30)))
        loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
        if best is None or loss < best[0]:
            best = (loss, threshold, (float(w[0]), float(w[1])))
    return ToxicityModel(plain, bad, best[1], best[2])


def fit(documents: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_ordinary: int = 4000, max_bytes: int = 65_536) -> ToxicityModel:
    """Trains on documents with a label outside fold 0."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts: dict[int, list[str]] = {}
    for kind, most in ((1, max_toxic), (0, max_ordinary)):
        chosen = known.where(F.col("toxic") == kind).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows = documents.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
        texts[kind] = [r["text"] for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))]  # bounded by most
    return train(texts[1], texts[0])


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.gains = model, Gains(model.ordinary, model.toxic)

    def score(self, text: str | None) -> float:
        gains = self.gains.of(text) if self.model.toxic else np.zeros(0, np.int64)
        odds = self.model.curve[0] * excess(gains, self.model.threshold) + self.model.curve[1]
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted per document. One pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            scores = [scorer.score(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]})

    scored = with_null_id(with_id(documents).mapInPandas(run, "doc_id long, score double, predicted int"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score_toxicity(documents, fit(documents, read(spark, sf_dir, "labels")))
