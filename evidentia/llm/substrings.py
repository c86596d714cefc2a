"""Exact substring dedup over byte suffixes: distributed merge sort of front-coded runs.

A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller doc_id. All
strings of 50 bytes have anchors by content (see ``suffixes``), so suffixes are needed at anchors only:

1. Documents are dealt to blocks by id hash. A block sends the distinct hashes of its anchors' grams, sorted
   and difference-coded, to buckets by hash; a bucket answers with a bit for each that another block has too.
2. A block takes the suffixes at anchors that it or another block repeats, each with the bytes before it,
   sorts the distinct ones and sends them front-coded, with the least document of each, to buckets by hash.
3. A bucket merges its runs by a loser tree that never compares known prefixes again, and answers each suffix
   with the span that an earlier document has. Blocks put the spans together and digest what is left.

A passage that very many documents share is sent once per block in either exchange, since blocks combine
before they send; rows of one block know of each other without it. Block and bucket sizes are bounded and
their number follows the input. All steps are one plan, whose text shuffle is shared by the three passes over
blocks, and lost tasks are recomputed from shuffles alone.

Cases: a null text is an empty one; texts under 50 bytes lose nothing; rows of one doc_id never remove bytes
of each other; a null doc_id counts as the smallest. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffixes as sx
from .shared import NO_ID, read, with_null_id

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 48 << 20


class Block:
    """The documents of a block, end to end, with their anchors."""

    def __init__(self, docs: pd.DataFrame):
        # An order that follows from the rows alone: every pass must see the block alike.
        texts = list(docs["body"])
        order = sorted(range(len(texts)), key=lambda i: (docs["doc_id"].iloc[i], texts[i]))
        self.ids = docs["doc_id"].to_numpy()[order]
        self.data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.at, self.grams = sx.anchors(self.data, self.ends)
        self.row = np.searchsorted(self.ends, self.at, side="right")
        self.doc = self.ids[self.row]

    def hashes(self, buckets: int):
        """Distinct gram hashes in order: (values, inverse, whether documents of this block repeat it, bucket)."""
        values, inverse = np.unique(self.grams, return_inverse=True)
        low = np.full(len(values), np.iinfo(np.int64).max)
        high = np.full(len(values), NO_ID)
        np.minimum.at(low, inverse, self.doc)
        np.maximum.at(high, inverse, self.doc)
        return values, inverse, low < high, (values % np.uint64(buckets)).astype(np.int64)

    def repeated(self, answers: dict[int, bytes], buckets: int):
        """Anchors with a gram that several documents have: (indexes of anchors, their buckets)."""
        values, inverse, here, bucket = self.hashes(buckets)
        there = here.copy()
        for b, bits in answers.items():
            own = np.flatnonzero(bucket == b)
            there[own] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        kept = np.flatnonzero(there[inverse])
        return kept, bucket[inverse[kept]]

    def suffixes(self, kept: np.ndarray, bucket: np.ndarray):
        """Distinct contexts at the kept anchors: (by bucket: rows in order and least documents), and how to get back.

        Yields (bucket, sorted rows, least doc of each, [for each kept anchor of the bucket: index of anchor, its row]).
        """
        for b in np.unique(bucket):
            own = kept[bucket == b]
            distinct, inverse = sx.distinct_contexts(self.data, self.starts[self.row[own]], self.ends[self.row[own]], self.at[own])
            flat = distinct.tobytes()
            order = sorted(range(len(distinct)), key=lambda i: flat[i * sx.WIDTH : (i + 1) * sx.WIDTH])  # noqa: B023
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            least = np.full(len(order), np.iinfo(np.int64).max)
            to = place[inverse]
            np.minimum.at(least, to, self.doc[own])
            yield int(b), distinct[order], least, own, to


def _split(answers: pd.DataFrame) -> tuple[dict[int, bytes], dict[int, bytes]]:
    grams = {int(b): bytes(x) for b, k, x in zip(answers["bucket"], answers["kind"], answers["answer"], strict=True) if k == 0}
    spans = {int(b): bytes(x) for b, k, x in zip(answers["bucket"], answers["kind"], answers["answer"], strict=True) if k == 1}
    return grams, spans


def dedup_substrings(documents: DataFrame, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document and, if asked for, ``kept``: the remaining bytes."""
    body = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    total = body.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    # Tasks follow the input: a task has at most about eight blocks, or one bucket.
    usual = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df, key, most: df if most <= usual else df.repartition(most, key)
    by_block = lambda df: spread(df, "block", -(-blocks // 8))
    by_bucket = lambda df: spread(df, "bucket", buckets)
    dealt = by_block(body.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("long")))

    def send_grams(docs: pd.DataFrame) -> pd.DataFrame:
        block = Block(docs)
        values, _, _, bucket = block.hashes(buckets)
        n, rows = int(docs["block"].iloc[0]), []
        for b in range(buckets):
            if len(own := values[bucket == b]):
                rows.append((n, b, sx.pack_sorted(own >> np.uint64(20))))
        return pd.DataFrame(rows, columns=["block", "bucket", "run"])

    def answer_grams(runs: pd.DataFrame) -> pd.DataFrame:
        opened = [sx.unpack_sorted(bytes(r)) for r in runs["run"]]
        every = np.sort(np.concatenate([np.unique(v) for v in opened]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for n, b, v in zip(runs["block"], runs["bucket"], opened, strict=True):
            at = np.searchsorted(twice, v)
            hit = np.zeros(len(v), bool)
            inside = at < len(twice)
            hit[inside] = twice[at[inside]] == v[inside]
            out.append((n, b, 0, np.packbits(hit).tobytes()))
        return pd.DataFrame(out, columns=["block", "bucket", "kind", "answer"])

    def send_suffixes(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs):
            block = Block(docs)
            kept, bucket = block.repeated(_split(answers)[0], buckets)
            for b, distinct, least, _, _ in block.suffixes(kept, bucket):
                rows.append((int(docs["block"].iloc[0]), b, sx.front_code(distinct, least)))
        return pd.DataFrame(rows, columns=["block", "bucket", "run"])

    def answer_suffixes(runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values("block")
        blobs = [bytes(r) for r in runs["run"]]
        answers = [bytearray(2 * int.from_bytes(b[:8], "little")) for b in blobs]

        def settle(group) -> None:
            if len(group) > 1:
                for (run, i, _, _), (a, z) in zip(group, sx.removed_spans([(row, doc) for _, _, row, doc in group]), strict=True):
                    answers[run][2 * i], answers[run][2 * i + 1] = a, z

        group: list[tuple] = []
        for run, i, row, doc, shared in sx.merge(blobs):
            if shared < sx.GRAM and group:
                settle(group)
                group = []
            group.append((run, i, row, doc))
        settle(group)
        return pd.DataFrame({"block": runs["block"], "bucket": runs["bucket"], "kind": 1, "answer": [bytes(a) for a in answers]})

    def remove(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
        if not len(docs):
            return pd.DataFrame([], columns=columns)
        block = Block(docs)
        grams, spans = _split(answers)
        kept, bucket = block.repeated(grams, buckets)
        edge = np.zeros(len(block.data) + 1, np.int32)
        for b, rows, least, own, to in block.suffixes(kept, bucket):
            span = np.frombuffer(spans[b], np.uint8).reshape(-1, 2).astype(np.int64)
            lo, hi = span[to, 0], span[to, 1]
            later = block.doc[own] > least[to]  # this block has the whole context in an earlier document
            left = sx.LEFT - (rows[:, sx.LENGTH :] != sx.PAD_LEFT).sum(axis=1)
            right = sx.LEFT + (rows[:, : sx.LENGTH] != sx.PAD_RIGHT).sum(axis=1)
            whole = later & (right[to] - left[to] >= sx.LENGTH)
            lo, hi = np.where(whole, left[to], lo), np.where(whole, right[to], hi)
            some = hi > lo
            np.add.at(edge, block.at[own][some] - sx.LEFT + lo[some], 1)
            np.add.at(edge, block.at[own][some] - sx.LEFT + hi[some], -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for doc, a, b in zip(block.ids, block.starts, block.ends, strict=True):
            mask = gone[a:b]
            rest = block.data[a:b][~mask].tobytes()
            n_spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
            out.append((doc, b - a, int(mask.sum()), n_spans, hashlib.sha256(rest).hexdigest(), *[rest] * with_kept))
        return pd.DataFrame(out, columns=columns)

    run_schema, answer_schema = "block long, bucket long, run binary", "block long, bucket long, kind int, answer binary"
    gram_answers = by_bucket(dealt.groupBy("block").applyInPandas(send_grams, run_schema)).groupBy("bucket").applyInPandas(answer_grams, answer_schema)
    runs = dealt.groupBy("block").cogroup(by_block(gram_answers).groupBy("block")).applyInPandas(send_suffixes, run_schema)
    span_answers = by_bucket(runs).groupBy("bucket").applyInPandas(answer_suffixes, answer_schema)
    answers = by_block(gram_answers.unionByName(span_answers))
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    return with_null_id(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"), with_kept=False)
