"""Whole results of operators that SQL cannot express, recomputed by plain loops on small corpora."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from evidentia.llm import decontam, langid, secrets, toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_contamination_equals_alignment_of_all_pairs(spark):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [(k, text(r.randint(15, 40))) for k in range(6)] + [(6, "量子纠缠是两个粒子之间的一种关联现象"), (7, "the"), (8, None), (9, "")]
    docs = []
    for k in range(40):
        parts = [text(r.randint(20, 60))]
        if k % 2:
            own = items[r.randrange(6)][1].split()
            for at in r.sample(range(len(own)), len(own) * (k % 8) // 16):
                own[at] = r.choice(words)
            parts.append(" ".join(own))
        docs.append((k, " ".join([*parts, "the", text(20)])))
    docs += [(100, "我们知道量子纠缠是两个粒子之间的一种关联现象,对吗"), (101, None), (102, "")] + [(200 + k, "the the the") for k in range(9)]
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, s in items:
            item, passage = decontam.words_of(s), decontam.words_of(t)
            if len(item) >= decontam.SEED and passage:
                score = decontam.align(item, passage)[0] / (decontam.MATCH * len(item))
                if score >= decontam.THRESHOLD and any(item[k : k + 3] == passage[j : j + 3] for k in range(len(item) - 2) for j in range(len(passage) - 2)):
                    want[d, i] = score
    assert got == want and (100, 6) in got and not any(i == 7 for _, i in got) and len(got) > 12


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(docs, none).count() == 0 and decontam.decontaminate(docs, none).count() == 1


def test_languages_equal_sums_over_words(spark):
    r = random.Random(5)
    syllables = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ung", "en", "ö"], "cc": ["ci", "ón", "qu", "ar"]}
    text = lambda lang: " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 4))) for _ in range(r.randint(1, 40)))
    rows = [(k, lang := r.choice(list(syllables)), text(lang)) for k in range(300)] + [(900, "aa", None), (901, None, "123 !"), (902, None, "karo " + "sch" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs)
    right = total = 0
    for x in langid.identify_languages(docs, model).collect():
        _, lang, t = next(y for y in rows if y[0] == x["doc_id"])
        sums, n = [0.0] * len(model.langs), 0
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            n += 1
            if w in model.tables[0]:
                own = model.tables[0][w]
            else:
                framed = f" {w} "
                own = (0.0,) * len(model.langs)
                for order in (4, 3, 2, 1):
                    known = [model.tables[order][g] for g in (framed[i : i + order] for i in range(len(framed) - order + 1)) if g in model.tables[order]]
                    if known:
                        own = [sum(v) / len(known) for v in zip(*known, strict=True)]
                        break
            sums = [a + b for a, b in zip(sums, own, strict=True)]
        if not n:
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        share = [math.exp((s - max(sums)) / math.sqrt(n)) for s in sums]
        assert x["lang_pred"] == model.langs[sums.index(max(sums))] and abs(x["score"] - 1 / sum(share)) < 1e-9 and x["held_out"] == held(x["doc_id"])
        if x["held_out"] and lang:
            total += 1
            right += x["lang_pred"] == lang
    assert total > 30 and right >= 0.95 * total


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, "some words")], "doc_id long, lang string, text string")
    assert [r["lang_pred"] for r in langid.identify_languages(docs, langid.fit(docs)).collect()] == ["und"]
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert [r["predicted"] for r in scored] == [0]


def brute_base(t):
    """Base spans by scanning every position, without the operator's patterns."""
    out, low = [], t.lower()
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < len(t):
        end = None
        for name in names:
            if low.startswith(name, at):
                k = at + len(name)
                k += t[k : k + 1] in ('"', "'") and k < len(t)
                while t[k : k + 1] == " ":
                    k += 1
                if t[k : k + 1] in (":", "=") and k < len(t):
                    k += 1
                    while t[k : k + 1] == " ":
                        k += 1
                    k += t[k : k + 1] in ('"', "'") and k < len(t)
                    stop = k
                    while stop < len(t) and t[stop] in value:
                        stop += 1
                    if stop > k:
                        end = stop
                        if stop - k >= 6:
                            out.append((at, 0, stop))
                break
        at = end if end else at + 1
    for kind, head, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(t):
            stop = at + len(head)
            if not t.startswith(head, at):
                at += 1
                continue
            while stop < len(t) and t[stop] in chars:
                stop += 1
            if stop > at + len(head):
                if stop - at >= least:
                    out.append((at, kind, stop))
                at = stop
            else:
                at += 1
    return sorted(out)


def test_base_secrets_equal_a_scan_of_every_position(spark):
    r = random.Random(6)
    bits = ["password", "Token", "api_key", "apikey", "SECRET", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123456789XYZ", "deadbeef0123", "cafe" * 7, "x", "hunter2!", "hunter22", "é", "\n", "-", "/"]
    rows = [(k, "".join(r.choices(bits, k=r.randint(1, 30)))) for k in range(400)] + [(999, None), (1000, "")]
    for x in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = brute_base(dict(rows)[x["doc_id"]] or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert x["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(k == kind for _, k, _ in spans) for kind in range(3))
        assert [s for s in x["spans"].split(",") if s and not s.startswith("entropy")] == [s for s in joined.split(",") if s]


def test_many_known_spans_take_linear_time():
    text = "token=abcdefgh " * 20_000 + "Q7xZ9pLm2Kd8Rt4Vw1Yb" * 3
    spans = secrets.Scanner().spans(text)
    assert sum(k == 0 for _, k, _ in spans) == 20_000 and spans[-1][1] == 3


def test_toxicity_equals_lengths_of_compressed_windows(spark):
    r = random.Random(7)
    plain = ["".join(r.choices(["ing", "er", "on", "the", "st", "ta"], k=r.randint(1, 3))) for _ in range(300)]
    bad = ["blorgfuzz", "grumphead", "snarkwort"]
    make = lambda toxic: " ".join(r.choice(bad) if toxic and r.random() < 0.08 else r.choice(plain) for _ in range(80))
    rows = [(k, make(k % 3 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    alone, both = toxicity.Compressor(model.ordinary).compressor, toxicity.Compressor(model.ordinary + model.toxic).compressor
    right = total = 0
    for x in toxicity.score_toxicity(docs, model).collect():
        words = dict(rows)[x["doc_id"]].lower().split()
        saved = [len(alone.compress(w)) - len(both.compress(w)) for w in (f" {' '.join(words[i : i + toxicity.WINDOW])} ".encode() for i in range(0, len(words), toxicity.WINDOW))]
        odds = model.curve[0] * np.log1p(sum(max(0, s - model.threshold) for s in saved)) + model.curve[1]
        assert abs(x["score"] - 1 / (1 + np.exp(-odds))) < 1e-9 and x["predicted"] == int(x["score"] >= 0.5)
        if x["held_out"]:
            total += 1
            right += x["predicted"] == int(x["doc_id"] % 3 == 0)
    assert total > 50 and right >= 0.9 * total
