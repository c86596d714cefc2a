"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from evidentia.llm import chat, decontam, langid, linededup, packing, quality, secrets, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, a int, guess string, line string"
ROWS = [
    (1, "The same words in the same order, with nothing else to add to them at all.", "en", "s", 10, "x", 1, "g", "l"),
    (2, "The same words in the same order, with nothing else to add to them at all.", None, None, None, None, None, None, None),
    (2, "The same words in the same order, with nothing else to add to them at all.", None, None, None, None, None, None, None),
    (3, None, "en", "s", 0, "x", 1, "g", "l"),
    (4, "", "de", "s", 0, "x", 1, "g", "l"),
    (5, " \n\t\n ", "de", "s", 0, "x", 1, "g", "l"),
    (None, "A text without an id, which is kept like any other that has one.", "en", "s", 0, "x", 1, "g", "l"),
    (6, " ".join(f"word{k} of a long text" for k in range(20000)), "en", "s", 0, "x", 1, "g", "l"),
    (7, "12345 !!! 67890", "en", "s", 0, "x", 1, "g", "l"),
    (8, "Grüße 结果稳定。 ́ ﬁ \U0001f600", "de", "s", 0, "x", 1, "g", "l"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def benchmark(spark):
    return spark.createDataFrame([(1, "nothing else to add to them at all"), (None, "x"), (2, None), (3, ""), (4, "zzz")], "item_id long, text string")


OPERATORS = {
    "quality": lambda s, d: quality.judge(d),
    "packing": lambda s, d: packing.pack_documents(d, packing.default_tokenizer()),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "lines": lambda s, d: linededup.dedup_lines(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, toxicity.fit(d, s.createDataFrame([(1, 1), (3, 0), (None, 1), (6, None)], "doc_id long, toxic int"))),
    "language": lambda s, d: langid.identify_languages(d, langid.fit(d)),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "substrings": lambda s, d: substrings.dedup_substrings(d),
    "decontamination": lambda s, d: decontam.find_contamination(d, benchmark(s)),
}
PER_ROW = ("quality", "simhash", "toxicity", "language", "secrets", "substrings")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, name):
    rows = OPERATORS[name](spark, docs).collect()
    if name in PER_ROW:
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted((r[0] for r in ROWS), key=str)
    if name == "packing":
        assert sum(r["length"] for r in rows if r["doc_id"] in (3, 4, 5)) == 3  # the separator alone
        places = {}
        for r in rows:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
    if name == "decontamination":
        assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1, 1), (2, 1), (2, 1)]
    if name == "lines":
        assert {(r["doc_id"], r["kept"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, True), (2, False)}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


def test_chat_cases(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, None, "a", "x"), (2, 0, "assistant", "", "x"), (2, 0, "assistant", "", "x"), (3, None, "tool", "\\[INST]", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, 2: 2, 3: 1}
    assert not any(r["valid"] for r in got.values())
    assert chat.format_chat(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, empty, tmp_path, k):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in rows]
        assert {6, None} <= set(ids) and (1 in ids) == (name != "benchmark_decontamination")
    if name == "language_id":
        assert not {3, 4, 5, 7} & set(ids)
    if name == "line_dedup":
        texts = {r["doc_id"]: r["text"] for r in rows}
        assert texts[1] and texts[2] == "" and texts[3] is None
    if name == "simhash_near_dedup":
        assert 2 not in ids and 1 in ids
    assert stage(spark, empty, str(tmp_path)).collect() == []
