"""The corpus pipeline: from raw documents to packed token sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next stage's docs, so that a lost executor costs one stage's tasks at most. All but the last return the columns
of their input.

Cases: null texts and texts without letters go in the first stage; a document that loses all its lines goes on
with an empty text (all such are one group of near-duplicates, of which one stays); rows that repeat a doc_id
go or stay together; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontam, langid, linededup, packing, shared, simhash

#: Documents whose language has a smaller share than this after tempering are of no language.
LEAST_LANGUAGE_SCORE = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter or without a leading language go."""
    guess = langid.language_column(spark, langid.fit(docs))
    name = shared.free_name(docs, "guess")
    guessed = docs.withColumn(name, guess("text"))
    return guessed.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SCORE)).drop(name)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat, exactly or nearly, a line kept elsewhere; n_chars follows."""
    out = linededup.without_duplicate_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    marked = simhash.near_duplicates(docs)
    heads = marked.where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(heads, docs["doc_id"].eqNullSafe(heads["doc_id"]), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminate(docs, shared.read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in packed sequences."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Language, alignment and tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table, each written to the shared folder before the next."""
    folder = f"{shared.checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = shared.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
