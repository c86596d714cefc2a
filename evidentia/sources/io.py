"""Sources and sinks: JSON, JSON lines and Parquet with schemas, gated publication, resumed and upserted outputs."""

from __future__ import annotations

import sqlite3
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Output modes of the layout parser in the order in which they are preferred.
MODES = ("hybrid_auto", "auto", "ocr", "txt")


def read_json(spark: SparkSession, path: str | list[str], schema) -> DataFrame:
    """Whole-file JSON: an object is a row, a list is a row per element. A byte order mark is skipped by the reader."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema) -> DataFrame:
    """A row per line; blank lines are none, and a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_matching(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Whole-file JSON of the files of a folder that match, with the file each row is from."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(folder)
    return rows.withColumn("source_file", F.col("_metadata.file_path"))


def preferred_paths(listing: DataFrame) -> DataFrame:
    """``listing(doc, mode, path)`` to each document's path of the best mode there is."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, MODES)), F.col("mode")).cast("int"), F.lit(99))
    rank = F.when(rank == 0, 99).otherwise(rank)
    return listing.groupBy("doc").agg(F.min_by("path", F.struct(rank, F.col("path"))).alias("path"))


def blocks_of(documents: DataFrame) -> DataFrame:
    """``documents(doc, items array<struct>)`` to content blocks, each with its place in the list."""
    return documents.select("doc", F.posexplode("items").alias("content_index", "b")).select("doc", "content_index", "b.*")


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks(doc, chunk, start_page, idx, page_idx, ...)`` as one document: pages counted on, blocks numbered anew."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("chunk", "idx")
    return chunks.withColumn("page_idx", F.col("page_idx") + F.col("start_page")).withColumn("content_index", F.row_number().over(w) - 1)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def publish(outputs: dict[str, DataFrame], statuses: DataFrame, folder: str) -> bool:
    """All or nothing: statuses are always written; outputs only if every document passes, else earlier ones are emptied.

    Everything is written beside first; folders take their places by renaming only when all are complete.
    """
    spark = statuses.sparkSession
    fine = statuses.where(F.col("status").isNull() | (F.col("status") != "pass")).isEmpty()
    own = {"status": statuses} | {name: df if fine else df.limit(0) for name, df in outputs.items()}
    staged = f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    for name, df in own.items():
        df.write.json(f"{staged}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in own:
        files.delete(path(f"{folder}/{name}"), True)
        if not files.rename(path(f"{staged}/{name}"), path(f"{folder}/{name}")):
            raise OSError(f"could not publish {name}; complete outputs are in {staged}")
    files.delete(path(staged), True)
    return fine


def read_sqlite(spark: SparkSession, paths: str | list[str], query: str, schema: str) -> DataFrame:
    """The rows of ``query`` over every SQLite file of ``paths``; files are opened from their bytes, one to a task's row."""

    def rows(batches):
        for b in batches:
            for content in b["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                cursor = con.execute(query)
                while part := cursor.fetchmany(10_000):
                    yield pd.DataFrame(part, columns=[c[0] for c in cursor.description])
                con.close()

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(rows, schema)


def active_memory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The active items of memory stores, with their lists decoded."""
    raw = read_sqlite(spark, paths, "SELECT memory_id, memory_type, text, tags_json, confidence, updated_at_utc FROM memories WHERE status = 'active'", "memory_id string, memory_type string, text string, tags_json string, confidence double, updated_at_utc string")
    return raw.withColumn("tags", F.from_json("tags_json", "array<string>")).drop("tags_json")


def reference_rows(sets: DataFrame) -> DataFrame:
    """``sets(slug, tables array<struct<label, evidence array<struct<evidence_id, text>>>>)`` as a row per evidence; the slug loses its suffix."""
    one = sets.select(F.regexp_replace("slug", "_fulltext_conditions$", "").alias("slug"), F.explode("tables").alias("t"))
    return one.select("slug", F.col("t.label").alias("label"), F.posexplode("t.evidence").alias("pos", "e")).select("slug", "label", "pos", "e.evidence_id", "e.text")


def paired_sources(specifications: dict) -> list[dict]:
    """Sources of a configuration: its list ``sources``, or pairs of keys ``<prefix>_anchor_manifest`` and ``<prefix>_popo_tree_dir``. A slug used twice is an error."""
    own = list(specifications.get("sources") or [])
    for key, manifest in specifications.items():
        prefix = key.removesuffix("_anchor_manifest")
        if prefix != key and f"{prefix}_popo_tree_dir" in specifications:
            own.append({"slug": prefix, "anchor_manifest": manifest, "tree_dir": specifications[f"{prefix}_popo_tree_dir"]})
    slugs = [s.get("slug") for s in own]
    if twice := sorted({s for s in slugs if slugs.count(s) > 1}):
        raise ValueError(f"sources used twice: {twice}")
    return own


def reviewed_paths(documents: DataFrame, allow_draft: bool) -> DataFrame:
    """``documents(doc, explicit, reviewed, draft)`` to the path that is read: the explicit one, else the reviewed, else the draft if allowed; null is none."""
    return documents.select("doc", F.coalesce("explicit", "reviewed", *(["draft"] if allow_draft else [])).alias("path"))


def decision_report(decisions: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, problem): decisions that nothing asked for, that came twice or more, and that are missing."""
    got = decisions.groupBy(key).agg(F.count("*").alias("n"))
    joined = got.join(expected.select(key, F.lit(True).alias("_asked")).distinct(), key, "full")
    bad = F.when(F.col("_asked").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return joined.select(key, bad.alias("problem")).where("problem IS NOT NULL")


def flattened_samples(tables: DataFrame) -> DataFrame:
    """``tables(doc, table_id, parents array<struct<parent_id, children array<struct<child_id, text, label>>>>)`` as a row per child."""
    one = tables.select("doc", "table_id", F.explode("parents").alias("p")).select("doc", "table_id", "p.parent_id", F.explode("p.children").alias("c"))
    return one.select("doc", "table_id", "parent_id", "c.*")


def log_errors(errors: DataFrame, folder: str) -> None:
    """Appends ``errors(paper_id, error_type, message)`` with the time, in UTC."""
    errors.withColumn("logged_at_utc", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(folder)


def left_to_do(rows: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return rows if done is None else rows.join(done.select(*keys).distinct(), keys, "left_anti")


def markdown(df: DataFrame, group: str, order: list[str], line) -> DataFrame:
    """(group, text): one Markdown text per group, a heading and its lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["_line"])), "\n")
    return df.groupBy(group).agg(body.alias("_body")).select(group, F.concat(F.lit("# "), F.col(group).cast("string"), F.lit("\n\n"), F.col("_body")).alias("text"))
