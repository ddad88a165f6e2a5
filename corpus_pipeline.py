"""Corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import decontamination, jaccard_join, language_id, packing, secret_scan
from shoplens.session import bound_batches, ensure_checkpoint_dir

#: No SQL: language ID, the secret tagger and packing are not expressible in SQL.
ORACLE_SQL: str | None = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those with a null or empty text, or without a letter (``und``), go.

    The model learns from the stage's own rows with a text and a lang; without
    any all rows are ``und`` and go. Repeated rows are judged alike and stay;
    columns of any name are kept as they are; an empty table stays empty.
    """
    bound_batches(spark)
    pred = _free(docs, "lang_pred")
    model = language_id.train(docs)
    found = language_id.classify(docs, model, names=(pred, _free(docs, "lang_score")))
    return found.where(F.col(pred) != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by Jaccard 0.8 over five-word shingles: one with its smallest doc_id.

    Groups are of rows, not of ids: rows that share an id, or have none, are
    judged by their own texts. A null id is kept only where no row of the group
    has one; of repeated rows one is kept. Null texts and texts without words
    are linked with nothing and all stay. Columns of any name are kept as they
    are; an empty table stays empty.
    """
    row, kept_as = _free(docs, "_row"), _free(docs, "_kept")
    number = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    groups = jaccard_join.jaccard_components(by_text, k=5, percent=80).where("n_shingles > 0") \
        .select(F.col("doc_id").alias("h"), "component_id").distinct()
    # copies of a text meet as partial minima, so a large group is no large task
    first = docs.groupBy(F.xxhash64("text").alias("h")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("m"))
    keep = first.join(groups, "h").groupBy("component_id") \
        .agg(F.min(F.struct("m.none", "m.id", "h")).alias("m")) \
        .select(F.xxhash64("m.none", "m.id", "m.h").alias(row))
    kept = docs.withColumn(row, number).join(keep, row, "left_semi").groupBy(row) \
        .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(kept_as))
    wordless = F.coalesce(F.length(F.translate("text", " \t\n\x0b\f\r", "")), F.lit(0)) == 0
    return kept.select(f"`{kept_as}`.*").union(docs.where(wordless))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; each is judged by its own text, whatever its doc_id.

    Null and empty texts hold no passage and stay, as do all rows where the
    benchmark is empty; repeated rows share their fate. Columns of any name are
    kept as they are; an empty table stays empty.
    """
    bad_id, bad_text = _free(docs, "_bad_id"), _free(docs, "_bad_text")
    bad = decontamination.contaminated_texts(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")) \
        .withColumnsRenamed({"_bad_id": bad_id, "_bad_text": bad_text})
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_text)), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in their texts replaced by a mark (and n_chars by the new length).

    Null texts stay null and empty ones empty; repeated rows are treated alike;
    all other columns are kept as they are; an empty table stays empty.
    """
    bound_batches(spark)
    return secret_scan.redact(docs, secret_scan.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents and their places in sequences of 2048 ids.

    A null or empty text is its end id alone; repeated rows are packed each;
    other columns are left behind; an empty table gives no pieces.
    """
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminate),
          ("secret_scan", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; the files between them lie in the shared folder."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, out, sf_dir).write.parquet(f"{base}/{k}-{name}")
        out = spark.read.parquet(f"{base}/{k}-{name}")
    return out
