"""From raw documents to packed sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of docs.
"""

from __future__ import annotations

import uuid

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from weft.llm import exact_dedup, langid, mixing, packing, simhash_dedup
from weft.lineage import bounded, checkpointed

TOKENIZER, END_ID = "byte_bpe_50k.json", 0


def language_id(spark, docs, sf_dir):
    """Keeps the documents that have letters, and gives those without a label the language found.

    Any language will do, however low its score: short texts score low in their
    own. Without labelled rows there are no profiles; texts with letters stay
    all the same, and labels stay null.
    """
    profiles = langid.train_profiles(langid.training_rows(docs))
    profiles = profiles or {"": np.ones(langid.DIMENSIONS) / np.sqrt(langid.DIMENSIONS)}
    rows = docs.select(F.struct("*").alias("row"), "text")  # whatever columns docs has, they stay
    found = langid.predict_language(rows, profiles)
    label = F.coalesce(F.col("row")["lang"], F.nullif(F.col("lang_pred"), F.lit("")))
    kept = found.where(F.col("lang_pred") != langid.UNDETERMINED)
    return kept.select(*[label.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def _keep(docs, marks, of_group):
    """The row of each group whose doc_id is kept in marks(doc_id, kept): one row, whatever ids rows share.

    marks has a row for each of docs. Where a doc_id is of one row only, it
    tells the row. of_group(rows) finds the groups of other rows, those without
    an id included: it takes rows(row, doc_id, text) and returns the ones to
    choose from with the column group. Of these a group's first by text stays.
    """
    marks = checkpointed(marks.select(F.col("doc_id").alias("kept_id"), "kept"))
    shared = checkpointed(marks.groupBy("kept_id").count().where("count > 1 OR kept_id IS NULL").select("kept_id"))
    kept = marks.where("kept").select("kept_id")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")  # whatever columns docs has, they stay
    same = F.col("doc_id").eqNullSafe(F.col("kept_id"))
    if not shared.limit(1).count():
        return rows.join(bounded(kept), same, "left_semi").select("row.*")
    alone = checkpointed(kept.join(bounded(shared), "kept_id", "left_anti").where("kept_id IS NOT NULL"))
    known = rows.join(bounded(alone), same, "left_semi").select("row")
    others = of_group(rows.join(bounded(shared), same, "left_semi"))
    # One row of a group leaves each task, however many rows have no id.
    first = others.groupBy("group").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row")).select("row")
    return known.unionByName(first).select("row.*")


def exact_dedup_stage(spark, docs, sf_dir):
    """Keeps the document with the smallest doc_id of each group of equal texts, one without an id if none has one."""
    marks = checkpointed(exact_dedup.exact_groups(docs).select("doc_id", "kept", "text_sha256"))

    def of_group(rows):
        kept = checkpointed(marks.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text")).distinct())
        keyed = rows.withColumn("group", F.sha2(exact_dedup.normalised(F.col("text")), 256))
        same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("group") == F.col("kept_text"))
        return keyed.join(bounded(kept, 200_000), same, "left_semi")

    return _keep(docs, marks, of_group)


def simhash_dedup_stage(spark, docs, sf_dir):
    """Keeps the document with the smallest doc_id of each group of near copies, one without an id if none has one."""
    marks, groups = simhash_dedup.near_components(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    found = marks.join(bounded(groups.select("fp", "component_id")), "fp").select("doc_id", kept.alias("kept"))

    def of_group(rows):
        printed = simhash_dedup.with_fingerprints(rows, "text", "fp")
        return printed.join(bounded(groups), "fp").where(kept).withColumnRenamed("component", "group")

    return _keep(docs, found, of_group)


def mixing_stage(spark, docs, sf_dir):
    """The documents as often as the mix of sources takes them, the last time in part."""
    return mixing.mixed_rows(docs)


def packing_stage(spark, docs, sf_dir):
    """The pieces of all rows in sequences of 1024 tokens."""
    return packing.pack_documents(docs, str(public_tokenizers.path(TOKENIZER)), END_ID)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_dedup", simhash_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    checkpointed(spark.range(1))  # settles the shared folder
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
