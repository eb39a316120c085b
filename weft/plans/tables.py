"""The driver's tables as profiles, sequences and aligned strings, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark, sf_dir: str) -> DataFrame:
    """embeddings as long profiles without ends: a label is a sequence, ordered by vec_id."""
    order = Window.partitionBy("label").orderBy("vec_id")
    residue = F.substring(F.lit(LETTERS), (F.col("vec_id") % 20 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("int").alias("seq_ord"),
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"),
        (F.row_number().over(order) - 1).cast("int").alias("pos"),
        residue.alias("residue"),
        F.col("embedding").alias("vec"),
        ((F.col("vec_id") % 5 + 1) / 5).cast("float").alias("match_ratio"),
        (1 - (F.col("vec_id") % 5 + 1) / 5).cast("float").alias("del_ratio"),
        F.lit(0.0).cast("float").alias("match_to_del"),
        F.lit(0.95).cast("float").alias("del_to_del"),
        "vec_id",
    )


def plain_positions(spark, sf_dir: str) -> DataFrame:
    """positions() with the gap state of a file without states."""
    return positions(spark, sf_dir).withColumn("match_ratio", F.lit(1.0).cast("float")).withColumn("del_ratio", F.lit(0.0).cast("float"))


POSITIONS_SQL = f"""
positions AS (
  SELECT CAST(label AS INTEGER) AS seq_ord, 'p' || CAST(label AS VARCHAR) AS name, vec_id,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS pos,
         substr('{LETTERS}', CAST(vec_id % 20 + 1 AS INTEGER), 1) AS residue,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec,
         CAST(CAST((vec_id % 5 + 1) / 5.0 AS FLOAT) AS DOUBLE) AS match_ratio
  FROM embeddings
)"""

#: Components of positions, one row each.
LONG_SQL = """
long AS (
  SELECT seq_ord, name, pos, vec_id, match_ratio, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM positions
)"""


def sequences(spark, sf_dir: str) -> DataFrame:
    """benchmark texts as sequences: the ASCII letters of the text in upper case."""
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("int").alias("seq_ord"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"), seq.alias("seq")
    )


SEQUENCES_SQL = """
sequences AS (
  SELECT CAST(item_id AS INTEGER) AS seq_ord, 'b' || CAST(item_id AS VARCHAR) AS name,
         upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark
)"""


def aligned_strings(spark, sf_dir: str) -> DataFrame:
    """Whole sequences as strings of one length: a gap for every E, and at the end up to the longest."""
    rows = sequences(spark, sf_dir)
    longest = rows.agg(F.max(F.length("seq")).alias("longest"))  # one row
    aligned = F.rpad(F.translate("seq", "E", "-"), F.col("longest"), F.lit("-"))
    return rows.join(F.broadcast(longest)).select("seq_ord", "name", aligned.alias("aligned"))


ALIGNED_SQL = """
aligned AS (
  SELECT seq_ord, name, rpad(replace(seq, 'E', '-'), CAST((SELECT max(length(seq)) FROM sequences) AS INTEGER), '-') AS aligned FROM sequences
)"""
