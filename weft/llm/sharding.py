"""Weighted rendezvous hashing of record keys, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.lineage import bounded, checkpointed

#: Rows that one window of slots should hold, on average over shards.
PER_BUCKET = 2_000


def _unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from MD5, exact in a double."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{salt}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def key_text(*columns: str) -> Column:
    """The columns as one text; null and empty text stay apart."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns])


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 .. n-1) with the largest score w / -ln(u(key, shard)); the smaller on a tie.

    A score depends on nothing but the key and its shard, so that a further
    shard only takes rows to itself and a larger weight only takes rows in.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [
        F.struct((F.lit(float(w)) / -F.log(_unit(key, str(n)))).alias("score"), F.lit(-n).alias("shard"))
        for n, w in enumerate(weights)
    ]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def shard_rows(
    df: DataFrame,
    keys: list[str],
    weights: list[float],
    order: list[str] | None = None,
    grown: list[float] | None = None,
) -> DataFrame:
    """df with shard int, slot long and, with grown weights, grown_shard int.

    slot numbers the rows of a shard from 0 without gaps, in the order of the
    MD5 of the key and the order columns. Rows of a shard are numbered in
    ranges of that hash and the sizes of ranges summed up, so that no task
    sorts a whole shard. A null key is a key like any other; rows that repeat a
    key go to one shard, spread by their order columns, and rows that repeat
    both lie side by side in one range. Columns shard, slot and grown_shard of
    df are replaced, others stay whatever their names.
    """
    kept = df.drop("shard", "slot", "grown_shard")
    key = key_text(*keys)
    new = [rendezvous(key, weights).alias("shard")]
    if grown is not None:
        new.append(rendezvous(key, grown).alias("grown_shard"))
    buckets = max(64, -(-df.count() // (PER_BUCKET * len(weights))))
    hashed = F.md5(key_text(*keys, *(order or [])))
    placed = kept.select(F.struct("*").alias("row"), *new, hashed.alias("hash"))
    # Ranges ascend with the hash: its first 32 bits, scaled.
    prefix = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("bucket", F.shiftright(prefix * F.lit(buckets), 32))
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("shard", "bucket").orderBy("hash")
    slot = (F.col("start") + F.col("place") - 1).cast("long").alias("slot")
    numbered = placed.withColumn("place", F.row_number().over(inside)).join(bounded(starts), ["shard", "bucket"])
    return numbered.select("row.*", "shard", slot, *(["grown_shard"] if grown is not None else []))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of a sharding of documents by doc_id over equal shards (law `key`).

    size is the UTF-8 bytes of the text (none for null) and 1; grown_shard is
    the shard with one shard more. Texts do not enter the shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(narrow, ["doc_id"], [1.0] * shards, ["text_crc32", "size"], [1.0] * (shards + 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
