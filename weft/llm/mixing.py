"""Mixing sources to target weights with a low-discrepancy schedule.

The documents of a source lie in shuffled order on a line of words that is cut
into blocks of equal length. Golden-ratio points go through the cumulative
weights of the sources and give each slot of the mix a source. Slots are
ranked per source, and slot r of a source takes its block r, starting over
behind the last. The last slot of a source ends where its target is met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.lineage import bounded, checkpointed
from weft.llm.common import word_count

#: Words of a block.
BLOCK_WORDS = 1024
#: The weights that sources have in turn, and the size of the mix by all words.
WEIGHTS, TOTAL = (5.0, 2.0, 1.0), 1.5
#: A source is taken this many times at most.
EPOCHS = 2
#: Slots of one step of the schedule; rows of a bucket of the shuffled order.
STEP, PER_BUCKET = 1 << 16, 4096
#: Sources up to this number are broadcast; more are joined by a shuffle.
SOURCES_BROADCAST = 10_000
#: Golden ratio in 64 bits (odd, so that no two of 2**64 points are equal); products wrap around.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Points for each slot of the mix. Gaps between golden-ratio points are below
#: 1.9 over their number, so this many reach every source as often as it needs;
#: what is too many for a source is left out.
_POINTS = 3


def capped_targets(sizes: list[int], weights: list[float], total: float, cap: float = EPOCHS) -> list[float]:
    """Shares of total by weight, none above cap times its size; the excess goes by weight to the others."""
    targets = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = min(float(total), cap * float(sum(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = cap * float(sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def schedule(spark, targets: list[float], words: list[int], block: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix: slot long, source int, rank long, block long, take long.

    Slots ascend in the order of the mix. A source gets the slots whose
    golden-ratio point falls in its share of the targets, ranked from 0; slots
    past its target are left out. take is the words of the slot's block that
    count: less than a whole block only at the end of a source's line or of
    its target. Steps of slots are made in parallel: each counts its slots per
    source, and the ranks go on from the sums of the counts before.
    """
    goal = np.array([min(round(t), EPOCHS * w) for t, w in zip(targets, words, strict=True)], np.int64)
    blocks = -(-np.array(words, np.int64) // block)
    sizes = np.array(words, np.int64)
    need = np.array([_slots_of(g, w, block) for g, w in zip(goal.tolist(), words, strict=True)], np.int64)
    share = need / max(1, need.sum())
    edges = np.cumsum(share)
    edges[-1:] = 1.0
    slots = _POINTS * int(need.sum())
    steps = -(-slots // STEP)

    def sources(step: int) -> np.ndarray:
        at = np.arange(step * STEP, min(slots, (step + 1) * STEP), dtype=np.uint64)
        points = (at * _GOLDEN).astype(np.float64) / 2.0**64
        return np.minimum(np.searchsorted(edges, points, "right"), len(edges) - 1)

    def count(batches):
        for batch in batches:
            for step in batch.column(0).to_pylist():
                found = np.bincount(sources(step), minlength=len(edges))
                used = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), step)), pa.array(used.astype(np.int32)), pa.array(found[used])],
                    names=["step", "source", "n"],
                )

    def place(batches):
        for batch in batches:
            for step, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = sources(step)
                order = np.argsort(source, kind="stable")
                first = np.zeros(len(edges), np.int64)
                for x in starts:
                    first[x["source"]] = x["before"]
                inner = np.arange(len(order)) - np.searchsorted(source[order], source[order])
                rank = np.empty(len(order), np.int64)
                rank[order] = first[source[order]] + inner
                keep = rank < need[source]
                slot, source, rank = step * STEP + np.flatnonzero(keep), source[keep], rank[keep]
                at = rank % blocks[source]
                begin = rank // blocks[source] * sizes[source] + at * block
                length = np.minimum(block, sizes[source] - at * block)
                take = np.minimum(length, goal[source] - begin)
                columns = [slot, source.astype(np.int32), rank, at, take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["slot", "source", "rank", "block", "take"]
                )

    numbers = spark.range(0, steps, 1, max(1, min(steps, 1 << 16)))
    counts = numbers.mapInArrow(count, "step long, source int, n long")
    before = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.groupBy("step").agg(F.collect_list(F.struct("source", "before")).alias("starts"))
    return starts.mapInArrow(place, "slot long, source int, rank long, block long, take long")


def _slots_of(goal: int, words: int, block: int) -> int:
    """Slots that a source needs to be taken goal words: whole rounds of its blocks, then the rest."""
    if goal <= 0 or words <= 0:
        return 0
    return goal // words * -(-words // block) + -(-(goal % words) // block)


def _shuffled(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    """docs(__source, size) with __start long: the words before a document on its source's line.

    The order is that of a hash. A source is summed up in buckets of that hash
    and then within each bucket, so that no task holds a whole source.
    """
    buckets = max(64, -(-rows // PER_BUCKET))
    hashed = docs.withColumn("__hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("__tie")))
    hashed = hashed.withColumn("__bucket", F.pmod("__hash", F.lit(buckets)))
    sums = hashed.groupBy("__source", "__bucket").agg(F.sum("size").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(
        sums.select("__source", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    )
    inner = (
        Window.partitionBy("__source", "__bucket")
        .orderBy("__hash", "doc_id", "__tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        hashed.withColumn("__through", F.sum("size").over(inner))
        .join(bounded(starts), ["__source", "__bucket"])
        .withColumn("__start", F.col("__first") + F.col("__through") - F.col("size"))
        .drop("__hash", "__bucket", "__through", "__first")
    )


def _text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def mix_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total: float = TOTAL,
    block: int = BLOCK_WORDS,
    seed: int = 4,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (and source, text_crc32).

    size is the number of words. The sources in code point order, null last,
    weigh weights in turn and share total times all words; see
    capped_targets(). taken is the words that the schedule's slots take from
    the document, at most twice its size. Documents without words are never
    taken. Rows that repeat are documents of their own. The schedule has one
    weight for each source, which the driver holds. Columns of docs other than
    doc_id, text and source are ignored; an empty table gives an empty result.
    """
    narrow = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), _text_crc32(F.col("text")).alias("__tie")
    )
    narrow = checkpointed(narrow)
    found = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    cycle = [weights[i % len(weights)] for i in range(len(found))]
    targets = capped_targets(sizes, cycle, total * sum(sizes))
    spark = docs.sparkSession
    sources = spark.createDataFrame(
        [(r.source, i, r["size"], t) for i, (r, t) in enumerate(zip(found, targets, strict=True))],
        "source string, __source int, source_size long, target double",
    )
    if len(found) <= SOURCES_BROADCAST:
        sources = F.broadcast(sources)
    numbered = narrow.join(sources, narrow.source.eqNullSafe(sources.source)).drop(sources.source)
    lined = checkpointed(_shuffled(numbered, sum(r.rows for r in found), seed))
    pieces = lined.where("size > 0").select(
        "__source",
        "__start",
        F.explode(F.sequence(F.floor(F.col("__start") / block), F.floor((F.col("__start") + F.col("size") - 1) / block))).alias("block"),
        (F.col("__start") + F.col("size")).alias("__end"),
    )
    slots = schedule(spark, targets, sizes, block).select(F.col("source").alias("__source"), "block", "take")
    begin = F.greatest("__start", F.col("block") * block)
    end = F.least("__end", F.col("block") * block + F.col("take"))
    taken = (
        pieces.join(slots, ["__source", "block"])
        .groupBy("__source", "__start")
        .agg(F.sum(F.greatest(end - begin, F.lit(0))).alias("__taken"))
    )
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"), "source", F.col("__tie").alias("text_crc32")]
    # Documents with words have places of their own on the lines; the others take none.
    with_words = lined.where("size > 0").join(taken, ["__source", "__start"], "left").select(*columns)
    return with_words.unionByName(lined.where("size = 0").withColumn("__taken", F.lit(0)).select(*columns))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns.

    A document that is taken in part beyond its whole rounds gives one more row
    with its first words. n_chars is set to the length of the text if docs has
    it. Documents are told apart by doc_id, source and text, so rows that
    repeat all three are taken alike; each may be null.
    """
    key = ["doc_id", "source", "text_crc32"]
    taken = mix_documents(docs, **options).where("taken > 0")
    counts = taken.groupBy(*[F.col(c).alias(f"of_{c}") for c in key]).agg(F.first("size").alias("size"), F.max("taken").alias("taken"))
    counts = checkpointed(counts)
    rows = docs.select(F.struct("*").alias("row"))  # whatever columns docs has, they stay
    same = (
        F.col("row.doc_id").eqNullSafe(F.col("of_doc_id"))
        & F.col("row.source").eqNullSafe(F.col("of_source"))
        & (_text_crc32(F.col("row.text")) == F.col("of_text_crc32"))
    )
    joined = rows.join(bounded(counts), same)
    rounds = joined.withColumn("round", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")))))
    rest = F.least("size", F.col("taken") - (F.col("round") - 1) * F.col("size")).cast("int")
    text = F.when(rest == F.col("size"), F.col("row.text")).otherwise(first_words(F.col("row.text"), rest))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    out = rounds.select("row", text.alias("text"))
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its count-th word."""
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.array_join(F.slice(words, 1, count), "")
