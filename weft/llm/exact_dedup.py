"""Exact dedup through counting quotient filters.

Fingerprints of normalised texts go into one counting quotient filter per
partition and range of fingerprints. The filters of a range merge without loss
by their sorted remainders. Only texts whose fingerprint has a count above one
are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weft.lineage import bounded, checkpointed

#: Bits of a fingerprint. A collision costs one more comparison, no more.
BITS = 48
#: Fingerprints that one merge should hold at most, on average.
PER_RANGE = 1 << 20


class CountingQuotientFilter:
    """Multiset of fingerprints: quotients as a bitmap, sorted remainders in runs.

    occupied has a bit for each quotient; run_end has a bit for each entry and
    is set at the last entry of its quotient. Remainders are sorted inside a
    run and each has an exact counter. The slots are packed by rank, so that a
    lookup is a rank on occupied and a select on run_end.
    """

    def __init__(self, bits, quotient_bits, occupied, run_end, remainders, counts):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.run_end = occupied, run_end
        self.remainders, self.counts = remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int, counts: np.ndarray | None = None):
        """From fingerprints below 2**bits in any order, each once or with a count."""
        fingerprints = np.asarray(fingerprints, np.uint64)
        order = np.argsort(fingerprints, kind="stable")
        ordered = fingerprints[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
        weights = np.ones(len(ordered), np.int64) if counts is None else np.asarray(counts, np.int64)[order]
        total = np.add.reduceat(weights, starts) if len(starts) else np.zeros(0, np.int64)
        unique = ordered[starts]
        quotient_bits = min(bits, max(3, int(len(unique)).bit_length()))
        rest = np.uint64(bits - quotient_bits)
        quotient = (unique >> rest).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotient] = True
        run_end = np.r_[quotient[1:] != quotient[:-1], True][: len(quotient)]
        remainders = unique & np.uint64((1 << int(rest)) - 1)
        return cls(bits, quotient_bits, occupied, run_end, remainders, total)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending fingerprints and their counts."""
        if not len(self.remainders):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        run = np.cumsum(np.r_[0, self.run_end[:-1]])
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotient << np.uint64(self.bits - self.quotient_bits)) | self.remainders, self.counts

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was added."""
        rest = self.bits - self.quotient_bits
        quotient, remainder = fingerprint >> rest, fingerprint & ((1 << rest) - 1)
        if not self.occupied[quotient]:
            return 0
        rank = int(self.occupied[:quotient].sum())
        ends = np.flatnonzero(self.run_end)
        low, high = (int(ends[rank - 1]) + 1 if rank else 0), int(ends[rank]) + 1
        at = low + int(np.searchsorted(self.remainders[low:high], np.uint64(remainder)))
        return int(self.counts[at]) if at < high and int(self.remainders[at]) == remainder else 0

    @classmethod
    def merge(cls, filters: list["CountingQuotientFilter"], bits: int):
        """One filter with the sums of all counters."""
        parts = [f.items() for f in filters]
        keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        return cls.build(keys, bits, counts)

    def to_bytes(self) -> bytes:
        """Header, bitmaps, remainders in whole bytes, and the counters above one."""
        width = -(-(self.bits - self.quotient_bits) // 8)
        many = np.flatnonzero(self.counts > 1)
        head = np.array([self.bits, self.quotient_bits, len(self.remainders), len(many)], "<i8")
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return b"".join((
            head.tobytes(), np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(),
            np.ascontiguousarray(low).tobytes(), many.astype("<i8").tobytes(), self.counts[many].astype("<i8").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, data: bytes):
        bits, quotient_bits, size, many = np.frombuffer(data, "<i8", 4).tolist()
        width, at = -(-(bits - quotient_bits) // 8), 32

        def take(n):
            nonlocal at
            at += n
            return np.frombuffer(data, np.uint8, n, at - n)

        occupied = np.unpackbits(take(-(-(1 << quotient_bits) // 8)), count=1 << quotient_bits).astype(bool)
        run_end = np.unpackbits(take(-(-size // 8)), count=size).astype(bool)
        full = np.zeros((size, 8), np.uint8)
        full[:, :width] = take(size * width).reshape(size, width)
        counts = np.ones(size, np.int64)
        where, values = take(8 * many).view("<i8"), take(8 * many).view("<i8")
        counts[where] = values
        return cls(bits, quotient_bits, occupied, run_end, full.view("<u8").ravel().astype(np.uint64), counts)


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes the empty text."""
    # Only runs that are not a single space already are touched.
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def fingerprint(text: Column) -> Column:
    """The low BITS bits of XXH64."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << BITS) - 1))


def repeated_fingerprints(marks: DataFrame, rows: int) -> DataFrame:
    """Column fp: the fingerprints that marks(fp) holds more than once.

    Each partition of marks sends one filter for each range of fingerprints;
    the number of ranges follows the number of rows, so a merge stays small. A
    fingerprint of many rows is one entry with a counter in every filter.
    """
    range_bits = max(3, min(BITS - 8, (rows // PER_RANGE).bit_length() + 3))
    rest = BITS - range_bits

    def build(batches):
        parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) for b in batches]
        all_fps = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        ranges = (all_fps >> np.uint64(rest)).astype(np.int64)
        for at in np.unique(ranges).tolist():
            low, high = np.searchsorted(ranges, [at, at + 1])
            inside = all_fps[low:high] & np.uint64((1 << rest) - 1)
            data = CountingQuotientFilter.build(inside, rest).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["range", "cqf"])

    def merge(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            found = [CountingQuotientFilter.from_bytes(x) for x in batch.column("cqf").to_pylist()]
            whole = CountingQuotientFilter.merge(found if whole is None else [whole, *found], rest)
        fps, counts = whole.items()
        again = fps[counts > 1] | np.uint64(key[0].as_py() << rest)
        yield pa.RecordBatch.from_arrays([pa.array(again.astype(np.int64))], names=["fp"])

    filters = marks.select("fp").mapInArrow(build, "range long, cqf binary")
    return filters.groupBy("range").applyInArrow(merge, "fp long")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after normalised(); a null text counts as
    empty. keep_id is the smallest doc_id of the group (null ids are passed
    over; a group of null ids has keep_id null and keeps its rows). doc_id is
    taken to be a key: rows that repeat both doc_id and text count in
    group_size and share their fate. Other columns of docs are ignored. An
    empty table gives an empty result.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm"))
    texts = texts.withColumn("fp", fingerprint(F.col("norm")))
    marks = checkpointed(texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")))
    again = checkpointed(repeated_fingerprints(marks, marks.count()))
    # Equal bytes meet in one row of the aggregation, first inside each task.
    groups = checkpointed(
        texts.join(bounded(again), "fp", "left_semi")
        .groupBy("norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    joined = marks.drop("fp").join(bounded(groups, 200_000), "text_sha256", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )
