"""Packing of token sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import binary_values, release_memory, runs
from weft.llm.tokens import id_type, with_ids

#: Documents of a group at most, and bytes of their ids, unless it is one document. A group wastes less than one sequence.
GROUP_DOCUMENTS, GROUP_BYTES = 1024, 8 << 20
_PIECES = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class TournamentTree:
    """Free capacities of bins under a tree of maxima: finds the first bin that fits."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.size)

    def first(self, need: int) -> int:
        """The lowest bin with need free. With as many bins as items there is one."""
        at = 1
        while at < self.size:
            at *= 2
            if self.best[at] < need:
                at += 1
        return at - self.size

    def take(self, bin_: int, amount: int) -> int:
        """Fill part of a bin; returns what was free before."""
        at = bin_ + self.size
        free = self.best[at]
        self.best[at] = free - amount
        while at > 1:
            at //= 2
            larger = max(self.best[2 * at], self.best[2 * at + 1])
            if self.best[at] == larger:
                break
            self.best[at] = larger
        return free


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start in item, length), each within capacity.

    Full bins of an item come first out of it; what is left of the items is
    placed whole, longest first (ties by position). Then the least filled bins
    beyond the smallest number that can hold all are emptied, and their items
    are cut into the gaps of the others: padding stays below one bin.
    """
    bins: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for item, length in enumerate(lengths):
        full = length - length % capacity
        bins += [[(item, at, capacity)] for at in range(0, full, capacity)]
        if length > full:
            rest.append((item, full, length - full))
    rest.sort(key=lambda x: -x[2])
    tree = TournamentTree(len(rest), capacity)
    packed: list[list[tuple[int, int, int]]] = []
    for piece in rest:
        at = tree.first(piece[2])
        tree.take(at, piece[2])
        if at == len(packed):
            packed.append([])
        packed[at].append(piece)
    fill = [sum(p[2] for p in b) for b in packed]
    least = -(-sum(fill) // capacity)
    order = sorted(range(len(packed)), key=lambda b: (-fill[b], b))
    kept, emptied = sorted(order[:least]), sorted(order[least:])
    at = 0
    for item, start, length in (p for b in emptied for p in packed[b]):
        while length:
            while fill[kept[at]] == capacity:
                at += 1
            part = min(length, capacity - fill[kept[at]])
            packed[kept[at]].append((item, start, part))
            fill[kept[at]] += part
            start, length = start + part, length - part
    return bins + [packed[b] for b in kept]


def pack_ids(encoded: DataFrame, dtype: np.dtype, capacity: int = 1024, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The pieces of encoded(doc_id, ids) in sequences of at most capacity tokens.

    ids are arrays of type dtype as bytes. Rows are dealt and ordered by a hash
    of doc_id and ids (null is an id like any other), and each run of
    GROUP_DOCUMENTS rows or group_bytes of ids is packed by itself: a task holds
    one such run, or one row that has more. sequence_id is the partition's
    number shifted by 32 bits and the sequence's number inside it. An empty row
    gives no piece; rows that repeat a doc_id are packed each. Capacity must be
    positive.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    schema = _PIECES.format(id=encoded.schema["doc_id"].dataType.simpleString())

    def pack(batches):
        done = 0
        for table in runs(batches, "ids", group_bytes, GROUP_DOCUMENTS):
            found, counts = binary_values(table.column("ids"), dtype)
            ids, begins = found.astype("<u4"), np.cumsum(counts) - counts
            sequences = first_fit_decreasing(counts.tolist(), capacity)
            pieces = np.array([(i, first, size, n) for n, s in enumerate(sequences) for i, first, size in s], np.int64).reshape(-1, 4)
            item, start, length, sequence = pieces.T
            at = begins[item] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            through = np.cumsum(length) - length
            offset = through - through[np.searchsorted(sequence, sequence)]
            number = (TaskContext.get().partitionId() << 32) + done + sequence
            done += len(sequences)
            doc_ids = table.column("doc_id").combine_chunks().take(pa.array(item))
            columns = [start, length, np.array(crc, np.int64), counts[item], number, offset]
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, pa.int64()) for c in columns)], names=names)
        release_memory()

    names = [f.split()[0] for f in schema.split(", ")]
    key = F.xxhash64(F.col("doc_id").cast("string"), F.crc32("ids"), F.lit(6))
    dealt = encoded.select("doc_id", "ids", key.alias("key")).repartition("key").sortWithinPartitions("key", "doc_id", "ids")
    return dealt.mapInArrow(pack, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, special_tokens: bool = True
) -> DataFrame:
    """Pieces of all documents: each whole text's ids and end_id (null text: end_id alone).

    Names of special tokens in a text are these tokens, or else ordinary text.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Columns of docs other than doc_id and text are ignored; an empty table
    gives no pieces.
    """
    encoded = with_ids(docs.select("doc_id", "text"), tokenizer, end_id, special_tokens=special_tokens).select("doc_id", "ids")
    return pack_ids(encoded, id_type(tokenizer), capacity)
