"""Shared pieces: word counts, column-appending Arrow maps and runs of rows."""

from __future__ import annotations

import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from weft.lineage import BATCH_BYTES as BATCH_BYTES, small_batches

#: The white space of the word contracts: space, \t, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]"

#: Name under which a worker process keeps its token encoders.
ENCODERS = "_weft_encoders"


def release_memory() -> None:
    """Give back what a task has freed: an idle Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def forget_encoders() -> None:
    """Drop the token pieces that this worker remembers: it has turned to another operator."""
    if sys.modules.pop(ENCODERS, None) is not None:
        gc.collect()
        release_memory()


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; 0 for null."""
    trimmed = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    count = F.size(F.split(trimmed, f"{SPACE}+", -1))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(count).cast("long")


def bound(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def append_columns(df: DataFrame, inputs: list[str], make, fields: str) -> DataFrame:
    """df with the columns named in fields (DDL) computed batch by batch.

    make() runs once in each task and returns a function from the input
    columns (Arrow arrays) to a list of Arrow arrays. Columns of df that clash
    with new names are replaced.
    """
    added = StructType.fromDDL(fields)
    names = [f.name for f in added.fields]
    df = df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])
    schema = StructType([*df.schema.fields, *added.fields])
    where = [df.columns.index(c) for c in inputs]
    count = len(df.columns)

    def run(batches):
        compute = make()
        for batch in batches:
            new = compute(*[batch.column(i) for i in where])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(count)), *new], names=schema_names
            )
        del compute
        release_memory()

    schema_names = schema.fieldNames()
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def runs(batches, column: str, size: int, rows: int | None = None, key: str | None = None):
    """Tables of rows that follow each other: as many as have size bytes in a binary column, and not over rows.

    A longer value is a table by itself. Rows of different keys are never in one table.
    """
    held, count, total, mine = [], 0, 0, None
    for batch in batches:
        through = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        keys = batch.column(key).to_numpy(zero_copy_only=False) if key else np.zeros(batch.num_rows, np.int64)
        changes = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        at = 0
        while at < batch.num_rows:
            before = int(through[at - 1]) if at else 0
            stop = min(int(np.searchsorted(through, before + size - total, "right")), next(c for c in changes if c > at))
            if rows:
                stop = min(stop, at + rows - count)
            if held and (stop <= at or keys[at] != mine):
                yield pa.Table.from_batches(held)
                held, count, total = [], 0, 0
                continue
            stop, mine = max(stop, at + 1), keys[at]
            held.append(batch.slice(at, stop - at))
            count, total = count + stop - at, total + int(through[stop - 1]) - before
            at = stop
    if held:
        yield pa.Table.from_batches(held)


def binary_values(column: pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column, joined, as numbers of a type, and how many each row has."""
    joined = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    counts = pc.binary_length(joined).to_numpy(zero_copy_only=False) // dtype.itemsize
    _, offsets, data = joined.buffers()
    first = int(np.frombuffer(offsets, np.int64)[joined.offset]) if len(joined) else 0
    total = int(counts.sum())
    return (np.frombuffer(data, dtype, total, first) if total else np.zeros(0, dtype)), counts


def forest(edges):
    """A spanning forest of (a, b) pairs: [(node, smallest node of its tree)]."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root) for x in list(parent) if (root := find(x)) != x]
