"""Lineage cuts in the folder that driver and executors share, broadcasts behind a count, and sizes of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F

#: A lookup table of at most this many (long, long) rows is broadcast; larger
#: ones go through a shuffled join. 500,000 rows are about 32 MB when hashed.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch that a task exchanges with Python, about.
BATCH_BYTES = 4 << 20
#: Rows of a page of a Parquet column at most, if its size does not end it before.
PAGE_ROWS = 1 << 20


def shared_folder(spark) -> str:
    """The checkpoint folder that the driver and all executors share; a temporary one on a single machine without a setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as a table in that folder, for loops: a checkpoint keeps what is known of columns, and that grows with each step."""
    path = f"{shared_folder(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows at most so many rows.

    df must be cheap to count (checkpointed). Beyond the bound Spark shuffles
    both sides and splits skewed partitions.
    """
    return F.broadcast(df) if df.count() <= rows else df


def small_batches(spark) -> None:
    """Arrow batches of at most BATCH_BYTES, from here on in this session.

    A batch is held several times over by the executor and by Python; by
    default it may have 64 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if size is None or not 0 < int(size[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def large_pages(spark) -> None:
    """Pages of Parquet columns that end by size, not after 20,000 rows, from here on in this session, unless it has a limit.

    A writer looks at a column's first page alone to tell whether a dictionary
    pays off. Among 20,000 scores few are equal, among some millions most are.
    """
    name = "parquet.page.row.count.limit"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(PAGE_ROWS))
