"""A3M search over a stream of target profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weft.functions.dynamic import Profile
from weft.operators.alignment import a3m_search
from weft.options import AlignOptions

#: Schema of packed targets in files.
TARGETS = (
    "seq_ord int, name string, columns array<struct<pos:int,residue:string,vec:array<double>,"
    "match_ratio:double,del_ratio:double,match_to_del:double,del_to_del:double>>"
)


def stream_search(spark, folder: str, query: Profile, options: AlignOptions, files_per_batch: int = 8) -> DataFrame:
    """A streaming DataFrame of A3M rows for packed targets that arrive as Parquet files.

    The search keeps no state: every target is aligned with the query when its
    file arrives.
    """
    targets = spark.readStream.schema(TARGETS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return a3m_search(query, targets, options)


def run_search(results: DataFrame, path: str, checkpoint: str):
    """Append results to Parquet until all files that are there have been read."""
    writer = results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
