"""Statistics and normalisation of profile columns, as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def by_dimension(rows: DataFrame, *keys: str, vec: str = "vec") -> DataFrame:
    """keys, dim int, x double: one row for each component of a vector."""
    return rows.select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x"))


def column_stats(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """dim, max, min, sum, mean, var (population), count of each component over all rows."""
    x = F.col("x")
    return (
        by_dimension(rows, vec=vec)
        .groupBy("dim")
        .agg(
            F.max(x).alias("max"), F.min(x).alias("min"), F.sum(x).alias("sum"), F.avg(x).alias("mean"),
            F.var_pop(x).alias("var"), F.count(x).alias("count"),
        )
    )


def packed_stats(stats: DataFrame) -> DataFrame:
    """One row with the means and deviations of all dimensions; a variance of 0 raises an error."""
    sd = F.when(F.col("var") > 0, F.sqrt("var")).otherwise(F.raise_error(F.lit("a dimension has no variance")).cast("double"))
    ordered = F.sort_array(F.collect_list(F.struct("dim", F.col("mean").alias("mean"), sd.alias("sd"))))
    return stats.agg(ordered.alias("s")).select(F.col("s.mean").alias("means"), F.col("s.sd").alias("deviations"))


def normalise(rows: DataFrame, stats: DataFrame, vec: str = "vec") -> DataFrame:
    """rows with z-scores in place of their vectors.

    The statistics are one row, so the join is a broadcast of one vector pair.
    """
    scaled = F.zip_with(
        F.zip_with(F.col(vec).cast("array<double>"), F.col("means"), lambda x, m: x - m), F.col("deviations"), lambda x, s: x / s
    )
    return rows.join(F.broadcast(packed_stats(stats))).withColumn(vec, scaled).drop("means", "deviations")


def mean_vectors(rows: DataFrame, *keys: str, weight: str | None = None, vec: str = "vec") -> DataFrame:
    """keys, dim, mean: mean of each component, weighted if a column is named.

    Weights without a positive sum raise an error.
    """
    if weight is None:
        return by_dimension(rows, *keys, vec=vec).groupBy(*keys, "dim").agg(F.avg("x").alias("mean"))
    sums = by_dimension(rows.withColumn("w", F.col(weight).cast("double")), *keys, "w", vec=vec).groupBy(*keys, "dim")
    sums = sums.agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("w"))
    checked = F.when(F.col("w") > 0, F.col("w")).otherwise(F.raise_error(F.lit("weights must have a positive sum")).cast("double"))
    return sums.select(*keys, "dim", (F.col("wx") / checked).alias("mean"))


def pack_vectors(rows: DataFrame, *keys: str, value: str = "mean") -> DataFrame:
    """keys, vec array<double>: long rows of (keys, dim, value) as vectors."""
    ordered = F.sort_array(F.collect_list(F.struct("dim", F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(ordered.alias("s")).select(*keys, F.col("s.v").alias("vec"))


def without_neighbourhood(rows: DataFrame, seq: str = "name", vec: str = "vec") -> DataFrame:
    """seq, pos, dim, x: components less half the mean of those 2, 3 and 4 positions away.

    Positions beyond the ends are passed over; without any such position the
    result is NaN.
    """
    long = by_dimension(rows, seq, "pos", vec=vec)
    order = Window.partitionBy(seq, "dim").orderBy("pos")
    before, after = order.rowsBetween(-4, -2), order.rowsBetween(2, 4)
    both = lambda f: F.coalesce(f("x").over(before), F.lit(0)) + F.coalesce(f("x").over(after), F.lit(0))
    near = F.when(both(F.count) > 0, both(F.sum) / both(F.count)).otherwise(F.lit(float("nan")))
    return long.select(seq, "pos", "dim", (F.col("x") - near / 2).alias("x"))


def henikoff_weights(aligned: DataFrame, seq: str = "name", text: str = "aligned") -> DataFrame:
    """seq, weight: position-based weights of aligned sequences; they sum to 1.

    In each column a sequence gets 1 / (different characters * sequences with
    its character); gaps count as a character.
    """
    chars = aligned.select(seq, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("col", "ch"))
    same = chars.groupBy("col", "ch").agg(F.count("*").alias("n"))
    kinds = same.groupBy("col").agg(F.count("*").alias("kinds"))
    share = same.join(kinds, "col").select("col", "ch", (1 / F.col("n") / F.col("kinds")).alias("share"))
    sums = chars.join(share, ["col", "ch"]).groupBy(seq).agg(F.sum("share").alias("weight"))
    everything = sums.agg(F.sum("weight").alias("total"))
    return sums.join(F.broadcast(everything)).select(
        seq, F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(F.col("weight")).alias("weight")
    )


def feature_robustness(base: DataFrame, shifted: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """dim, absdiff: summed distance of components between base and trimmed records.

    base has (seq, pos, vec), shifted (seq, offset, pos, vec) with positions
    counted from its own start. With statistics, distances are in deviations.
    """
    b = base.select("seq", "pos", F.col("vec").cast("array<double>").alias("base_vec"))
    s = shifted.select("seq", (F.col("pos") + F.col("offset")).alias("pos"), F.col("vec").cast("array<double>").alias("vec"))
    # Vectors are joined whole; only their distances are taken apart.
    distance = F.zip_with("base_vec", "vec", lambda x, y: F.abs(x - y))
    parts = b.join(s, ["seq", "pos"]).select(F.posexplode(distance).alias("dim", "x"))
    sums = parts.groupBy("dim").agg(F.sum("x").alias("absdiff"))
    if stats is None:
        return sums
    return sums.join(F.broadcast(stats.select("dim", "var")), "dim").select("dim", (F.col("absdiff") / F.sqrt("var")).alias("absdiff"))


def robust_dimensions(robustness: DataFrame, k: int) -> DataFrame:
    """The k dimensions that differ least."""
    return robustness.orderBy("absdiff", "dim").limit(k).select("dim")
