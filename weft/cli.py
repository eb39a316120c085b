"""Runs from a command line: statistics, pairwise search or multiple alignment of files."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.operators import alignment as A, multiple, stats
from weft.options import parse_arguments
from weft.sources import sinks, text


def normalise_profiles(profiles: DataFrame, statistics: DataFrame) -> DataFrame:
    """Long profiles with z-scores; the rows that stand for ends keep their zeros."""
    inner = stats.normalise(profiles.where("residue IS NOT NULL"), statistics)
    inner = inner.withColumn("vec", F.col("vec").cast("array<float>"))
    return inner.select(*profiles.columns).unionByName(profiles.where("residue IS NULL"))


def run(spark: SparkSession, arguments: list[str]) -> dict[str, DataFrame]:
    """Does what the arguments say and returns the results that were written.

    stats, a3m, aligned and matrix are the names of results. Sequences of a
    FASTA file are compared by the substitution matrix; otherwise profiles come
    from the files of --in and of the lists of --in_list, in this order.
    """
    options, files = parse_arguments(arguments)
    done: dict[str, DataFrame] = {}
    if "in_fasta" in files:
        profiles = text.fasta_profiles(text.read_fasta(spark, files["in_fasta"].split(",")))
    else:
        paths = [p for p in files.get("in", "").split(",") if p]
        if "in_list" in files:
            paths += text.read_list(spark, files["in_list"].split(","))
        profiles = text.read_gmat(spark, paths)
    if "in_stats" in files:
        statistics = text.read_stats(spark, files["in_stats"])
    else:
        statistics = stats.column_stats(profiles.where("residue IS NOT NULL"))
    if "out_stats" in files:
        done["stats"] = statistics
        sinks.save_lines(statistics.select("dim", text.stats_line().alias("line")), files["out_stats"], ["dim"])
    if "out" not in files:
        return done
    if options.normalize:
        profiles = normalise_profiles(profiles, statistics)
    packed = A.pack_profiles(profiles)
    if options.a3m_pairwise:
        first = packed.select("seq_ord", "name").orderBy("seq_ord").first()
        query = A.one_profile(packed.where(F.col("seq_ord") == first.seq_ord))
        found = A.a3m_search(query, packed.where(F.col("seq_ord") > first.seq_ord), options)
        head = spark.createDataFrame([(first.seq_ord, first.name, query.residues[0])], "seq_ord int, name string, a3m string")
        lines = sinks.fasta_lines(head.unionByName(found.select("seq_ord", "name", "a3m")), "a3m")
        sinks.save_lines(lines, files["out"], ["seq_ord", "part"])
        done["a3m"] = found
        return done
    found = multiple.multiple_alignment(packed, options)
    aligned = multiple.aligned_rows(packed, found).drop("root")
    sinks.save_lines(sinks.fasta_lines(aligned), files["out"], ["seq_ord", "part"])
    done["aligned"] = aligned
    if "out_matrix" in files:
        done["matrix"] = multiple.merged_profile(packed, found)
        sinks.save_lines(sinks.gmat_lines(done["matrix"]), files["out_matrix"], ["seq_ord", "pos", "part"])
    return done


def main() -> None:
    spark = SparkSession.builder.appName("weft").getOrCreate()
    for name, rows in run(spark, sys.argv[1:]).items():
        if name == "a3m":
            rows.select("name", "score", "positive_count", "profile_length").show(1_000_000, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
