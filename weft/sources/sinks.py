"""Writers of aligned FASTA, A3M, profile and statistics text.

Outputs have an order: rows are sorted over all partitions, so the parts of a
folder make the text in the order of their names. Small outputs are one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def save_lines(lines: DataFrame, path: str, order: list[str], compressed: bool | None = None) -> None:
    """Write column line in the given order, in parts that follow each other; gzip if the path ends so. Overwrites."""
    squeeze = path.endswith(".gz") if compressed is None else compressed
    ordered = lines.orderBy(*order).select("line")
    ordered.write.mode("overwrite").option("compression", "gzip" if squeeze else "none").text(path)


def fasta_lines(aligned: DataFrame, text: str = "aligned") -> DataFrame:
    """seq_ord, part, line: a header and a sequence line for each row of aligned(seq_ord, name, text)."""
    parts = F.array(F.concat(F.lit(">"), "name"), F.col(text))
    return aligned.select("seq_ord", F.posexplode(parts).alias("part", "line"))


def gmat_lines(profiles: DataFrame) -> DataFrame:
    """seq_ord, pos, part, line: the lines of profiles in long form.

    A header, then a line of gap state and a line of residue and values for
    each position, with five decimals, and the state of the end.
    """
    number = lambda c: F.format_string("%.5f", c.cast("double"))
    state = F.concat_ws("\t", F.lit("@"), *[number(F.col(c)) for c in ("match_ratio", "del_ratio", "match_to_del", "del_to_del")])
    values = F.concat_ws("\t", F.col("residue"), F.concat_ws("\t", F.transform("vec", number)))
    header = F.when(F.col("pos") == 0, F.concat(F.lit(">"), "name"))
    lines = F.array(header, state, F.when(F.col("residue").isNotNull(), values))
    return profiles.select("seq_ord", "pos", F.posexplode(lines).alias("part", "line")).where("line IS NOT NULL")
