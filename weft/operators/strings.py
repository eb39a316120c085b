"""Aligned strings, A3M, fragments, record picking and sum-of-pairs scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def pair_to_a3m(query: Column, subject: Column) -> Column:
    """A3M of a subject from an aligned pair: columns of two gaps go, insertions are lower case."""
    joined = F.zip_with(
        _chars(query), _chars(subject),
        lambda q, s: F.when((q == "-") & (s == "-"), "").when(q == "-", F.lower(s)).otherwise(F.upper(s)),
    )
    return F.array_join(joined, "")


def a3m_to_pair(query: Column, a3m: Column) -> Column:
    """The query of an A3M entry with gaps where the entry has insertions."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, c):
        inserted = c.rlike("[a-z]")
        following = F.substring_index(F.lit(""), "", 1)  # empty
        taken = F.when(inserted, F.lit("-")).otherwise(F.coalesce(F.get(_chars(query), state["at"]), following))
        return F.struct((state["at"] + F.when(inserted, 0).otherwise(1)).alias("at"), F.concat(state["out"], taken).alias("out"))

    return F.aggregate(_chars(a3m), start, step, lambda s: s["out"])


def render(residues: Column, columns: Column, length: Column) -> Column:
    """The aligned string of a member: its residues at their ascending columns, gaps elsewhere."""
    before = F.transform(columns, lambda c, i: c - F.coalesce(F.when(i > 0, F.get(columns, i - 1)), F.lit(-1)) - 1)
    placed = F.zip_with(_chars(residues), before, lambda r, n: F.concat(F.repeat(F.lit("-"), n), r))
    last = F.when(F.size(columns) > 0, F.get(columns, F.size(columns) - 1)).otherwise(F.lit(-1))
    return F.concat(F.array_join(placed, ""), F.repeat(F.lit("-"), length - last - 1))


def crop_fragments(fasta: DataFrame, size: int, shift: int) -> DataFrame:
    """name, start, fragment: overlapping windows of sequences (name, seq).

    Only letters A-Z without J are kept, in upper case. The last window ends at
    the sequence's end; a sequence within size is one window.
    """
    clean = F.regexp_replace(F.upper("seq"), "[^A-IK-Z]", "")
    kept = fasta.select("name", clean.alias("seq")).where(F.length("seq") > 0)
    last = F.greatest(F.length("seq") - size, F.lit(0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), last + shift - 1, F.lit(shift)), lambda s: F.least(s, last)))
    return kept.select("name", "seq", F.explode(starts).alias("start")).select(
        "name", "start", F.col("seq").substr(F.col("start") + 1, F.lit(size)).alias("fragment")
    )


def merge_fragments(fragments: DataFrame, cut: int) -> DataFrame:
    """name, pos, dim, x: means over the fragments that cover a position.

    fragments has (name, start, length, total, vecs). At an end that is not the
    sequence's, cut positions of a fragment don't count.
    """
    rows = fragments.select("name", "start", "length", "total", F.posexplode("vecs").alias("k", "vec"))
    first = F.when(F.col("start") > 0, cut).otherwise(0)
    end = F.col("length") - F.when(F.col("start") + F.col("length") < F.col("total"), cut).otherwise(0)
    kept = rows.where((F.col("k") >= first) & (F.col("k") < end)).withColumn("pos", F.col("start") + F.col("k"))
    parts = kept.select("name", "pos", F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x"))
    return parts.groupBy("name", "pos", "dim").agg(F.avg("x").alias("x"))


def pick_records(records: DataFrame, targets: DataFrame) -> DataFrame:
    """The records whose first word of the name is in targets(target)."""
    word = F.regexp_extract("name", r"^(\S+)", 1)
    return records.join(targets, word == targets.target, "left_semi")


def safe_file_name(name: Column) -> Column:
    """A record's name as the name of a file of its own."""
    return F.concat(F.regexp_replace(F.regexp_extract(name, r"^(\S*)", 1), "[^A-Za-z0-9._-]", "_"), F.lit(".gz"))


def write_split(records: DataFrame, path: str) -> None:
    """One folder of gzip text for each record (name, line)."""
    named = records.select(safe_file_name(F.col("name")).alias("record"), "line")
    named.write.mode("overwrite").partitionBy("record").option("compression", "gzip").text(path)


def sample_records(records: DataFrame, n: int, seed: int, key: str = "name") -> DataFrame:
    """n records without replacement, the same ones for the same seed."""
    return records.orderBy(F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def residue_columns(aligned: DataFrame) -> DataFrame:
    """key, col, k: the column of each residue of aligned strings (key, aligned)."""
    chars = aligned.select("key", F.posexplode(_chars(F.col("aligned"))).alias("col", "ch")).where("ch NOT IN ('-', '.')")
    return chars.select("key", "col", (F.row_number().over(Window.partitionBy("key").orderBy("col")) - 1).alias("k"))


def pairs_of_residues(aligned: DataFrame) -> DataFrame:
    """a, b, ka, kb: residues of two sequences (a < b) that stand in one column."""
    r = residue_columns(aligned)
    a = r.select(F.col("key").alias("a"), "col", F.col("k").alias("ka"))
    b = r.select(F.col("key").alias("b"), "col", F.col("k").alias("kb"))
    return a.join(b, "col").where("a < b").drop("col")


def _keyed(aligned: DataFrame) -> DataFrame:
    """key, aligned: sequences known by their residues in upper case."""
    return aligned.select(F.upper(F.regexp_replace("aligned", "[-.]", "")).alias("key"), F.upper("aligned").alias("aligned"))


def _all_held(reference: DataFrame, test: DataFrame) -> None:
    lacking = reference.join(test, "key", "left_anti").count()
    if lacking:
        raise ValueError(f"{lacking} sequences are missing")


def sum_of_pairs_total(reference: DataFrame, test: DataFrame) -> DataFrame:
    """matched, total, score: pairs of all residues of a reference alignment (aligned) that a test alignment holds, in one row.

    Residues are counted by their column in either alignment: n of them that
    share both columns are n (n - 1) / 2 pairs held, n that share the
    reference's are as many pairs of it. So the work is linear in residues,
    where sum_of_pairs() has a row for each pair. Of sequences that repeat
    their residues the first aligned string in order counts. A sequence of the
    reference that the test lacks raises an error; no pairs give score null.
    """
    one = lambda df: _keyed(df).groupBy("key").agg(F.min("aligned").alias("aligned"))
    reference, test = one(reference), one(test)
    _all_held(reference, test)
    places = residue_columns(reference).join(residue_columns(test).withColumnRenamed("col", "test_col"), ["key", "k"])
    cells = places.groupBy("col", "test_col").agg(F.count("*").alias("n"))
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    columns = cells.groupBy("col").agg(F.sum(pairs(F.col("n"))).alias("matched"), F.sum("n").alias("n"))
    whole = columns.agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).alias("total"))
    return whole.select("matched", "total", (F.col("matched") / F.nullif(F.col("total"), F.lit(0))).alias("score"))


def sum_of_pairs(reference: DataFrame, test: DataFrame) -> DataFrame:
    """a, b, matched, total: pairs of the reference alignment that a test alignment holds.

    Both have (aligned); sequences are known by their residues in upper case.
    A sequence of the reference that the test lacks raises an error.
    """
    reference, test = _keyed(reference), _keyed(test)
    _all_held(reference, test)
    held = pairs_of_residues(test).withColumn("held", F.lit(1))
    joined = pairs_of_residues(reference).join(held, ["a", "b", "ka", "kb"], "left")
    return joined.groupBy("a", "b").agg(F.count("held").alias("matched"), F.count("*").alias("total"))
