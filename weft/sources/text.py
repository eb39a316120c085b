"""Readers of profile, FASTA, statistics and HMM text files as DataFrames.

Profile and FASTA files are read by record: a large file is split among tasks,
and records keep their numbers in the order of files. Lists, statistics and
HMM texts are one small text a file. Compressed files are decoded by their
suffix (and not split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.functions.blosum import blosum_table
from weft.lineage import bounded, checkpointed

PROFILE = (
    "seq_ord int, name string, pos int, residue string, vec array<float>, "
    "match_ratio float, del_ratio float, match_to_del float, del_to_del float"
)
#: Gap state of positions whose record has none.
DEFAULT_STATE = (("match_ratio", 1.0), ("del_ratio", 0.0), ("match_to_del", 0.0), ("del_to_del", 0.95))


def whole_files(spark, paths: list[str]) -> DataFrame:
    """file_ord int, text string: one row for each file, in the order of paths."""
    files = _text(spark, paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return _in_order(files, paths)


def record_pieces(spark, paths: list[str]) -> DataFrame:
    """file_ord int, block long, row long, text string: files cut in front of every line that begins with >.

    A plain file is read in blocks by as many tasks; block is where one begins
    and row ascends in it. What is in front of a file's first > is a piece of
    its own. The pieces are written once to the shared folder, since a second
    reading could cut the blocks otherwise. A piece holds at most 2 GB; a > that
    is a file's last character starts none.
    """
    files = _text(spark, paths, lineSep="\n>").select(
        F.input_file_name().alias("path"), F.input_file_block_start().alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"),
    )
    pieces = checkpointed(_in_order(files, paths))
    heads = pieces.where("block = 0").groupBy("file_ord").agg(F.min("row").alias("head"))  # a row for each file
    cut = pieces.join(F.broadcast(heads), "file_ord")
    return cut.select("file_ord", "block", "row", F.when(F.col("row") == F.col("head"), F.col("text")).otherwise(F.concat(F.lit(">"), "text")).alias("text"))


def _in_order(files: DataFrame, paths: list[str]) -> DataFrame:
    """files with file_ord, the place of their path in paths, instead of path."""
    if len({_tail(p) for p in paths}) < len(paths):
        raise ValueError("a file is listed twice")
    # The list of paths is short: it came from the command line or a list file.
    # As literals it needs no Python worker.
    order = files.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(_tail(p)) for p in paths])).alias("file_ord", "tail"))
    named = files.join(F.broadcast(order), F.expr("endswith(url_decode(path), tail)"))
    return named.select("file_ord", *[c for c in files.columns if c != "path"])


def _text(spark, paths: list[str], **options) -> DataFrame:
    if not paths:
        raise ValueError("no input files")
    return spark.read.text(paths, **options)


def _tail(path: str) -> str:
    return "/" + path.split("://", 1)[-1].lstrip("/").removeprefix("./")


def read_list(spark, paths: list[str]) -> list[str]:
    """The paths in list files: one a line, without blank lines and # comments."""
    lines = whole_files(spark, paths).select("file_ord", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line"))
    line = F.rtrim("line")
    rows = lines.select("file_ord", "n", line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return [r.line for r in rows.orderBy("file_ord", "n").collect()]


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def split_records(files: DataFrame) -> DataFrame:
    """seq_ord, name, lines: the records of GMAT texts, either whole files (file_ord, text) or record_pieces().

    A line that begins with > starts a record and is its name, without blanks
    in front. Lines before the first one make a record named "". Blank lines
    and # comments are left out.
    """
    blocks = F.split(F.concat(F.lit("\n"), "text"), r"[\r\n]+(?=>)")

    def record(block: Column) -> Column:
        every = F.filter(_lines(block), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
        headed = F.ltrim(block, F.lit("\r\n")).startswith(">")
        name = F.when(headed, F.regexp_extract(F.get(every, F.lit(0)), r"^>\s*([^\r\n]*)", 1)).otherwise("")
        return F.struct(name.alias("name"), F.when(headed, F.slice(every, F.lit(2), F.size(every))).otherwise(every).alias("lines"), headed.alias("headed"))

    records = F.filter(F.transform(blocks, record), lambda r: r["headed"] | (F.size(r["lines"]) > 0))
    return numbered(files, records, "seq_ord").select("seq_ord", "item.name", "item.lines")


def numbered(pieces: DataFrame, items: Column, name: str) -> DataFrame:
    """name int, item: the items of all pieces, numbered in the order of files, blocks and rows.

    pieces has (file_ord, text), a row for each file, or also (block, row).
    Only counts of items leave their tasks, one for each block: texts stay
    where they are. That is enough where the pieces of a block hold one item
    each, its first one aside; if not, each piece gets its own place by a join.
    """
    if "row" not in pieces.columns:
        pieces = pieces.withColumns({"block": F.lit(0).cast("long"), "row": F.lit(0).cast("long")})
    held = pieces.withColumn("items", items)
    sizes = held.select("file_ord", "block", "row", F.size("items").alias("n"))
    by_block = sizes.groupBy("file_ord", "block").agg(
        F.sum("n").alias("n"), F.min("row").alias("head"), F.min_by("n", "row").alias("head_n"), F.count_if(F.col("n") != 1).alias("odd")
    )
    before = Window.orderBy("file_ord", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    blocks = checkpointed(by_block.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    placed = held.join(bounded(blocks.select("file_ord", "block", "first", "head", "head_n")), ["file_ord", "block"])
    if blocks.where((F.col("odd") > 1) | ((F.col("odd") == 1) & (F.col("head_n") == 1))).isEmpty():
        inside = F.when(F.col("row") == F.col("head"), F.lit(0)).otherwise(F.col("head_n") + (F.col("row") - F.col("head") - 1))
    else:
        earlier = Window.partitionBy("file_ord", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        places = checkpointed(sizes.select("file_ord", "block", "row", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("inside")))
        placed = placed.join(bounded(places), ["file_ord", "block", "row"])
        inside = F.col("inside")
    rows = placed.select((F.col("first") + inside).alias("start"), F.posexplode("items").alias("k", "item"))
    return rows.select((F.col("start") + F.col("k")).cast("int").alias(name), "item")


def parse_profiles(records: DataFrame) -> DataFrame:
    """Profiles in long form (see PROFILE) from split_records().

    A residue line is a character and its values; a line that starts with @
    has the four numbers of a gap state, one more than there are residues. The
    last row of a record has no residue and holds the state of its end.
    Wrong numbers of fields raise an error.
    """
    tokens = lambda x: F.split(F.trim(x), r"\s+")
    numbers = lambda x: F.transform(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda v: v.cast("float"))
    residues = F.filter("lines", lambda x: ~x.startswith("@"))
    states = F.filter("lines", lambda x: x.startswith("@"))
    packed = records.select("seq_ord", "name", residues.alias("rows"), states.alias("states"))
    counted = (F.size("states") == 0) | (F.size("states") == F.size("rows") + 1)
    malformed = lambda kind: F.raise_error(F.concat(F.lit("malformed record "), "name")).cast(kind)
    # A line goes on alone, beside its own state and the width: lines are taken apart in rows of their own, which carry no others.
    widths = F.array_repeat(F.size(tokens(F.get("rows", F.lit(0)))), F.size("rows") + 1)
    line = F.arrays_zip(F.concat("rows", F.array(F.lit(None).cast("string"))).alias("row"), "states", widths.alias("width"))
    lines = packed.select(
        "seq_ord", "name",
        F.posexplode(F.when(counted, line).otherwise(malformed("array<struct<row:string,states:string,width:int>>"))).alias("pos", "line"),
    ).select("seq_ord", "name", "pos", F.col("line.width").alias("width"), tokens(F.col("line.row")).alias("row"), numbers(tokens(F.col("line.states"))).alias("state"))
    wrong = F.col("row").isNotNull() & ((F.size("row") != F.col("width")) | (F.length(F.get("row", F.lit(0))) != 1))
    lines = lines.withColumns({
        "row": F.when(wrong, malformed("array<string>")).otherwise(F.col("row")),
        "state": F.when(F.col("state").isNotNull() & (F.size("state") != 4), malformed("array<float>")).otherwise(F.col("state")),
    })
    residue = F.get("row", F.lit(0))
    vec = F.when(F.col("row").isNull(), F.array_repeat(F.lit(0).cast("float"), F.col("width") - 1)).otherwise(numbers(F.col("row")))
    return lines.select(
        "seq_ord", "name", "pos", residue.alias("residue"), vec.alias("vec"),
        *[F.coalesce(F.get("state", F.lit(i)), F.lit(x).cast("float")).alias(n) for i, (n, x) in enumerate(DEFAULT_STATE)],
    )


def read_gmat(spark, paths: list[str], max_records: int | None = None) -> DataFrame:
    """Profiles of GMAT files, in long form; the first max_records ones if given."""
    profiles = parse_profiles(split_records(record_pieces(spark, paths)))
    return profiles if max_records is None else profiles.where(F.col("seq_ord") < max_records)


def parse_fasta(files: DataFrame, keep_space: bool = False) -> DataFrame:
    """ord int, name, desc, seq: the records of FASTA texts, either whole files (file_ord, text) or record_pieces().

    A line with > anywhere is a header: its first word is the name, the rest
    the description. White space in sequences goes unless it is kept.
    """
    marked = F.regexp_replace(F.concat(F.lit("\n"), "text"), r"(?m)^[^>\r\n]*>", "\u0001")
    # What is in front of the first header is no record.
    found = F.split(marked, "\u0001")
    blocks = numbered(files, F.slice(found, F.lit(2), F.size(found)), "ord").withColumnRenamed("item", "block")
    header, body = F.regexp_extract("block", r"^([^\r\n]*)", 1), F.regexp_replace("block", r"^[^\r\n]*", "")
    seq = F.regexp_replace(body, r"[\r\n]+" if keep_space else r"\s+", "")
    return blocks.select(
        "ord",
        F.regexp_extract(header, r"^\s*(\S*)", 1).alias("name"),
        F.rtrim(F.regexp_extract(header, r"^\s*\S*\s*(.*)", 1)).alias("desc"),
        seq.alias("seq"),
    )


def read_fasta(spark, paths: list[str], keep_space: bool = False) -> DataFrame:
    return parse_fasta(record_pieces(spark, paths), keep_space)


def fasta_residues(fasta: DataFrame) -> DataFrame:
    """ord, name, pos, residue: one row for each character of the sequences."""
    chars = F.filter(F.split("seq", ""), lambda x: x != "")
    return fasta.select("ord", "name", F.posexplode(chars).alias("pos", "residue"))


def fasta_profiles(fasta: DataFrame) -> DataFrame:
    """Profiles in long form whose vectors are rows of the substitution matrix.

    An unknown residue becomes X and gets the row of X.
    """
    table = blosum_table(fasta.sparkSession)  # 23 rows
    residues = fasta_residues(fasta.withColumn("seq", F.upper("seq")))
    known = residues.join(F.broadcast(table), "residue", "left")
    unknown = table.where("residue = 'X'").select(F.col("vec").alias("x_vec"))
    rows = known.join(F.broadcast(unknown)).select(
        F.col("ord").alias("seq_ord"), "name", "pos",
        F.when(F.col("vec").isNull(), "X").otherwise(F.col("residue")).alias("residue"), F.coalesce("vec", "x_vec").alias("vec"),
    )
    ends = fasta.select(
        F.col("ord").alias("seq_ord"), "name", F.length("seq").alias("pos"), F.lit(None).cast("string").alias("residue"),
        F.array_repeat(F.lit(0).cast("float"), 20).alias("vec"),
    )
    states = [F.lit(x).cast("float").alias(n) for n, x in DEFAULT_STATE]
    return rows.unionByName(ends).select("*", *states)


STATS_KEYS = ("max", "min", "sum", "mean", "var", "count")


def stats_line(*keys: str) -> Column:
    """A line of a statistics file from columns of these names."""
    return F.concat_ws("\t", *[part for k in keys or STATS_KEYS for part in (F.lit(f"{k}:"), F.col(k).cast("string"))])


def parse_stats(lines: DataFrame) -> DataFrame:
    """dim and the six statistics from lines(dim, line); a line without one of them raises an error."""
    pairs = F.str_to_map(F.regexp_replace(F.trim("line"), r"\s*:\s*", ":"), F.lit(r"\s+"), F.lit(":"))
    useful = lines.where((F.length("line") >= 2) & ~F.col("line").startswith("#")).withColumn("m", pairs)

    def value(key):
        found = F.col("m")[key]
        kind = "long" if key == "count" else "double"
        return F.when(found.isNotNull(), found.cast(kind)).otherwise(F.raise_error(F.lit(f"no {key}")).cast(kind)).alias(key)

    return useful.select("dim", *[value(k) for k in STATS_KEYS])


def read_stats(spark, path: str) -> DataFrame:
    lines = whole_files(spark, [path]).select(F.posexplode(F.filter(_lines(F.col("text")), lambda x: (F.length(x) >= 2) & ~x.startswith("#"))).alias("dim", "line"))
    return parse_stats(lines)


def parse_hhm(files: DataFrame, digits: int = 5) -> DataFrame:
    """name, pos, residue, vec: the match states of HMM profile texts.

    Behind the HMM header and its two lines of transitions and null model,
    every third line is a state: residue and number, then twenty values that
    stand for 2^(-v / 1000), * for 0.
    """
    parts = files.select(
        F.regexp_extract("text", r"(?m)^NAME\s+(\S+)", 1).alias("name"),
        F.regexp_replace(F.regexp_extract("text", r"(?s)\n(HMM .*)", 1), r"(?s)\n//.*", "").alias("body"),
    )
    lines = parts.select("name", F.posexplode(_lines(F.col("body"))).alias("n", "line")).where("n >= 3 AND (n - 3) % 3 = 0 AND trim(line) <> ''")
    tokens = F.split(F.trim("line"), r"\s+")
    values = F.transform(F.slice(tokens, 3, 20), lambda v: hhm_value(v, digits))
    return lines.select("name", ((F.col("n") - 3) / 3).cast("int").alias("pos"), F.get(tokens, F.lit(0)).alias("residue"), values.alias("vec"))


def hhm_value(text: Column, digits: int = 5) -> Column:
    """The probability that a number of an HMM profile stands for."""
    return F.when(text == "*", F.lit(0.0)).otherwise(F.round(F.pow(F.lit(2.0), -text.try_cast("double") / 1000), digits))
