"""Queries that are aggregations, joins and windows, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.functions import vectors as V
from weft.functions.blosum import BLOSUM62, parse_matrix
from weft.lineage import shared_folder
from weft.operators import graph, pairs, stats, strings
from weft.plans.tables import (
    ALIGNED_SQL,
    LONG_SQL,
    POSITIONS_SQL,
    SEQUENCES_SQL,
    aligned_strings,
    plain_positions,
    positions,
    sequences,
    table,
)
from weft.sources import sinks, text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- statistics

_STATS_SQL = "round(max(x), 4) AS max, round(min(x), 4) AS min, round(sum(x), 4) AS sum, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var, count(x) AS count"


def _stats(rows):
    return rounded(rounded(stats.column_stats(rows), 4, "max", "min", "sum"), 6, "mean", "var")


@query(f"WITH {POSITIONS_SQL}, {LONG_SQL} SELECT dim, {_STATS_SQL} FROM long GROUP BY dim")
def vec_stats(spark, sf_dir):
    return _stats(positions(spark, sf_dir))


def _lineitem_vectors(spark, sf_dir):
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").select(F.array(*columns).alias("vec"))


@query("""
WITH long AS (
  SELECT unnest([0, 1, 2, 3]) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem
) SELECT dim, round(max(x), 2) AS max, round(min(x), 2) AS min, round(sum(x), 1) AS sum, round(avg(x), 4) AS mean, count(x) AS count
FROM long GROUP BY dim""")
def vec_stats_lineitem(spark, sf_dir):
    found = stats.column_stats(_lineitem_vectors(spark, sf_dir))
    return rounded(rounded(rounded(found, 2, "max", "min"), 1, "sum"), 4, "mean").drop("var")


@query(f"""
WITH {POSITIONS_SQL}, {LONG_SQL}, s AS (SELECT dim, avg(x) AS m, sqrt(var_pop(x)) AS sd FROM long GROUP BY dim)
SELECT name, pos, dim, round((x - m) / sd, 4) AS z FROM long JOIN s USING (dim)""")
def vec_normalize(spark, sf_dir):
    rows = positions(spark, sf_dir)
    z = stats.normalise(rows, stats.column_stats(rows))
    return rounded(stats.by_dimension(z, "name", "pos").withColumnRenamed("x", "z"), 4, "z")


@query(f"WITH {POSITIONS_SQL}, {LONG_SQL} SELECT name, dim, round(avg(x), 6) AS mean FROM long GROUP BY name, dim")
def vec_mean(spark, sf_dir):
    return rounded(stats.mean_vectors(positions(spark, sf_dir), "name"), 6, "mean")


@query(f"WITH {POSITIONS_SQL}, {LONG_SQL} SELECT name, dim, round(sum(match_ratio * x) / sum(match_ratio), 6) AS mean FROM long GROUP BY name, dim")
def vec_weighted_mean(spark, sf_dir):
    return rounded(stats.mean_vectors(positions(spark, sf_dir), "name", weight="match_ratio"), 6, "mean")


@query(f"""
WITH {POSITIONS_SQL}, {LONG_SQL}
SELECT a.name, a.pos, a.dim, round(a.x - coalesce((
  SELECT avg(b.x) FROM long b WHERE b.name = a.name AND b.dim = a.dim AND abs(b.pos - a.pos) BETWEEN 2 AND 4), 'nan'::DOUBLE) / 2, 4) AS x
FROM long a""")
def ssbias_window(spark, sf_dir):
    return rounded(stats.without_neighbourhood(positions(spark, sf_dir)), 4, "x")


@query(f"""
WITH {SEQUENCES_SQL}, {ALIGNED_SQL}, c AS (
  SELECT name, unnest(range(length(aligned))) AS col, unnest(string_split(aligned, '')) AS ch FROM aligned
), n AS (SELECT col, ch, count(*) AS n FROM c GROUP BY col, ch), k AS (SELECT col, count(*) AS k FROM n GROUP BY col),
w AS (SELECT name, sum(1.0 / n / k) AS w FROM c JOIN n USING (col, ch) JOIN k USING (col) GROUP BY name)
SELECT name, round(w / (SELECT sum(w) FROM w), 8) AS weight FROM w""")
def henikoff_weights(spark, sf_dir):
    return rounded(stats.henikoff_weights(aligned_strings(spark, sf_dir)), 8, "weight")


def _trimmed(spark, sf_dir):
    offsets = F.explode(F.array(*map(F.lit, (1, 2, 3))))
    return positions(spark, sf_dir).select(F.col("name").alias("seq"), offsets.alias("offset"), "pos", "vec").where("pos >= offset").select(
        "seq", "offset", (F.col("pos") - F.col("offset")).alias("pos"),
        F.transform(F.col("vec").cast("array<double>"), lambda x, d: x + F.col("offset") * 0.01 * d).alias("vec"),
    )


_ROBUST_SQL = f"""
WITH {POSITIONS_SQL}, {LONG_SQL}, o AS (SELECT unnest([1, 2, 3]) AS k),
r AS (SELECT dim, sum(abs(x - (x + k * 0.01 * dim))) AS absdiff FROM long JOIN o ON pos >= k GROUP BY dim)"""


@query(f"{_ROBUST_SQL} SELECT dim, round(absdiff, 4) AS absdiff FROM r")
def feature_robustness(spark, sf_dir):
    base = positions(spark, sf_dir).select(F.col("name").alias("seq"), "pos", "vec")
    return rounded(stats.feature_robustness(base, _trimmed(spark, sf_dir)), 4, "absdiff")


@query(f"{_ROBUST_SQL} SELECT dim FROM r ORDER BY absdiff, dim LIMIT 16")
def topk_dims(spark, sf_dir):
    base = positions(spark, sf_dir).select(F.col("name").alias("seq"), "pos", "vec")
    return stats.robust_dimensions(stats.feature_robustness(base, _trimmed(spark, sf_dir)), 16)


# ------------------------------------------------------------ vector kernels


def _elements(name: str, column, sql: str, pairs_of: bool = False):
    """Registers a kernel that gives a vector for each row, or for each row and the next one."""
    source = "positions" if not pairs_of else "(SELECT p.vec_id, p.vec AS vec, q.vec AS other FROM positions p JOIN positions q ON q.vec_id = p.vec_id + 1)"

    def run(spark, sf_dir):
        rows = positions(spark, sf_dir).select("vec_id", "vec")
        if pairs_of:
            after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
            rows = rows.join(after, "vec_id")
        return rounded(rows.select("vec_id", F.posexplode(column()).alias("dim", "x")), 5, "x")

    query(f"""
WITH {POSITIONS_SQL}, v AS (SELECT vec_id, {sql} AS v FROM {source}),
l AS (SELECT vec_id, unnest(range(len(v))) AS dim, unnest(v) AS x FROM v) SELECT vec_id, dim, round(x, 5) AS x FROM l""", name)(run)


_elements("vec_min", lambda: V.element_min(F.col("vec"), 0.05), "list_transform(vec, lambda x: least(x, 0.05))")
_elements("vec_max", lambda: V.element_max(F.col("vec"), 0.05), "list_transform(vec, lambda x: greatest(x, 0.05))")
_elements("vec_add", lambda: V.element_add(F.col("vec"), 0.5), "list_transform(vec, lambda x: x + 0.5)")
_elements("vec_mul", lambda: V.element_multiply(F.col("vec"), 1.5), "list_transform(vec, lambda x: x * 1.5)")
_elements("vec_square", lambda: V.vector_square(F.col("vec")), "list_transform(vec, lambda x: x * x)")
_elements("vec_sqrt", lambda: V.vector_sqrt(V.vector_square(F.col("vec"))), "list_transform(vec, lambda x: sqrt(x * x))")
for _name, _f, _sql in (
    ("vec_pair_min", V.vector_min, "least(z[1], z[2])"),
    ("vec_pair_max", V.vector_max, "greatest(z[1], z[2])"),
    ("vec_pair_add", V.vector_add, "z[1] + z[2]"),
    ("vec_pair_mul", V.vector_multiply, "z[1] * z[2]"),
):
    _elements(
        _name, lambda f=_f: f(F.col("vec"), F.col("other")), f"list_transform(list_zip(vec, other), lambda z: {_sql})", True
    )

@query(f"WITH {POSITIONS_SQL}, {LONG_SQL} SELECT vec_id, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM long GROUP BY vec_id")
def vec_row_stats(spark, sf_dir):
    v = F.col("vec")
    return rounded(positions(spark, sf_dir).select("vec_id", V.mean(v).alias("mean"), V.variance(v).alias("var")), 6, "mean", "var")


@query(f"""
WITH {POSITIONS_SQL}, {LONG_SQL}, m AS (SELECT vec_id, sum(x * (dim % 3 + 1)) / sum(dim % 3 + 1) AS mean FROM long GROUP BY vec_id)
SELECT vec_id, round(any_value(mean), 6) AS mean, round(sum((dim % 3 + 1) * (x - mean) ** 2) / sum(dim % 3 + 1), 6) AS var
FROM long JOIN m USING (vec_id) GROUP BY vec_id""")
def vec_row_weighted_stats(spark, sf_dir):
    v, w = F.col("vec"), F.transform(F.col("vec"), lambda _, i: (i % 3 + 1).cast("double"))
    rows = positions(spark, sf_dir).select("vec_id", V.weighted_mean(v, w).alias("mean"), V.weighted_variance(v, w).alias("var"))
    return rounded(rows, 6, "mean", "var")


# --------------------------------------------------------- scores of pairs

_MEANS_SQL = "means AS (SELECT seq_ord, list(m ORDER BY dim) AS vec FROM (SELECT seq_ord, dim, avg(x) AS m FROM long GROUP BY seq_ord, dim) GROUP BY seq_ord)"
_DOT = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2]))"
_EUCLID = "sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) ** 2)))"
DISTANCES_SQL = f"{POSITIONS_SQL}, {LONG_SQL}, {_MEANS_SQL}, dist AS (SELECT a.seq_ord AS i, b.seq_ord AS j, {_EUCLID} AS d FROM means a JOIN means b ON a.seq_ord < b.seq_ord)"


def mean_coordinates(spark, sf_dir):
    return stats.pack_vectors(stats.mean_vectors(positions(spark, sf_dir), "seq_ord"), "seq_ord")


def mean_distances(spark, sf_dir):
    return pairs.coordinate_distances(mean_coordinates(spark, sf_dir))


@query(f"WITH {POSITIONS_SQL}, {LONG_SQL}, {_MEANS_SQL} SELECT a.seq_ord AS i, b.seq_ord AS j, round({_DOT}, 6) AS score FROM means a JOIN means b ON a.seq_ord < b.seq_ord")
def vec_dot_pairs(spark, sf_dir):
    m = mean_coordinates(spark, sf_dir)
    a, b = m.select(F.col("seq_ord").alias("i"), F.col("vec").alias("va")), m.select(F.col("seq_ord").alias("j"), F.col("vec").alias("vb"))
    return rounded(a.join(b, F.col("i") < F.col("j")).select("i", "j", V.dot(F.col("va"), F.col("vb")).alias("score")), 6, "score")


@query(f"WITH {DISTANCES_SQL} SELECT i, j, round(d, 6) AS d FROM dist")
def vec_euclid_pairs(spark, sf_dir):
    return rounded(mean_distances(spark, sf_dir), 6, "d")


#: Zero has no sign in the rows that are compared.
_UNSIGNED = "SELECT * REPLACE (CASE WHEN score = 0 THEN 0.0 ELSE score END AS score) FROM ({})"


@query(_UNSIGNED.format(f"""
WITH {POSITIONS_SQL} SELECT a.seq_ord AS a, b.seq_ord AS b, a.pos AS i, b.pos AS j, round({_DOT}, 5) AS score
FROM positions a JOIN positions b ON a.seq_ord < b.seq_ord"""))
def score_matrix_dot(spark, sf_dir):
    return pairs.dot_scores(positions(spark, sf_dir), digits=5)


@query(_UNSIGNED.format(f"""
WITH {POSITIONS_SQL}, e AS (
  SELECT a.seq_ord AS a, b.seq_ord AS b, a.pos AS i, b.pos AS j, a.match_ratio AS wa, b.match_ratio AS wb, exp(-{_EUCLID} / 64) AS e
  FROM positions a JOIN positions b ON a.seq_ord < b.seq_ord
), m AS (
  SELECT *, sum(wb * e) OVER (PARTITION BY a, b, i) / sum(wb) OVER (PARTITION BY a, b, i) AS mi,
            sum(wa * e) OVER (PARTITION BY a, b, j) / sum(wa) OVER (PARTITION BY a, b, j) AS mj FROM e
), v AS (
  SELECT *, sqrt(sum(wb * (e - mi) ** 2) OVER (PARTITION BY a, b, i) / sum(wb) OVER (PARTITION BY a, b, i)) AS si,
            sqrt(sum(wa * (e - mj) ** 2) OVER (PARTITION BY a, b, j) / sum(wa) OVER (PARTITION BY a, b, j)) AS sj FROM m
)
SELECT a, b, i, j, round((e - mi) / si / 2 + (e - mj) / sj / 2, 4) AS score FROM v"""))
def score_matrix_distz(spark, sf_dir):
    return pairs.distance_zscores(positions(spark, sf_dir), digits=4)


@query(f"""
WITH {POSITIONS_SQL}, s AS (
  SELECT b.name, {_DOT} AS score FROM positions a JOIN positions b ON a.seq_ord = 0 AND b.seq_ord > 0
)
SELECT name, round(CASE WHEN min(score) > 0 THEN -0.5 * max(score) ELSE -0.5 * max(score) + 0.5 * min(score) END, 5) AS gap_open FROM s GROUP BY name""")
def gap_auto_adjust(spark, sf_dir):
    p = positions(spark, sf_dir)
    ranges = pairs.score_ranges(p.where("seq_ord = 0"), p.where("seq_ord > 0"), "name")
    return rounded(ranges.select("name", pairs.penalty_of_range(F.col("low"), F.col("high")).alias("gap_open")), 5, "gap_open")


@query(f"WITH {POSITIONS_SQL}, {LONG_SQL}, {_MEANS_SQL} SELECT b.seq_ord, a.seq_ord AS anchor, round({_EUCLID}, 6) AS d FROM means a JOIN means b ON a.seq_ord < 5")
def anchor_distances(spark, sf_dir):
    m = mean_coordinates(spark, sf_dir)
    return rounded(pairs.anchor_coordinates(m, m.where("seq_ord < 5").withColumnRenamed("seq_ord", "anchor")), 6, "d")


@query(f"""
WITH {SEQUENCES_SQL}, {ALIGNED_SQL}
SELECT a.seq_ord AS i, b.seq_ord AS j, CAST(a.seq_ord * (a.seq_ord + 1) // 2 + b.seq_ord AS BIGINT) AS place,
       len(list_filter(list_zip(string_split(a.aligned, ''), string_split(b.aligned, '')), lambda z: z[1] <> z[2])) / CAST(length(a.aligned) AS DOUBLE) AS d
FROM aligned a JOIN aligned b ON b.seq_ord <= a.seq_ord""")
def mismatch_matrix(spark, sf_dir):
    return pairs.mismatches(aligned_strings(spark, sf_dir))


@query("""
SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST(row_number() OVER (ORDER BY a.n_nationkey, b.n_nationkey) - 1 AS BIGINT) AS place
FROM nation a JOIN nation b ON b.n_nationkey <= a.n_nationkey""")
def condensed_index(spark, sf_dir):
    """The place of each pair of nations, whose keys count from 0."""
    i = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"))
    grid = i.select("i", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("j"))
    return grid.select("i", "j", V.condensed_index(F.col("j"), F.col("i")).cast("long").alias("place"))


@query(f"""
WITH {DISTANCES_SQL}, s AS (SELECT i, j, d FROM dist UNION ALL SELECT j, i, d FROM dist),
r AS (SELECT i, sum(d) AS r, count(*) + 1 AS n FROM s GROUP BY i)
SELECT dist.i, dist.j FROM dist JOIN r a ON a.i = dist.i JOIN r b ON b.i = dist.j
ORDER BY round((a.n - 2) * d - a.r - b.r, 9), dist.i, dist.j LIMIT 1""")
def nj_first_pair(spark, sf_dir):
    return pairs.first_joined(mean_distances(spark, sf_dir), "NJ")


@query(f"WITH {DISTANCES_SQL} SELECT i, j FROM dist ORDER BY d, i, j LIMIT 1")
def upgma_first_pair(spark, sf_dir):
    return pairs.first_joined(mean_distances(spark, sf_dir), "UPGMA")


# Every vector has an edge to the one with a seventh of its id in its own label's tens of thousands.
_EDGE = "label * 10000 + vec_id // 7 AS b"


@query(f"""
WITH RECURSIVE e AS (SELECT label * 10000 + vec_id AS a, {_EDGE} FROM embeddings),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS node, a AS to_ FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.to_)
SELECT node, min(to_) AS root FROM r GROUP BY node""")
def union_find(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    tens = F.col("label").cast("long") * 10000
    return graph.smallest_reachable(rows.select((tens + F.col("vec_id")).alias("a"), (tens + F.floor(F.col("vec_id") / 7)).alias("b")))


@query(f"""
WITH {POSITIONS_SQL}, {LONG_SQL}, {_MEANS_SQL}, d AS (
  SELECT b.vec_id AS id, a.seq_ord AS side, {_EUCLID} AS d FROM means a JOIN positions b ON a.seq_ord < 2
) SELECT id, arg_min(side, (d, side)) AS side, round(min(d), 6) AS d FROM d GROUP BY id""")
def kmeans_assign_step(spark, sf_dir):
    centres = mean_coordinates(spark, sf_dir).where("seq_ord < 2").withColumnRenamed("seq_ord", "side")
    return rounded(pairs.assign_step(positions(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec"), centres), 6, "d")


@query("""
WITH l AS (SELECT l_discount * 10 - 0.2 AS la, l_tax * 10 - 0.2 AS lb, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT *, CASE WHEN least(la, lb) <= 0 THEN least(la, lb) - 0.01 ELSE 0 END AS s FROM l)
SELECT round(la, 1) AS la, round(lb, 1) AS lb, n, round(greatest((lb - s) / (la + lb - 2 * s), 0.01), 6) AS wa,
       round(greatest((la - s) / (la + lb - 2 * s), 0.01), 6) AS wb FROM s""")
def branch_weights(spark, sf_dir):
    """The weights of all pairs of lengths that discounts and taxes give, some of them below zero."""
    lengths = [(F.col(c) * 10 - 0.2).alias(n) for c, n in (("l_discount", "la"), ("l_tax", "lb"))]
    found = table(spark, sf_dir, "lineitem").select(*lengths).groupBy("la", "lb").agg(F.count("*").alias("n"))
    return rounded(rounded(found.select("la", "lb", "n", *pairs.branch_weights()), 1, "la", "lb"), 6, "wa", "wb")


# -------------------------------------------------- texts, formats, strings


def _fasta_files(spark, sf_dir):
    wrapped = F.regexp_replace("seq", "(.{1,60})", "$1\n")
    return sequences(spark, sf_dir).select(
        F.col("seq_ord").alias("file_ord"), F.concat(F.lit(">"), "name", F.lit(" item of length "), F.length("seq").cast("string"), F.lit("\n"), wrapped).alias("text")
    )


@query(f"WITH {SEQUENCES_SQL} SELECT CAST(row_number() OVER (ORDER BY seq_ord) - 1 AS INTEGER) AS ord, name, 'item of length ' || length(seq) AS \"desc\", seq FROM sequences")
def fasta_records(spark, sf_dir):
    """Sequences written as FASTA files and read again by record."""
    return text.read_fasta(spark, _written(_fasta_files(spark, sf_dir)))


def _written(texts):
    """The paths, in order, of files with the records of texts(file_ord, text), written beside the checkpoints."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    sinks.save_lines(texts.select("file_ord", F.col("text").alias("line")), folder, ["file_ord"])
    return sorted(spark.read.text(folder).inputFiles())


@query(f"WITH {SEQUENCES_SQL} SELECT name, CAST(unnest(range(length(seq))) AS INTEGER) AS pos, unnest(string_split(seq, '')) AS residue FROM sequences")
def fasta_residues(spark, sf_dir):
    return text.fasta_residues(text.parse_fasta(_fasta_files(spark, sf_dir))).drop("ord")


_BLOSUM_VALUES = ", ".join(f"('{r}', {sum(v)}, {v[0]})" for r, v in sorted(parse_matrix(BLOSUM62).items()))


@query(f"""
WITH {SEQUENCES_SQL}, blosum(residue, total, first) AS (VALUES {_BLOSUM_VALUES}),
r AS (SELECT name, CAST(unnest(range(length(seq))) AS INTEGER) AS pos, unnest(string_split(seq, '')) AS letter FROM sequences),
k AS (SELECT name, pos, coalesce(blosum.residue, 'X') AS residue FROM r LEFT JOIN blosum ON letter = residue)
SELECT name, pos, residue, CAST(total AS DOUBLE) AS total, CAST(first AS DOUBLE) AS first FROM k JOIN blosum USING (residue)""")
def blosum_profile(spark, sf_dir):
    rows = text.fasta_profiles(text.parse_fasta(_fasta_files(spark, sf_dir))).where("residue IS NOT NULL")
    return rows.select("name", "pos", "residue", V.total(F.col("vec")).alias("total"), F.get("vec", F.lit(0)).cast("double").alias("first"))


def _with_ends(rows):
    ends = rows.groupBy("seq_ord", "name").agg((F.max("pos") + 1).cast("int").alias("pos"))
    end = ends.select(
        "seq_ord", "name", "pos", F.lit(None).cast("string").alias("residue"), F.array_repeat(F.lit(0).cast("float"), 64).alias("vec"),
        F.lit(1.0).cast("float").alias("match_ratio"), F.lit(0.0).cast("float").alias("del_ratio"),
        F.lit(0.0).cast("float").alias("match_to_del"), F.lit(0.95).cast("float").alias("del_to_del"),
    )
    return rows.drop("vec_id").unionByName(end)


@query(f"""
WITH {POSITIONS_SQL}, p AS (
  SELECT seq_ord, name, pos, residue, round(match_ratio, 4) AS match_ratio, round(list_sum(list_transform(vec, lambda x: round(x, 5))), 5) AS total FROM positions
  UNION ALL SELECT seq_ord, name, CAST(count(*) AS INTEGER), NULL, 1.0, 0.0 FROM positions GROUP BY seq_ord, name
) SELECT * FROM p""")
def gmat_round_trip(spark, sf_dir):
    """Profiles written as text files and read again by record."""
    lines = sinks.gmat_lines(_with_ends(positions(spark, sf_dir)))
    texts = lines.groupBy("seq_ord").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "line"))).alias("l"))
    files = texts.select(F.col("seq_ord").alias("file_ord"), F.array_join(F.col("l.line"), "\n").alias("text"))
    return text.read_gmat(spark, _written(files)).select(
        "seq_ord", "name", "pos", "residue", F.round(F.col("match_ratio").cast("double"), 4).alias("match_ratio"),
        F.round(V.total(F.transform(F.col("vec").cast("array<double>"), lambda x: F.round(x, 5))), 5).alias("total"),
    )


@query(f"WITH {POSITIONS_SQL}, {LONG_SQL} SELECT dim, {_STATS_SQL} FROM long GROUP BY dim")
def stats_round_trip(spark, sf_dir):
    """Statistics written as lines and parsed again."""
    lines = stats.column_stats(positions(spark, sf_dir)).select("dim", text.stats_line().alias("line"))
    return rounded(rounded(text.parse_stats(lines), 4, "max", "min", "sum"), 6, "mean", "var")


_PAIRS_SQL = f"{SEQUENCES_SQL}, {ALIGNED_SQL}, p AS (SELECT a.seq_ord, a.aligned AS q, b.aligned AS s FROM aligned a JOIN aligned b ON b.seq_ord = a.seq_ord + 1)"


def _aligned_pairs(spark, sf_dir):
    a = aligned_strings(spark, sf_dir).select("seq_ord", F.col("aligned").alias("q"))
    b = aligned_strings(spark, sf_dir).select((F.col("seq_ord") - 1).alias("seq_ord"), F.col("aligned").alias("s"))
    return a.join(b, "seq_ord")


@query(f"""
WITH {_PAIRS_SQL} SELECT seq_ord, array_to_string(list_transform(list_filter(list_zip(string_split(q, ''), string_split(s, '')), lambda z: z[1] <> '-' OR z[2] <> '-'),
  lambda z: CASE WHEN z[1] = '-' THEN lower(z[2]) ELSE upper(z[2]) END), '') AS a3m FROM p""")
def a3m_from_pair(spark, sf_dir):
    return _aligned_pairs(spark, sf_dir).select("seq_ord", strings.pair_to_a3m(F.col("q"), F.col("s")).alias("a3m"))


@query(f"""
WITH {_PAIRS_SQL} SELECT seq_ord, array_to_string(list_transform(list_filter(list_zip(string_split(q, ''), string_split(s, '')), lambda z: z[1] <> '-' OR z[2] <> '-'),
  lambda z: z[1]), '') AS query FROM p""")
def ali_from_a3m(spark, sf_dir):
    pair = _aligned_pairs(spark, sf_dir).withColumn("a3m", strings.pair_to_a3m(F.col("q"), F.col("s")))
    return pair.select("seq_ord", strings.a3m_to_pair(F.regexp_replace("q", "-", ""), F.col("a3m")).alias("query"))


@query(f"WITH {SEQUENCES_SQL}, {ALIGNED_SQL} SELECT name, aligned FROM aligned")
def aligned_render(spark, sf_dir):
    """Aligned strings taken apart into residues and columns, and put together again."""
    source = aligned_strings(spark, sf_dir)
    columns = strings.residue_columns(source.select(F.col("name").alias("key"), "aligned"))
    packed = columns.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "col"))).alias("c"))
    joined = source.join(packed, source.name == packed.key)
    return joined.select("name", strings.render(F.regexp_replace("aligned", "-", ""), F.col("c.col"), F.length("aligned")).alias("aligned"))


@query(f"""
WITH {SEQUENCES_SQL}, c AS (SELECT name, regexp_replace(seq, '[^A-IK-Z]', '', 'g') AS seq FROM sequences),
w AS (SELECT DISTINCT name, seq, least(s, greatest(length(seq) - 50, 0)) AS start FROM c, range(0, 100000, 20) r(s) WHERE s < greatest(length(seq) - 50, 0) + 20)
SELECT name, CAST(start AS INTEGER) AS start, substr(seq, start + 1, 50) AS fragment FROM w""")
def crop_fragments(spark, sf_dir):
    return strings.crop_fragments(sequences(spark, sf_dir), 50, 20)


_FRAGMENTS_SQL = f"""
{POSITIONS_SQL}, {LONG_SQL}, n AS (SELECT name, count(*) AS total FROM positions GROUP BY name),
f AS (SELECT name, total, start, least(20, total - start) AS length FROM n, range(0, 100000, 10) r(start) WHERE start < total)"""


@query(f"""
WITH {_FRAGMENTS_SQL} SELECT long.name, pos, dim, round(avg(x + start * 0.01), 5) AS x FROM long JOIN f ON f.name = long.name AND pos >= start AND pos < start + length
  AND (start = 0 OR pos >= start + 2) AND (start + length = total OR pos < start + length - 2) GROUP BY long.name, pos, dim""")
def merge_fragments(spark, sf_dir):
    p = positions(spark, sf_dir).select("name", "pos", F.col("vec").cast("array<double>").alias("vec"))
    totals = p.groupBy("name").agg(F.count("*").alias("total"))
    starts = totals.select("name", "total", F.explode(F.sequence(F.lit(0), (F.col("total") - 1).cast("int"), F.lit(10))).alias("start"))
    starts = starts.withColumn("length", F.least(F.lit(20), F.col("total") - F.col("start")))
    inside = p.join(starts, "name").where("pos >= start AND pos < start + length")
    moved = inside.withColumn("vec", F.transform("vec", lambda x: x + F.col("start") * 0.01))
    fragments = moved.groupBy("name", "start", "length", "total").agg(F.sort_array(F.collect_list(F.struct("pos", "vec"))).alias("s"))
    fragments = fragments.select("name", "start", "length", "total", F.col("s.vec").alias("vecs"))
    return rounded(strings.merge_fragments(fragments, 2), 5, "x")


@query("""
SELECT p_partkey, v AS text, CASE WHEN v = '*' THEN 0.0 ELSE round(pow(2.0, -TRY_CAST(v AS DOUBLE) / 1000), 5) END AS value
FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN '*' ELSE CAST(p_size * 97 AS VARCHAR) END AS v FROM part)""")
def hhm_convert(spark, sf_dir):
    """Sizes of parts as the numbers of an HMM file; the smallest stands for none."""
    v = F.when(F.col("p_size") == 1, "*").otherwise((F.col("p_size") * 97).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("text"), text.hhm_value(v).alias("value"))


@query("SELECT CAST(item_id AS BIGINT) AS item_id FROM benchmark ORDER BY md5('123#' || item_id), item_id LIMIT 20")
def sample_deterministic(spark, sf_dir):
    return strings.sample_records(table(spark, sf_dir, "benchmark").select("item_id"), 20, 123, "item_id")


@query(f"WITH {SEQUENCES_SQL} SELECT name, seq FROM sequences WHERE name IN (SELECT 'b' || doc_id FROM labels)")
def pick_records(spark, sf_dir):
    """The records that a list from another table names."""
    records = sequences(spark, sf_dir)
    described = records.select(F.concat("name", F.lit(" a description")).alias("name"), "seq")
    targets = table(spark, sf_dir, "labels").select(F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("target"))
    return strings.pick_records(described, targets).select(F.regexp_extract("name", r"^(\S+)", 1).alias("name"), "seq")


_MOVED = "CASE WHEN seq_ord % 2 = 0 THEN '-' || aligned ELSE aligned || '-' END"


_SP_SQL = f"""
WITH {SEQUENCES_SQL}, {ALIGNED_SQL}, both_ AS (SELECT 0 AS t, replace(aligned, '-', '') AS key, aligned FROM aligned UNION ALL SELECT 1, replace(aligned, '-', ''), {_MOVED} FROM aligned),
c AS (SELECT t, key, unnest(range(length(aligned))) AS col, unnest(string_split(aligned, '')) AS ch FROM both_),
r AS (SELECT t, key, col, row_number() OVER (PARTITION BY t, key ORDER BY col) - 1 AS k FROM c WHERE ch <> '-'),
p AS (SELECT a.t, a.key AS a, b.key AS b, a.k AS ka, b.k AS kb FROM r a JOIN r b ON a.t = b.t AND a.col = b.col AND a.key < b.key)
SELECT x.a, x.b, count(y.a) AS matched, count(*) AS total FROM p x LEFT JOIN p y ON y.t = 1 AND x.a = y.a AND x.b = y.b AND x.ka = y.ka AND x.kb = y.kb
WHERE x.t = 0 GROUP BY x.a, x.b"""


@query(_SP_SQL)
def sp_score(spark, sf_dir):
    reference = aligned_strings(spark, sf_dir)
    return strings.sum_of_pairs(reference.select("aligned"), reference.select(F.expr(_MOVED).alias("aligned")))


@query(f"SELECT CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(total) AS BIGINT) AS total, round(sum(matched) / sum(total), 9) AS score FROM ({_SP_SQL})")
def sp_total(spark, sf_dir):
    """The sum-of-pairs score of a whole alignment, from counts of columns."""
    reference = aligned_strings(spark, sf_dir)
    return rounded(strings.sum_of_pairs_total(reference.select("aligned"), reference.select(F.expr(_MOVED).alias("aligned"))), 9, "score")
