"""Pairs of whole profiles as DataFrame operations around the numpy kernels: packing, searches, scores and coordinates.

A packed profile is one row; long rows are packed by one aggregation. See
multiple for multiple alignments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weft.functions import trees
from weft.functions.dynamic import GAP_STATE, Alignment, Profile, align, to_a3m
from weft.lineage import bounded, checkpointed, small_batches
from weft.options import AlignOptions

STATE = ("match_ratio", "del_ratio", "match_to_del", "del_to_del")
#: Profiles that the driver builds a tree of at most; more are clustered first.
TREE_LEAVES = 5000
#: Differences of coordinates that are held at once.
STRIP_VALUES = 1 << 23
#: Partitions of pairs of profiles at most.
PAIR_PARTITIONS = 2000


def pack_profiles(profiles: DataFrame) -> DataFrame:
    """seq_ord, name, columns: long profiles with one row for each sequence.

    Rows need the end position (residue null) only for its gap state. Packed
    rows cost much more than their size tells, so partitions are not coalesced.
    """
    parts = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    column = F.struct("pos", "residue", F.col("vec").cast("array<double>").alias("vec"), *[F.col(c).cast("double").alias(c) for c in STATE])
    dealt = profiles.repartition(parts, "seq_ord", "name")
    return dealt.groupBy("seq_ord", "name").agg(F.sort_array(F.collect_list(column)).alias("columns"))


def unpack(name: str, columns) -> Profile:
    """The profile of a packed row."""
    rows = [c for c in columns if c["residue"] is not None]
    gap = [[c[s] for s in STATE] for c in columns]
    if len(columns) == len(rows):
        gap.append([1.0, 0.0, 0.0, 0.95])
    return Profile.single(name, "".join(c["residue"] for c in rows), [list(c["vec"]) for c in rows], gap)


def unpacked(batch: pa.RecordBatch):
    """The profiles of packed rows in an Arrow batch, without a Python object for each column."""
    for name, packed in zip(batch.column("name").to_pylist(), batch.column("columns"), strict=True):
        rows = packed.values
        residues = rows.field("residue")
        vec = rows.field("vec").filter(residues.is_valid())
        if len(pc.unique(pc.list_value_length(vec))) > 1:
            raise ValueError(f"{name}: vectors differ in length")
        gap = np.column_stack([rows.field(s).to_numpy(zero_copy_only=False) for s in STATE])
        if not residues.null_count:
            gap = np.vstack([gap, GAP_STATE])
        yield Profile.single(name, "".join(residues.drop_null().to_pylist()), vec.flatten().to_numpy(zero_copy_only=False), gap)


def profile_blobs(packed: DataFrame, dummies: bool = False) -> DataFrame:
    """node long, blob binary from packed rows; dummies are columns without names and residues."""
    small_batches(packed.sparkSession)

    def run(batches):
        for batch in batches:
            for node, profile in zip(batch.column("seq_ord").to_pylist(), unpacked(batch), strict=True):
                blob = (profile.as_dummy() if dummies else profile).to_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([blob], pa.binary())], names=["node", "blob"])

    return packed.select("seq_ord", "name", "columns").mapInArrow(run, "node long, blob binary")


def leaves(packed: DataFrame) -> DataFrame:
    """node long, blob binary from packed rows: their columns, without names and residues."""
    return profile_blobs(packed, dummies=True)


def one_profile(packed: DataFrame) -> Profile:
    """The profile of the only packed row."""
    return Profile.from_bytes(profile_blobs(packed).first().blob)


A3M = "seq_ord int, name string, a3m string, score double, positive_count int, profile_length int"


def a3m_search(query: Profile, targets: DataFrame, options: AlignOptions) -> DataFrame:
    """One row for each packed target: its A3M against the query, score, positive matches and length.

    The query is part of the function, so targets are not shuffled: any number
    of them streams through the tasks.
    """
    small_batches(targets.sparkSession)
    asked = query.to_bytes()
    schema = pa.schema([("seq_ord", pa.int32()), ("name", pa.string()), ("a3m", pa.string()), ("score", pa.float64()), ("positive_count", pa.int32()), ("profile_length", pa.int32())])

    def run(batches):
        query = Profile.from_bytes(asked)
        for batch in batches:
            for order, name, target in zip(batch.column("seq_ord").to_pylist(), batch.column("name").to_pylist(), unpacked(batch), strict=True):
                path = align(query, target, options)
                # Columns of the merge are the steps of the path.
                text = to_a3m(*(_rendered(p.residues[0], cols) for p, cols in ((query, path.a), (target, path.b))))
                row = (order, name, text, path.score, int((path.matched > 0).sum()), len(target))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    return targets.select("seq_ord", "name", "columns").mapInArrow(run, A3M)


def _rendered(residues: str, cols: np.ndarray) -> str:
    return "".join(np.array([*residues, "-"])[cols].tolist())


def of_pairs(blobs: DataFrame, pairs: DataFrame, compute, schema: str) -> DataFrame:
    """compute(a, b, their profiles) for each of pairs(a, b), which name rows of blobs(node, blob); both are cheap to count.

    A profile is sent once to each of its pairs, and a pair is a task's group.
    """
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    # Pairs are few and costly: more partitions than pairs, so that few of them share one.
    parts = max(1, min(2 * pairs.count(), PAIR_PARTITIONS))
    sent = blobs.join(bounded(ends), "node").select("a", "b", "node", "blob").repartition(parts, "a", "b")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, b = int(f["a"].iloc[0]), int(f["b"].iloc[0])
        held = dict(zip(f["node"].tolist(), f["blob"], strict=True))
        return compute(a, b, Profile.from_bytes(held[a]), Profile.from_bytes(held[b]))

    return sent.groupBy("a", "b").applyInPandas(run, schema)


def of_all_pairs(packed: DataFrame, compute, schema: str) -> DataFrame:
    """The same for all pairs a < b of packed rows."""
    blobs = checkpointed(profile_blobs(packed))
    return of_pairs(blobs, checkpointed(all_pairs(blobs)), compute, schema)


def all_pairs(blobs: DataFrame) -> DataFrame:
    """a, b: all pairs a < b of nodes of checkpointed blobs.

    One side is broadcast, so there are as many tasks as partitions; a
    cartesian product has as many as pairs of partitions.
    """
    a, b = blobs.select(F.col("node").alias("a")), blobs.select(F.col("node").alias("b"))
    return a.join(bounded(b), F.col("a") < F.col("b"))


def pair_scores(packed: DataFrame, options: AlignOptions) -> DataFrame:
    """a, b, score, positive: alignment scores of all pairs of packed rows."""

    def scores(a: int, b: int, one: Profile, two: Profile) -> pd.DataFrame:
        path = align(one, two, options)
        return pd.DataFrame({"a": [a], "b": [b], "score": [path.score], "positive": [positive_score(path)]})

    return of_all_pairs(packed, scores, "a int, b int, score double, positive double")


def positive_score(path: Alignment) -> float:
    """The sum of a path's positive match scores."""
    return float(path.matched[path.matched > 0].sum())


def coordinates(packed: DataFrame, options: AlignOptions) -> DataFrame:
    """seq_ord, vec array<double>: coordinates_of() packed sequences."""
    return coordinates_of(leaves(packed), options).select(F.col("node").cast("int").alias("seq_ord"), "vec")


def coordinates_of(blobs: DataFrame, options: AlignOptions) -> DataFrame:
    """node, vec array<double>: the point that stands for each profile (node, blob) in the guide tree.

    Either the mean of its columns weighted by match_ratio, or its alignment
    scores with seed sequences: the positive match scores over the shorter length.
    """
    if options.distance_base == "averaged_value":

        def means(frames):
            for f in frames:
                vecs = [Profile.from_bytes(b).mean_vector().tolist() for b in f["blob"]]
                yield pd.DataFrame({"node": f["node"], "vec": vecs})

        return blobs.mapInPandas(means, "node long, vec array<double>")
    blobs = checkpointed(blobs)
    order = F.md5(F.concat_ws("#", F.lit(str(options.random_seed)), F.col("node").cast("string")))
    # A handful of seeds, as many as the option says.
    nodes = checkpointed(blobs.select("node"))
    seeds = nodes.orderBy(order, "node").limit(options.num_seed_seqs).select(F.col("node").alias("b"))
    pairs = checkpointed(nodes.select(F.col("node").alias("a")).crossJoin(F.broadcast(seeds)))

    def score(node: int, seed: int, a: Profile, b: Profile) -> pd.DataFrame:
        return pd.DataFrame({"node": [node], "seed": [seed], "x": [positive_score(align(a, b, options)) / min(len(a), len(b))]})

    scored = of_pairs(blobs, pairs, score, "node long, seed long, x double")
    return scored.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("seed", "x"))).alias("s")).select("node", F.col("s.x").alias("vec"))


def guide_tree(points: np.ndarray, tree_type: str) -> list[trees.Node]:
    """The tree of coordinates; NJ trees have their longest branch in the centre."""
    if len(points) > TREE_LEAVES:
        raise ValueError(f"a tree of more than {TREE_LEAVES} leaves needs max_cluster_size")
    distances = np.empty((len(points), len(points)))
    strip = max(1, STRIP_VALUES // max(1, points.size))
    for at in range(0, len(points), strip):
        distances[at : at + strip] = np.linalg.norm(points[at : at + strip, None] - points[None], axis=2)
    if tree_type == "UPGMA" or len(points) < 3:
        return trees.upgma(distances)
    return trees.neighbor_joining(distances)
