"""Embedding near-dedup: a subspace pigeonhole join of rotated unit vectors.

Cosine at least c means a squared distance of unit vectors of at most 2 - 2c.
Vectors are rotated at random and split into blocks of few dimensions; a pair
within the budget is within its proportional share in one block at least. Each
block is range-joined under its share, and pairs that a block admits are
verified in double precision on the whole vectors.

The range join works on tiles: boxes of vectors from a k-d split. Two tiles
meet in one task if the gap of their boxes in some block is within the block's
share. Inside the task the share is tested for every pair in each block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from weft.lineage import bounded, checkpointed
from weft.operators.graph import connected_components

#: Vectors of a tile at most; dimensions of a block.
TILE, BLOCK = 4096, 16
#: Vectors that the k-d split is fitted on. It only shapes the tiles: every vector is joined.
SAMPLE = 16_384
#: Rows of a tile that are compared with another tile at once.
STRIP = 512
#: Boxes of tiles in a block of them.
BOXES = 512
_SLACK = 1e-4


def rotation(dimensions: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(2).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def blocks(dimensions: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, dimensions)) for a in range(0, dimensions, BLOCK)]


class Split:
    """A k-d tree over a sample: gives each vector the number of its cell."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self._grow(sample, leaves)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        spread = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(1)
        if leaves <= 1 or spread.max() <= 0:
            self.cells += 1
            return -self.cells  # a leaf
        axis = int(rows.var(axis=0).argmax())
        cut = float(np.median(rows[:, axis]))
        low = rows[:, axis] < cut
        if not low.any():
            low = rows[:, axis] <= cut
            cut = float(np.nextafter(cut, np.inf))
        here = len(self.nodes)
        self.nodes.append((axis, cut, 0, 0))
        self.nodes[here] = (axis, cut, self._grow(rows[low], leaves // 2), self._grow(rows[~low], leaves - leaves // 2))
        return here

    def cell(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        todo = [(0 if self.nodes else -1, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -node - 1
                continue
            axis, cut, low, high = self.nodes[node]
            below = rows[at, axis] < cut
            todo += [(low, at[below]), (high, at[~below])]
        return out


def _unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, in double precision, of rows that all have finite components of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    # Scaled by a power of two, which is exact, so that no square overflows.
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _strip_links(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, least: float):
    """(rows of a, rows of b, matrix of links between them) of the pairs that a block admits."""
    dimensions = a.shape[1]
    admitted = np.zeros((len(a), len(b)), bool)
    for block in blocks(dimensions):
        share = np.float32((2 - 2 * least) * (block.stop - block.start) / dimensions * (1 + _SLACK) + _SLACK / 10)
        x, y = turned_a[:, block], turned_b[:, block]
        # |x - y|^2 within the share, as a bound on the product
        bound = ((x * x).sum(axis=1) - share)[:, None] + (y * y).sum(axis=1)[None, :]
        admitted |= 2 * (x @ y.T) >= bound
    rows, columns = np.flatnonzero(admitted.any(axis=1)), np.flatnonzero(admitted.any(axis=0))
    return rows, columns, (a[rows] @ b[columns].T >= least) & admitted[np.ix_(rows, columns)]


def _meet(least: float):
    def meet(table: pa.Table) -> pa.Table:
        """Links inside one pair of tiles: counts for each class, and edges that span its components."""
        table = table.sort_by("class")
        whole = _unit_rows(table.column("v").combine_chunks())
        turned = (whole @ rotation(whole.shape[1])).astype(np.float32)
        rep, copies = table.column("class").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        second = table.column("second").to_numpy()
        one_tile = not second.any()
        left = np.flatnonzero(~second)
        right = left if one_tile else np.flatnonzero(second)
        label, links = np.arange(len(rep)), np.zeros(len(rep))
        for start in range(0, len(left), STRIP):
            i, j = left[start : start + STRIP], right[start:] if one_tile else right
            rows, columns, close = _strip_links(whole[i], whole[j], turned[i], turned[j], least)
            i, j = i[rows], j[columns]
            if one_tile:
                close &= i[:, None] < j[None, :]
            links[i] += close.astype(np.float64) @ copies[j]
            links[j] += close.T.astype(np.float64) @ copies[i]
            for n in np.flatnonzero(close.any(axis=1)).tolist():
                joined = np.unique(np.append(label[j[close[n]]], label[i[n]]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        has, bound = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rep)))
        none = lambda n: [None] * n
        return pa.table({
            "class": pa.array([*rep[has].tolist(), *none(len(bound))], pa.int64()),
            "links": pa.array([*links[has].astype(np.int64).tolist(), *none(len(bound))], pa.int64()),
            "a": pa.array([*none(len(has)), *rep[bound].tolist()], pa.int64()),
            "b": pa.array([*none(len(has)), *rep[label[bound]].tolist()], pa.int64()),
        })

    return meet


def _tiled(classes: DataFrame, rows: int, dimensions: int) -> DataFrame:
    """classes with a tile number: cells of a k-d split, and parts of cells that are too full."""
    turn = rotation(dimensions)
    sample = classes.orderBy(F.xxhash64("class")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    split = Split(_unit_rows(sample) @ turn, -(-rows // TILE) if rows > TILE else 1)

    def place(batches):
        for batch in batches:
            cell = split.cell(_unit_rows(batch.column(2)) @ turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["class", "copies", "v", "cell"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = checkpointed(classes.mapInArrow(place, f"class long, copies long, v {kind}, cell long"))
    fill = checkpointed(placed.groupBy("cell").count())
    most = -(-fill.agg(F.max("count")).first()[0] // TILE)
    parts = fill.select("cell", F.ceil(F.col("count") / TILE).alias("parts"))
    part = F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts"))
    joined = placed.join(bounded(parts), "cell")
    return joined.select("class", "copies", "v", (F.col("cell") * most + part).alias("tile"))


def _tile_pairs(tiled: DataFrame, dimensions: int, least: float) -> DataFrame:
    """(tile, other): pairs of tiles, and each tile with itself, whose boxes come within a block's share.

    Boxes are compared in blocks of BOXES by BOXES: a task holds two blocks,
    whatever the number of tiles, and none go to the driver.
    """
    turn = rotation(dimensions)

    def box(batches):
        low, high = {}, {}
        for batch in batches:
            units, tiles = _unit_rows(batch.column(0)) @ turn, batch.column(1).to_numpy()
            for t in np.unique(tiles).tolist():
                rows = units[tiles == t]
                low[t] = np.minimum(low[t], rows.min(axis=0)) if t in low else rows.min(axis=0)
                high[t] = np.maximum(high[t], rows.max(axis=0)) if t in high else rows.max(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(low), pa.int64()), pa.array([x.tolist() for x in low.values()], pa.list_(pa.float64())),
             pa.array([high[t].tolist() for t in low], pa.list_(pa.float64()))],
            names=["tile", "low", "high"],
        )

    found = tiled.select("v", "tile").mapInArrow(box, "tile long, low array<double>, high array<double>")
    exploded = found.select("tile", F.posexplode(F.arrays_zip("low", "high")))
    sides = exploded.groupBy("tile", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    boxes = sides.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("box"))
    boxes = checkpointed(boxes.select("tile", F.col("box.low").alias("low"), F.col("box.high").alias("high")))
    count = -(-boxes.count() // BOXES)
    mine = F.pmod(F.xxhash64("tile"), F.lit(count)).cast("int")
    dealt = boxes.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("its"))
    dealt = dealt.select("tile", "low", "high", (F.col("mine") > F.col("its")).alias("second"), F.least("mine", "its").alias("a"), F.greatest("mine", "its").alias("b"))
    budget = 2 - 2 * least

    def near(table: pa.Table) -> pa.Table:
        tiles, second = table.column("tile").to_numpy(), table.column("second").to_numpy()
        low, high = (table.column(n).combine_chunks().flatten().to_numpy().reshape(len(tiles), -1) for n in ("low", "high"))
        one_block = table.column("a")[0] == table.column("b")[0]
        others = np.arange(len(tiles)) if one_block else np.flatnonzero(second)
        out = []
        for n in np.flatnonzero(~second).tolist():
            gap = np.maximum(0, np.maximum(low[others] - high[n], low[n] - high[others])) ** 2
            meets = np.zeros(len(others), bool)
            for block in blocks(dimensions):
                share = budget * (block.stop - block.start) / dimensions * (1 + 2 * _SLACK) + _SLACK
                meets |= gap[:, block].sum(axis=1) <= share
            if one_block:
                meets &= tiles[others] >= tiles[n]
            out.append(np.stack([np.full(meets.sum(), tiles[n]), tiles[others[meets]]]))
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
        return pa.table({"tile": pairs[0], "other": pairs[1]})

    return dealt.groupBy("a", "b").applyInArrow(near, "tile long, other long")


def _links(classes: DataFrame, rows: int, dimensions: int, least: float) -> DataFrame:
    """class, links, a, b: how many vectors each class links with, and edges (a, b) of classes; one length of vectors."""
    tiled = checkpointed(_tiled(classes, rows, dimensions))
    pairs = checkpointed(_tile_pairs(tiled, dimensions, least))
    sides = pairs.select("tile", "other", F.lit(False).alias("second"), F.col("tile").alias("mine")).unionByName(
        pairs.where("tile <> other").select("tile", "other", F.lit(True).alias("second"), F.col("other").alias("mine"))
    )
    met = tiled.withColumnRenamed("tile", "mine").join(bounded(sides, 200_000), "mine")
    return checkpointed(met.groupBy("tile", "other").applyInArrow(_meet(least), "class long, links long, a long, b long"))


def near_vectors(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of least or more (0 < least <= 1), whose
    components have the precision of the column: float, or else double. n_links
    counts the other vectors that a vector links with; component_id is the
    smallest vec_id that links reach, itself included; kept tells that it is the
    vector's own. Null vectors, zero vectors, and vectors with null or
    non-finite components link with nothing, and vectors of different lengths
    don't link: each length is joined by itself. Rows are vectors of their own
    whatever ids they share; a row without an id links like any other, and is
    kept if its component has no id at all. Equal vectors are one class with a
    count, and links of a class are counted once for all its vectors. Other
    columns are ignored; an empty table gives an empty result.
    """
    kind = "float" if vectors.schema[embedding].dataType == ArrayType(FloatType()) else "double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    clean = (
        F.col("v").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("usable", F.coalesce(clean, F.lit(False)))
    usable = rows.where("usable").select("vec_id", "v")
    grouped = usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # The checkpoint settles the numbers of the classes.
    numbered = checkpointed(grouped.select(F.monotonically_increasing_id().alias("class"), "copies", "v", "least"))
    shapes = numbered.groupBy(F.size("v").alias("length")).count().orderBy("length").collect()
    alone = F.struct(F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("NOT usable").select("vec_id", alone.alias("x"))
    if shapes:
        parts = [
            _links(numbered.where(F.size("v") == s.length).select("class", "copies", "v"), s["count"], s.length, least) for s in shapes
        ]
        found = reduce(DataFrame.unionByName, parts)
        links = found.where("class IS NOT NULL").groupBy("class").agg(F.sum("links").alias("links"))
        components = connected_components(found.where("a IS NOT NULL").select("a", "b"))
        labelled = checkpointed(
            numbered.join(links, "class", "left")
            .join(bounded(components), numbered["class"] == components.node, "left")
            .select(
                "v", "least",
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                F.coalesce("component", "class").alias("component"),
            )
        )
        smallest = checkpointed(labelled.groupBy("component").agg(F.min("least").alias("component_id")))
        resolved = labelled.join(bounded(smallest), "component").select("v", "links", "component_id")
        x = F.struct(F.col("links").alias("n_links"), "component_id").alias("x")
        out = out.unionByName(usable.join(resolved, "v").select("vec_id", x))
    return out.select("vec_id", "x.*", F.col("x.component_id").eqNullSafe(F.col("vec_id")).alias("kept"))
