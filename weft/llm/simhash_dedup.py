"""SimHash near-dedup with tables of distances to reference fingerprints.

Every distinct fingerprint gets a table row: its Hamming distances to many
reference fingerprints. Within d differing bits no coordinate of two rows
differs by more than d, so a pair whose largest coordinate difference is above
d is discarded and the others are verified on the fingerprints.

The bound alone is no join key. The first 65 references (a base and the base
with one bit flipped) give one: the distance to a flipped reference less the
distance to the base is +1 or -1 and tells how a fingerprint agrees with the
base in that bit. In GROUPS groups of such references, a pair within DISTANCE
bits has equal coordinates in all but DISTANCE groups at least. Rows meet
under each choice of the remaining groups, at most 2**16 distinct fingerprints
under one key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weft.lineage import bounded, checkpointed
from weft.llm.common import append_columns, forest, forget_encoders, release_memory
from weft.operators.graph import connected_components

#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 2
#: Groups of eight references each that a bucket key leaves DISTANCE of out.
GROUPS = 8
#: Seed of the shingle hash and words in a shingle.
SEED, SHINGLE = 42, 3
#: References beside the 65 that make the keys.
RANDOM_REFERENCES = 16
#: Rows of a bucket that are compared at once with all its other rows.
BLOCK = 1024

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 17


def references() -> np.ndarray:
    """The reference fingerprints: a base, the base with each bit flipped, and random ones."""
    rng = np.random.default_rng(7)
    base, *others = rng.integers(0, 1 << 64, 1 + RANDOM_REFERENCES, dtype=np.uint64)
    flipped = base ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    return np.concatenate(([base], flipped, others)).astype(np.uint64)


def pivot_table(fingerprints: np.ndarray) -> np.ndarray:
    """Hamming distances to all references: one uint8 row for each fingerprint."""
    return np.bitwise_count(fingerprints[:, None] ^ references()[None, :])


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of every word shingle; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    begin, end = starts[: 1 - SHINGLE - 1].tolist(), (starts[SHINGLE:] - 1).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """The SimHash of each text: a bit is set if it is in over half of the hashes."""
    out = np.zeros(len(texts), np.uint64)
    pending: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush():
        nonlocal pending, held
        if not pending:
            return
        hashes = np.concatenate([h for _, h in pending])
        sizes = np.array([len(h) for _, h in pending])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        counts = np.zeros((len(pending), 64), np.int64)
        for low in range(0, len(hashes), _CHUNK):  # a very long text spans several chunks
            part = hashes[low : low + _CHUNK]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = int(np.searchsorted(starts, low, "right")) - 1
            inner = starts[first + 1 : int(np.searchsorted(starts, low + len(part)))] - low
            counts[first : first + 1 + len(inner)] += np.add.reduceat(bits, np.r_[0, inner], axis=0, dtype=np.int64)
        majority = counts * 2 > sizes[:, None]
        packed = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
        out[[i for i, _ in pending]] = packed
        pending, held = [], 0

    for i, text in enumerate(texts):
        found = shingle_hashes(text) if text else []
        if found:
            pending.append((i, np.array(found, np.uint64)))
            held += len(found)
            if held >= _CHUNK:
                flush()
    flush()
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "simhash") -> DataFrame:
    """docs with a long column that holds the 64 bits of each text's fingerprint."""

    def make():
        forget_encoders()
        return lambda column: [pa.array(fingerprints(column.to_pylist()).view(np.int64))]

    return append_columns(docs, [text], make, f"{name} long")


def bucket_keys(found: np.ndarray) -> np.ndarray:
    """The keys of each fingerprint: one for each choice of groups that is left out."""
    table = pivot_table(found)
    agrees = table[:, 1:65].astype(np.int16) - table[:, :1] > 0
    groups = np.packbits(agrees, axis=1).astype(np.int64)  # eight references each
    keys = []
    for n, left_out in enumerate(combinations(range(GROUPS), DISTANCE)):
        key = np.full(len(found), n, np.int64)
        for g in range(GROUPS):
            if g not in left_out:
                key = (key << 8) | groups[:, g]
        keys.append(key)
    return np.stack(keys, axis=1)


def bucket_links(found: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of one bucket: never more than its rows."""
    table = pivot_table(found)[:, 65:]
    edges: list[tuple[int, int]] = []
    for low in range(0, len(found), BLOCK):
        block = slice(low, low + BLOCK)
        keep = np.ones((len(found[block]), len(found)), bool)
        for r in range(table.shape[1]):
            gap = table[block, r, None].astype(np.int16) - table[None, :, r]
            keep &= np.abs(gap) <= DISTANCE
        a, b = np.nonzero(keep)
        a = a + low
        a, b = a[later := a < b], b[later]
        linked = np.bitwise_count(found[a] ^ found[b]) <= DISTANCE
        edges = forest([*edges, *zip(a[linked].tolist(), b[linked].tolist(), strict=True)])
    return [(int(found[a]), int(found[b])) for a, b in edges]


def _links(batches):
    """Verified links of rows (key, fp) that arrive sorted by key."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def closed(keys, fps):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        pairs = starts[sizes == 2]
        a, b = fps[pairs].view(np.uint64), fps[pairs + 1].view(np.uint64)
        near = np.abs(pivot_table(a).astype(np.int16) - pivot_table(b)).max(axis=1, initial=0) <= DISTANCE
        near[near] = np.bitwise_count(a[near] ^ b[near]) <= DISTANCE
        edges = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            edges += bucket_links(fps[start : start + size].view(np.uint64))
        spanning = np.array(forest(edges), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(spanning[:, 0]), pa.array(spanning[:, 1])], names=["a", "b"]
        )

    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy()]
        fps = np.r_[fps, batch.column(1).to_numpy()]
        if len(keys) and keys[-1] != keys[0]:
            last = int(np.searchsorted(keys, keys[-1]))
            yield closed(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield closed(keys, fps)
    release_memory()


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of distinct(fp) as all links would."""

    def make():
        def keys(column):
            found = bucket_keys(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            flat = pa.array(found.ravel())
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            return [pa.ListArray.from_arrays(offsets, flat)]

        return keys

    keyed = append_columns(distinct.select("fp"), ["fp"], make, "keys array<long>")
    return (
        keyed.select(F.explode("keys").alias("key"), "fp")
        .repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(_links, "a long, b long")
    )


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id, fp of each document, and fp, component, component_id of each fingerprint; see near_groups()."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = checkpointed(with_fingerprints(narrow, "text", "fp").select("doc_id", "fp"))
    nodes = checkpointed(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    components = connected_components(fingerprint_links(nodes))
    labelled = nodes.join(bounded(components), nodes.fp == components.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    # Only components of several fingerprints need their documents' minimum.
    labelled = checkpointed(labelled)
    smallest = checkpointed(labelled.groupBy("component").agg(F.min("least").alias("component_id")))
    resolved = checkpointed(labelled.join(bounded(smallest), "component").select("fp", "component", "component_id"))
    return marks, resolved


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, the document itself
    included. Documents without words (null, empty, white space) have
    fingerprint zero and link like any other. Null ids are passed over for
    component_id; a component of null ids has none. Equal fingerprints are one
    node, so exact copies cost nothing. An empty table gives an empty result.
    """
    marks, resolved = near_components(docs, doc_id, text)
    return marks.join(bounded(resolved.select("fp", "component_id")), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
