"""Resampling documents towards a target distribution by hashed n-gram features.

Words and pairs of words are hashed to buckets. A bucket's gain is the log of
how much more likely the target is to use it; a document's weight is the mean
gain of its features, and with Gumbel noise the highest scores are a draw
without replacement. Weights are scored on arrays, a batch of texts at a time.
The draw sorts runs of eligible documents in each partition, cuts them at
regular samples of all runs into ranges, and merges each range's pieces by a
tournament tree; ranges behind the last document drawn are not merged.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weft.lineage import checkpointed
from weft.llm.common import append_columns, release_memory, small_batches

BUCKETS = 10_000
#: Bytes of texts whose words are looked at together; longer words than so many bytes are hashed one by one.
BLOCK_BYTES, LONG_WORD = 1 << 20, 48
#: Rows of a sorted run and of a block of it, and rows that a range has about.
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS = 1 << 20, 1 << 12, 1 << 14
#: Ranges there are at most; above that many, they grow.
RANGES = 1 << 14
#: Samples of the runs for each range.
SAMPLES = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words, in lower case: digits, letters and all of other characters.
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True
_OPEN = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = (values >> np.uint32(1)) ^ np.where(values & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return values


_CRC = _crc_table()


def _advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of words; the words are in order of falling size."""
    state = state.copy()
    short = int(np.searchsorted(-sizes, -LONG_WORD, "left"))  # words before it are longer
    for k in range(short):
        word = data[starts[k] : starts[k] + sizes[k]].tobytes()
        state[k] = _OPEN ^ np.uint32(zlib.crc32(word, int(_OPEN ^ state[k])))
    most = int(sizes[short]) if short < len(sizes) else 0
    for at in range(most):
        stop = int(np.searchsorted(-sizes, -at, "left"))  # words before it have more than at bytes
        mine = state[short:stop]
        state[short:stop] = _CRC[(mine ^ data[starts[short:stop] + at]) & np.uint32(0xFF)] ^ (mine >> np.uint32(8))
    return state


class Features:
    """Buckets of the words and pairs of words of texts that follow each other, block by block."""

    def __init__(self, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES):
        self.buckets, self.block_bytes = buckets, block_bytes

    def of(self, texts: pa.Array):
        """For each block: the rows of texts and the buckets of its features, and the rows of its words."""
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
        if not len(texts) or texts.buffers()[2] is None:
            return
        _, offsets, buffer = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer, np.uint8)
        null = texts.is_null().to_numpy(zero_copy_only=False)
        at, last = int(edges[0]), int(edges[-1])
        held = None  # the row of the word before the block and the register behind it
        while at < last:
            stop = min(at + self.block_bytes, last)
            end = int(edges[np.searchsorted(edges, stop)])  # of the text that the block would cut
            if stop < end:
                stop = self._word_end(data, at, stop, end)
            found = self._block(data[at:stop], edges, at, held)
            at = stop
            if found is None:
                continue
            rows, buckets, words, held = found
            if null.any():  # a null text may have bytes in the buffer
                words, keep = words[~null[words]], ~null[rows]
                rows, buckets = rows[keep], buckets[keep]
            yield rows, buckets, words

    def _word_end(self, data, at, stop, end):
        """The last place up to stop, or else the first behind it, where no word goes on."""
        inside = np.flatnonzero(~_WORD[_LOWER[data[at:stop]]])
        if len(inside):
            return at + int(inside[-1]) + 1
        while stop < end:
            ahead = np.flatnonzero(~_WORD[_LOWER[data[stop : min(end, stop + self.block_bytes)]]])
            if len(ahead):
                return stop + int(ahead[0]) + 1
            stop = min(end, stop + self.block_bytes)
        return end

    def _block(self, raw, edges, base, held):
        data = _LOWER[raw]
        inside = _WORD[data]
        before = np.r_[False, inside[:-1]]
        borders = edges[np.searchsorted(edges, base) : np.searchsorted(edges, base + len(data))] - base
        before[borders] = False  # a text's first byte begins a word
        starts = np.flatnonzero(inside & ~before)
        if not len(starts):
            return None
        after = np.r_[(inside & before)[1:], False]
        sizes = np.flatnonzero(inside & ~after) + 1 - starts
        rows = np.searchsorted(edges, starts + base, "right") - 1
        order = np.argsort(-sizes, kind="stable")
        by_size, ordered = sizes[order], starts[order]
        first = np.empty(len(starts), np.uint32)
        first[order] = _advance(np.full(len(starts), _OPEN), data, ordered, by_size)
        follows = np.r_[held is not None and held[0] == rows[0], rows[1:] == rows[:-1]]
        earlier = np.r_[held[1] if held is not None else _OPEN, first[:-1]].astype(np.uint32)
        spaced = _CRC[(earlier ^ np.uint32(32)) & np.uint32(0xFF)] ^ (earlier >> np.uint32(8))
        pair = order[follows[order]]
        second = _advance(spaced[pair], data, starts[pair], sizes[pair])
        registers = np.concatenate([first, second])
        return (
            np.concatenate([rows, rows[pair]]), ((registers ^ _OPEN) % np.uint32(self.buckets)).astype(np.int64), rows,
            (rows[-1], first[-1]),
        )


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is used by the column text of texts: a sum of an array for each task."""

    def count(batches):
        features, counts = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in features.of(batch.column(0)):
                counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])
        release_memory()

    small_batches(texts.sparkSession)
    summed = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in summed.collect():  # one row for each bucket
        counts[row.bucket] = row.n
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + n) / ((s + 1) (T + n)))) of each of n buckets."""
    n, big_s, big_t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((target + 1.0) * (big_s + n)) / ((corpus + 1.0) * (big_t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def gumbel(seed: str, doc_id: int | None) -> int:
    """floor(-1000 ln(-ln u)) of a uniform number that seed and a document's id choose (null: no id)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored_documents(docs: DataFrame, target: DataFrame, seed: str = "7", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of docs(doc_id, text) towards the texts of target(text).

    Words are runs of digits, ASCII letters in lower case and other characters
    beyond ASCII; features are words and pairs of words in a text, repeats
    counted. weight is the floor of the mean gain, 0 without features; score
    adds Gumbel noise. A null text has no words.
    """
    gains = gains_of(bucket_counts(docs.select("text"), buckets), bucket_counts(target.select("text"), buckets))

    def make():
        features = Features(buckets)

        def score(ids, texts):
            n, words, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for rows, found, mine in features.of(texts):
                n += np.bincount(rows, minlength=len(n))
                words += np.bincount(mine, minlength=len(n))
                # Sums of whole numbers are exact in doubles up to 2^53.
                total += np.bincount(rows, gains[found], minlength=len(n)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noise = np.array([gumbel(seed, i) for i in ids.to_pylist()], np.int64)
            return [pa.array(x) for x in (n, words, weight, weight + noise)]

        return score

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return append_columns(narrow, ["doc_id", "text"], make, "n_features long, n_words long, weight long, score long").drop("text")


class TournamentTree:
    """Merges sorted runs of keys: a binary tree of matches whose winner is replayed from its leaf to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.places = [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        heads = [run[0] if run else None for run in runs] + [None] * (self.size - len(runs))
        #: Winner of each match: (key, run), or None where both sides are at their end.
        self.match: list = [None] * self.size + [None if h is None else (h, k) for k, h in enumerate(heads)]
        for node in range(self.size - 1, 0, -1):
            self._play(node)

    def _play(self, node: int) -> None:
        a, b = self.match[2 * node], self.match[2 * node + 1]
        self.match[node] = b if a is None or (b is not None and b < a) else a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in the order of keys."""
        while self.runs and (won := self.match[1]) is not None:
            run = won[1]
            place = self.places[run]
            yield run, place
            self.places[run] = place + 1
            node = self.size + run
            self.match[node] = (self.runs[run][place + 1], run) if place + 1 < len(self.runs[run]) else None
            while node > 1:
                node //= 2
                self._play(node)


_KEYS = ("neg_score", "no_id", "doc_id", "row")
_CARRIED = ("n_features", "weight")


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, len(_KEYS) + len(_CARRIED))


def ranked(rows: DataFrame, count: int, total: int, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The first count of total rows(row, doc_id, n_features, weight, score) by falling score, then rising doc_id (null ids last), then row.

    Returns doc_id, n_features, weight, score, rank from 1, and row. row must
    tell rows apart and stay the same when rows are read again (a
    checkpointed table), so that any number of rows may share score and id:
    all keys differ, and no range holds more than its share of rows. Runs are
    kept as a table of blocks; the driver holds SAMPLES keys for each of at
    most RANGES ranges.
    """
    range_rows = max(range_rows, -(-total // RANGES))
    step = max(1, range_rows // SAMPLES)
    columns = [*_KEYS, *_CARRIED]

    def sort(batches):
        def run_of(held):
            table = np.concatenate(held)
            return table[np.lexsort(tuple(table[:, k] for k in range(len(_KEYS) - 1, -1, -1)))]

        def blocks(table):
            run = int(table[:, 3].min())  # a row is in one run only
            for part, at in enumerate(range(0, len(table), block_rows)):
                data = table[at : at + block_rows].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([part]), pa.array([data], pa.binary())], names=["run", "part", "keys"])

        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1))
            size += batch.num_rows
            if size >= run_rows:
                yield from blocks(run_of(held))
                held, size = [], 0
        if size:
            yield from blocks(run_of(held))

    keyed = rows.select(
        (-F.col("score")).alias("neg_score"), F.col("doc_id").isNull().cast("long").alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("row").cast("long").alias("row"), *_CARRIED,
    )
    runs = checkpointed(keyed.select(*columns).mapInArrow(sort, "run long, part long, keys binary"))

    def sample(batches):
        # Evenly spaced over a run, from a place that the run's number scatters: short runs are sampled by their share.
        for batch in batches:
            for run, part, data in zip(batch.column("run").to_pylist(), batch.column("part").to_pylist(), batch.column("keys"), strict=True):
                first = zlib.crc32(str(run).encode()) % step
                taken = _unpacked(data.as_py())[(first - part * block_rows) % step :: step, : len(_KEYS)]
                yield pa.RecordBatch.from_arrays([pa.array(taken[:, k]) for k in range(len(_KEYS))], names=list(_KEYS))

    found = runs.mapInArrow(sample, ", ".join(f"{c} long" for c in _KEYS)).collect()
    samples = sorted(tuple(r) for r in found)
    ranges = max(1, min(-(-total // range_rows), len(samples)))
    splitters = [samples[len(samples) * k // ranges] for k in range(1, ranges)]

    def cut(batches):
        for batch in batches:
            for run, part, data in zip(batch.column("run").to_pylist(), batch.column("part").to_pylist(), batch.column("keys"), strict=True):
                table = _unpacked(data.as_py())
                keys = list(map(tuple, table[:, : len(_KEYS)].tolist()))
                low, high = bisect_left(splitters, keys[0]), bisect_left(splitters, keys[-1])
                edges = [0, *[bisect_left(keys, s) for s in splitters[low:high]], len(keys)]
                for number, (a, b) in enumerate(zip(edges, edges[1:], strict=False), low):
                    if a < b:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x]) for x in (number, run, part, b - a)] + [pa.array([table[a:b].tobytes()], pa.binary())],
                            names=["range", "run", "part", "n", "keys"],
                        )

    pieces = checkpointed(runs.mapInArrow(cut, "range long, run long, part long, n long, keys binary"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = pieces.groupBy("range").agg(F.sum("n").alias("n"))
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).where(F.col("start") < count)
    needed = pieces.join(F.broadcast(starts), "range").select("range", "start", "run", "part", "keys")

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, start = [], 0
        for batch in batches:
            start = batch.column("start")[0].as_py()
            parts += zip(batch.column("run").to_pylist(), batch.column("part").to_pylist(), batch.column("keys").to_pylist(), strict=True)
        by_run: dict[int, list[np.ndarray]] = {}
        for run, _, data in sorted(parts):
            by_run.setdefault(run, []).append(_unpacked(data))
        tables = [np.concatenate(x) for x in by_run.values()]
        tree = TournamentTree([list(map(tuple, t[:, : len(_KEYS)].tolist())) for t in tables])
        first = np.cumsum([0, *map(len, tables)])
        order = []
        for run, place in tree:
            if start + len(order) >= count:
                break
            order.append(int(first[run]) + place)
        table = np.concatenate(tables)[order]
        ids = pa.array(table[:, 2], mask=table[:, 1].astype(bool))
        rank = np.arange(start + 1, start + 1 + len(table))
        out = [ids, *(pa.array(np.ascontiguousarray(x)) for x in (table[:, 4], table[:, 5], -table[:, 0], rank, table[:, 3]))]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_features", "weight", "score", "rank", "row"])

    return needed.groupBy("range").applyInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long, row long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of docs(doc_id, text), drawn towards the texts of target(text).

    See scored_documents(). Of the documents with at least least_words words,
    percent of 100 (rounded down) are drawn: the highest scores, of equal ones
    the smaller doc_id (null ids last; rows that repeat score and id in any
    order). rank counts them from 1; it is null for all others. Rows that
    repeat a doc_id are documents of their own. Empty tables give empty
    results, and without target texts weights favour rare features. Other
    columns are ignored.
    """
    scored = checkpointed(scored_documents(docs, target, seed, buckets).withColumn("row", F.monotonically_increasing_id()))
    eligible = scored.where(F.col("n_words") >= least_words)
    total = eligible.count()
    count = percent * total // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    names = ["doc_id", "n_features", "weight", "score"]
    if not count:
        return scored.select(*names, undrawn)
    drawn = checkpointed(ranked(eligible, count, total))
    last = drawn.orderBy(F.desc("rank")).select("score", "doc_id", "row").first()
    key = F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.coalesce("doc_id", F.lit(0)).alias("c"), F.col("row").alias("d"))
    cut = F.struct(F.lit(-last.score).cast("long").alias("a"), F.lit(last.doc_id is None).alias("b"), F.lit(last.doc_id or 0).cast("long").alias("c"), F.lit(last.row).cast("long").alias("d"))
    rest = scored.where((F.col("n_words") < least_words) | (key > cut))
    return drawn.select(*names, "rank").unionByName(rest.select(*names, undrawn))
