"""Token ids in shards that are compressed by a Re-Pair grammar.

A shard repeatedly replaces its frequent pairs of ids by nonterminals, until
no pair is used often enough to pay for a rule. It stores the rules, the length of each nonterminal's expansion, and where each
document starts in the compressed sequence, so that any document or range of
tokens is decoded without the rest. Rules never cross the end of a document.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from weft.lineage import bounded, checkpointed, shared_folder
from weft.llm.common import append_columns, binary_values, release_memory, runs
from weft.llm.tokens import encoder, id_type

#: Bytes of ids of a shard at most, unless it is one document.
SHARD_BYTES = 4 << 20
#: Documents of a range of doc_ids, on average, and ranges that there are of fewer.
RANGE_DOCUMENTS, RANGES = 1 << 16, 1024
#: Documents of a range at least.
LEAST_DOCUMENTS = 2048
#: Pairs that a round replaces at most, and least uses of a rule: it takes 12 bytes and each use saves two.
ROUND_RULES, LEAST_USES = 8192, 8
#: Counters of a round: 2**20; pairs that share one are told apart by value.
_COUNTER_BITS = 20
_MAGIC = b"RePair1\0"
#: What stands for a null id where ids are compared.
_NO_ID = -(1 << 63)
_STORED = "range long, part long, n_docs long, n_tokens long, data binary"


def _expand(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The expansions of symbols, joined."""
    sizes = lengths[symbols]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(starts[symbols] - (ends - sizes), sizes) + np.arange(total)]


class Shard:
    """Documents' ids as a grammar: symbols 0 (document end), 1.. (ids), then nonterminals."""

    _ARRAYS = (
        ("doc_ids", "<i8"), ("doc_null", "u1"), ("doc_starts", "<i8"), ("alphabet", "<u4"),
        ("rounds", "<i8"), ("left", "<u4"), ("right", "<u4"), ("lengths", "<u4"), ("sequence", None),
    )

    @classmethod
    def build(cls, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray):
        """From all documents' ids, joined, and how many each has; all end with the same id, and none is empty."""
        self = cls()
        self.doc_ids = np.array([d or 0 for d in doc_ids], np.int64)
        self.doc_null = np.array([d is None for d in doc_ids], np.uint8)
        ends = np.cumsum(counts, dtype=np.int64) - 1
        seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
        seen[ids] = True
        end_id = ids[-1:] if len(ids) else np.zeros(1, np.uint32)
        self.alphabet = np.r_[end_id, np.flatnonzero(seen)].astype(np.uint32)
        symbol = np.zeros(len(seen), np.uint32)
        symbol[self.alphabet[1:]] = np.arange(1, len(self.alphabet))
        sequence = symbol[ids]
        sequence[ends] = 0
        left, right, rounds = [], [], []
        size = len(self.alphabet)
        # Where a pair may begin that is used often enough; none crosses a document's end.
        open_ = np.ones(len(sequence), bool)
        open_[ends] = open_[ends[ends > 0] - 1] = False
        exact = False
        while True:
            a, b, sequence, open_ = cls._round(sequence, open_, size, len(rounds), exact)
            if len(a):
                left.append(a)
                right.append(b)
                rounds.append(len(a))
                size += len(a)
            elif exact:
                break
            exact = not len(a)  # no counter had a rule to give: count pair by pair
        none = np.zeros(0, np.uint32)
        self.left, self.right = np.concatenate([none, *left]), np.concatenate([none, *right])
        self.rounds = np.array(rounds, np.int64)
        lengths = np.ones(size, np.uint32)
        at = len(self.alphabet)
        for a, b in zip(left, right, strict=True):
            lengths[at : at + len(a)] = lengths[a] + lengths[b]
            at += len(a)
        self.lengths = lengths[len(self.alphabet) :]
        self.sequence = sequence.astype("<u2" if size <= 1 << 16 else "<u4")
        self.doc_starts = np.r_[0, np.flatnonzero(sequence == 0) + 1].astype(np.int64)
        return self

    @staticmethod
    def _round(sequence: np.ndarray, open_: np.ndarray, size: int, turn: int, exact: bool):
        """Rules for frequent pairs, numbered from size, the sequence that uses them, and where pairs are still open.

        A pair that is rare can't become frequent unless it holds a new symbol,
        so later rounds look at few places. Counters are shared by pairs that
        the turn's hash brings together; with exact, each pair has its own.
        """
        at = np.flatnonzero(open_)
        a, b = sequence[at], sequence[at + 1]
        if exact:
            _, slot = np.unique(a.astype(np.uint64) << np.uint64(32) | b, return_inverse=True)
        else:
            slot = a * np.uint32(0x9E3779B1 + 2 * turn)
            slot += b * np.uint32(0x85EBCA77 + 2 * turn)
            slot >>= np.uint32(32 - _COUNTER_BITS)
            slot = slot.astype(np.int64)
        counts = np.bincount(slot, minlength=1)
        often = np.flatnonzero(counts >= LEAST_USES)
        if not len(often):
            none = np.zeros(0, np.uint32)
            return none, none, sequence, open_
        live = (counts >= LEAST_USES)[slot]
        if len(often) > ROUND_RULES:
            often = often[np.argpartition(-counts[often], ROUND_RULES)[:ROUND_RULES]]
        rule = np.full(len(counts), -1, np.int32)
        rule[often] = np.arange(len(often))
        open_ = np.zeros(len(sequence), bool)
        open_[at[live]] = True
        use = np.flatnonzero((rule >= 0)[slot])
        rules = rule[slot[use]]
        sample = np.zeros(len(often), np.int64)
        sample[rules[::-1]] = use[::-1]  # the first place of each counter tells its pair
        same = (a[use] == a[sample][rules]) & (b[use] == b[sample][rules])
        at, rules = at[use[same]], rules[same]
        # Of overlapping places, every second one in a run is replaced.
        fresh = np.r_[True, np.diff(at) != 1][: len(at)]
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        even = (np.arange(len(at)) - run) % 2 == 0
        at, rules = at[even], rules[even]
        useful = np.bincount(rules, minlength=len(often)) >= LEAST_USES
        keep = useful[rules]
        at, rules = at[keep], rules[keep]
        number = np.cumsum(useful) - 1
        left, right = a[sample[useful]], b[sample[useful]]
        out = sequence.copy()
        out[at] = size + number[rules]
        stays = np.ones(len(out), bool)
        stays[at + 1] = False
        out, open_ = out[stays], open_[stays]
        new = np.flatnonzero(out >= size)
        open_[new] = out[new + 1] != 0
        behind = new[new > 0] - 1
        open_[behind] = out[behind] != 0
        return left, right, out, open_

    def _tables(self):
        if not hasattr(self, "_table"):
            size = len(self.alphabet)
            lengths = np.r_[np.ones(size, np.int64), self.lengths.astype(np.int64)]
            starts = np.r_[np.arange(size), size + np.cumsum(lengths[size:]) - lengths[size:]]
            table, at = self.alphabet, 0
            for n in self.rounds.tolist():
                pairs = np.stack([self.left[at : at + n], self.right[at : at + n]], axis=1).ravel()
                table = np.r_[table, _expand(table, starts, lengths, pairs)]
                at += n
            self._table = table, starts, lengths
        return self._table

    def document(self, n: int) -> np.ndarray:
        """The ids of the n-th document."""
        low, high = self.doc_starts[n], self.doc_starts[n + 1]
        return _expand(*self._tables(), self.sequence[low:high])

    def tokens(self, start: int, count: int) -> np.ndarray:
        """A range of the shard's tokens, found by the lengths of the expansions."""
        _, _, lengths = self._tables()
        ends = np.cumsum(lengths[self.sequence])
        low = int(np.searchsorted(ends, start, "right"))
        high = int(np.searchsorted(ends, start + count, "left")) + 1
        skip = start - (int(ends[low - 1]) if low else 0)
        return _expand(*self._tables(), self.sequence[low:high])[skip : skip + count]

    def all_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each document."""
        _, _, lengths = self._tables()
        ends = np.r_[0, np.cumsum(lengths[self.sequence])]
        return _expand(*self._tables(), self.sequence), np.diff(ends[self.doc_starts])

    def to_bytes(self) -> bytes:
        """The format: magic, sizes of the arrays and the sequence's width, then the arrays."""
        arrays = [np.ascontiguousarray(getattr(self, n), t) for n, t in self._ARRAYS]
        head = np.array([*map(len, arrays), self.sequence.dtype.itemsize], "<i8")
        return _MAGIC + head.tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, data: bytes):
        if data[: len(_MAGIC)] != _MAGIC:
            raise ValueError("not a shard of token ids")
        self, count = cls(), len(cls._ARRAYS)
        head = np.frombuffer(data, "<i8", count + 1, len(_MAGIC)).tolist()
        at = len(_MAGIC) + 8 * (count + 1)
        for (name, kind), size in zip(cls._ARRAYS, head, strict=False):
            kind = np.dtype(kind or f"<u{head[-1]}")
            setattr(self, name, np.frombuffer(data, kind, size, at))
            at += size * kind.itemsize
        return self


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, special_tokens: bool = True, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of docs(doc_id, text) to path: rows (range, part, n_docs, n_tokens, data), one for each shard.

    Shards ascend by range and part, and the documents in them by doc_id
    (null ids first; rows that repeat a doc_id lie side by side, ordered by
    XXH64 of their texts, and are dealt to several ranges if they are many, even
    where they repeat the text too). A null text is empty, so it holds end_id alone. Names of special
    tokens in a text are these tokens, or else ordinary text. An empty table
    writes no shard. A task sorts its ranges, on disk if need be, and holds one
    shard of shard_bytes, or one document that has more. The driver holds one
    key for each range of RANGE_DOCUMENTS.
    """
    text = F.col("text").cast("string")
    copy = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 16) - 1))  # tells rows apart that repeat everything
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), copy.alias("copy"))
    # A null id comes before the smallest number.
    number = F.coalesce("doc_id", F.lit(_NO_ID).cast("long"))
    key = F.struct(number.alias("a"), F.col("doc_id").isNotNull().cast("int").alias("b"), F.col("hash").alias("c"), F.col("copy").alias("d"))
    count = docs.count()
    ranges = max(1, min(-(-count // LEAST_DOCUMENTS), RANGES), -(-count // RANGE_DOCUMENTS))
    plain = F.struct("a", "b", F.lit(_NO_ID).cast("long").alias("c"), F.lit(_NO_ID).cast("long").alias("d"))
    dealt = narrow.select(key.alias("key")).select("key.a", "key.b").repartitionByRange(ranges, "a", "b")
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min(plain).alias("first"), F.count("*").alias("n")).collect()
    if any(r.n > 2 * -(-count // ranges) for r in firsts):  # rows share ids: texts decide too, which are read for that only then
        dealt = narrow.select(key.alias("key")).repartitionByRange(ranges, "key")
        firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min("key").alias("first")).collect()
    bounds = sorted(tuple(r["first"]) for r in firsts)[1:]
    numbers = np.array([b[0] for b in bounds], np.int64)
    dtype = id_type(tokenizer)

    def make():
        encode = encoder(tokenizer, special_tokens).encode

        def encoded(doc_ids, texts, hashes, copies):
            mine = pc.fill_null(doc_ids, _NO_ID).to_numpy(zero_copy_only=False)
            low, place = np.searchsorted(numbers, mine, "left"), np.searchsorted(numbers, mine, "right")
            for k in np.flatnonzero(low < place).tolist():  # of one number with a bound: the rest of the key decides
                whole = (int(mine[k]), int(doc_ids[k].is_valid), hashes[k].as_py(), copies[k].as_py())
                place[k] = bisect_right(bounds, whole, int(low[k]), int(place[k]))
            return [encode(texts, end_id), pa.array(place)]

        return encoded

    def build(batches):
        last, part = None, 0
        for table in runs(batches, "ids", shard_bytes, key="range"):
            number = table.column("range")[0].as_py()
            last, part = number, part + 1 if number == last else 0
            ids, counts = binary_values(table.column("ids"), dtype)
            shard = Shard.build(table.column("doc_id").to_pylist(), ids, counts)
            columns = [[number], [part], [len(counts)], [len(ids)]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array([shard.to_bytes()], pa.binary())],
                names=["range", "part", "n_docs", "n_tokens", "data"],
            )
        release_memory()

    coded = append_columns(narrow, ["doc_id", "text", "hash", "copy"], make, "ids binary, range long").drop("text", "copy")
    ordered = coded.repartition("range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "hash")
    ordered.mapInArrow(build, _STORED).write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; the CRC is of the decoded
    ids as little-endian unsigned 32-bit integers.
    """
    stored = spark.read.schema(_STORED).parquet(path)
    sizes = checkpointed(stored.select("range", "part", "n_tokens"))
    # Shards are summed up inside ranges, and only the ranges' sums in one task.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    ranges = checkpointed(sums.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    starts = checkpointed(
        sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bounded(ranges), "range")
        .select("range", "part", (F.col("before") + F.col("inside")).alias("first"))
    )

    def decode(batches):
        for batch in batches:
            for data, first in zip(batch.column("data"), batch.column("first").to_pylist(), strict=True):
                shard = Shard.from_bytes(data.as_py())
                ids, sizes = shard.all_tokens()
                ids = ids.astype("<u4", copy=False)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                doc_ids = pa.array(shard.doc_ids, mask=shard.doc_null.astype(bool))
                columns = [doc_ids, pa.array(begins + first), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = stored.join(bounded(starts), ["range", "part"]).select("data", "first")
    return joined.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, special_tokens: bool = True) -> DataFrame:
    """Write docs to a new folder beside the checkpoints and read it back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, end_id, path, special_tokens)
    return read_tokens(spark, path)
