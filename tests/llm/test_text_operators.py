"""Dedup, token and packing operators against brute force on a small table."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import SCHEMA, components, documents, frame
from weft.llm import common, exact_dedup, packing, sharding, simhash_dedup, token_store, tokens

WORD, BYTE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SPACE = r"[\x20\x09-\x0D]"


@pytest.mark.parametrize("clashes", [False, True])
def test_exact_groups(spark, clashes):
    rows = documents()
    norm = {r[0]: re.sub(f"{SPACE}+", " ", r[1] or "") for r in rows}
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, rows, clashes)).collect()}
    assert got.keys() == norm.keys()
    for doc_id, text in norm.items():
        same = [d for d, t in norm.items() if t == text]
        row = got[doc_id]
        assert (row.keep_id, row.group_size, row.kept) == (min(same), len(same), doc_id == min(same))
        assert row.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_groups_of_null_and_repeated_ids(spark):
    rows = [(None, "a b", None, None, 3), (5, "a  b", None, None, 4), (7, "c", None, None, 1), (7, "c", None, None, 1)]
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows)).collect())
    assert got == [(0, 5, 2, False), (5, 5, 2, True), (7, 7, 2, True), (7, 7, 2, True)]


def test_counting_quotient_filter_merges_without_loss():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << 12, n).astype(np.uint64) for n in (0, 1, 500, 3000)]
    build = exact_dedup.CountingQuotientFilter.build
    merged = exact_dedup.CountingQuotientFilter.merge([build(p, 12) for p in parts], 12)
    merged = exact_dedup.CountingQuotientFilter.from_bytes(merged.to_bytes())
    want = Counter(np.concatenate(parts).tolist())
    keys, counts = merged.items()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want
    assert all(merged.count(k) == want.get(k, 0) for k in range(0, 1 << 12, 7))


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("clashes", [False, True])
def test_near_groups(spark, clashes):
    rows = documents()
    fp = {r[0]: brute_simhash(r[1]) for r in rows}
    linked = [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2]
    want = components(fp, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_groups(frame(spark, rows, clashes)).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


def test_links_of_crowded_fingerprints():
    rng = np.random.default_rng(2)
    found = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 16, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 16, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 9, 3000).astype(np.uint64)))
    values = found.tolist()
    want = components(values, [(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 2])
    edges = simhash_dedup.bucket_links(found)
    assert components(values, edges) == want and len(edges) < len(values)


def test_bucket_keys_join_every_close_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    flips = rng.integers(0, 64, (2, 500)).astype(np.uint64)
    b = a ^ (np.uint64(1) << flips[0]) ^ (np.uint64(1) << flips[1])
    assert (simhash_dedup.bucket_keys(a) == simhash_dedup.bucket_keys(b)).any(axis=1).all()


def test_encoder_equals_whole_text_encoding():
    texts = [r[1] for r in documents()] + ["x <|endoftext|> y", "it's  'LL\r\n ", "İ ΣΣ", "a" * 300, "nul \0 inside", "\0"]
    for path in (WORD, BYTE):
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        encode = tokens.Encoder(path)
        for text, data in zip(texts, encode.encode(pa.array(texts)), strict=True):
            assert np.frombuffer(data.as_py(), encode.dtype).tolist() == whole.encode(text or "", add_special_tokens=False).ids


def ids_of(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("clashes", [False, True])
def test_token_store(spark, clashes):
    rows = documents()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.store_documents(frame(spark, rows, clashes), WORD).collect()}
    start, want = 0, {}
    for row in sorted(rows):
        ids = ids_of(WORD, row[1], 1)
        want[row[0]] = (start, len(ids), crc(ids))
        start += len(ids)
    assert got == want


def test_runs_keep_rows_in_order_and_within_bounds():
    sizes = [3, 0, 9, 1, 1, 20, 2, 2, 2, 5, 0, 0]
    keys = [0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2]
    batch = pa.record_batch({"n": list(range(12)), "x": [b"x" * s for s in sizes], "k": keys})
    batches = [batch[:5], batch[5:5], batch[5:8], batch[8:]]
    tables = list(common.runs(batches, "x", 10, 3, "k"))
    rows = [t.column("n").to_pylist() for t in tables]
    assert sum(rows, []) == list(range(12))
    for t in rows:
        assert len(t) <= 3 and len({keys[n] for n in t}) == 1 and (len(t) == 1 or sum(sizes[n] for n in t) <= 10)
    for t, after in zip(rows, rows[1:]):  # no table ends early
        n = after[0]
        assert keys[n] != keys[t[0]] or len(t) == 3 or sum(sizes[i] for i in t) + sizes[n] > 10
    assert list(common.runs([], "x", 10)) == []


def test_small_shards_and_groups_lose_nothing(spark, tmp_path):
    rows = documents()
    docs = frame(spark, rows)
    token_store.write_tokens(docs, WORD, 1, str(tmp_path / "shards"), shard_bytes=500)
    stored = spark.read.parquet(str(tmp_path / "shards"))
    assert stored.where("n_docs > 1 AND n_tokens > 250").count() == 0 and stored.count() > 5
    start, want = 0, {}
    for row in sorted(rows):
        ids = ids_of(WORD, row[1], 1)
        want[row[0]] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_tokens(spark, str(tmp_path / "shards")).collect()} == want
    encoded = tokens.with_ids(docs.select("doc_id", "text"), BYTE, 0)
    pieces = packing.pack_ids(encoded, tokens.id_type(BYTE), 64, group_bytes=400).collect()
    held = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == held.get(p.doc_id, 0)
        held[p.doc_id] = p.start + p.length
    assert held == {p.doc_id: p.doc_tokens for p in pieces} and len(held) == len(rows)
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 64


def test_grammar_ends_when_no_pair_pays_for_a_rule():
    rng = np.random.default_rng(5)
    phrase = rng.integers(2, 49000, 300)
    documents = [np.r_[phrase, rng.integers(2, 400, 50), [1]] for _ in range(60)] + [np.r_[np.full(900, 7), [1]]]
    ids = np.concatenate(documents).astype(np.uint32)
    shard = token_store.Shard.build([*range(61)], ids, np.array([*map(len, documents)]))
    pairs = {}
    for n in range(61):
        part = shard.sequence[shard.doc_starts[n] : shard.doc_starts[n + 1] - 1].tolist()
        at = 0
        while at < len(part) - 1:  # of a run of one symbol every second pair counts
            pairs[tuple(part[at : at + 2])] = pairs.get(tuple(part[at : at + 2]), 0) + 1
            at += 2 if part[at] == part[at + 1] else 1
    assert max(pairs.values()) < token_store.LEAST_USES
    assert shard.lengths.max() >= 300  # the passage is one rule
    back = token_store.Shard.from_bytes(shard.to_bytes())
    assert (back.all_tokens()[0] == ids).all()


def test_names_of_special_tokens_are_tokens_as_in_the_library(spark):
    texts = ["x <|endoftext|> y", "<|startoftext|>", "A<|ENDOFTEXT|>b", "a <| b", None, "plain text", "tail<|endoftext|><|endoftext|>"]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    docs, start = frame(spark, rows), 0
    stored = {r.doc_id: r for r in token_store.store_documents(docs, WORD).collect()}
    packed = {r.doc_id: r for r in packing.pack_documents(docs, BYTE, 0).collect()}
    ordinary = {r.doc_id: r for r in packing.pack_documents(docs, BYTE, 0, special_tokens=False).collect()}
    for i, text in enumerate(texts):
        ids, byte_ids = ids_of(WORD, text, 1), ids_of(BYTE, text, 0)
        assert (stored[i].start, stored[i].n_tokens, stored[i].ids_crc32) == (start, len(ids), crc(ids))
        assert (packed[i].doc_tokens, packed[i].ids_crc32) == (len(byte_ids), crc(byte_ids))
        start += len(ids)
    assert ordinary[0].doc_tokens > packed[0].doc_tokens and ordinary[5].ids_crc32 == packed[5].ids_crc32


def test_shard_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    phrase = rng.integers(0, 49000, 40)
    documents = [np.r_[np.tile(phrase, rng.integers(0, 30)), rng.integers(0, 50, rng.integers(0, 400)), [1]].astype(np.uint32) for _ in range(80)]
    documents.append(np.full(5000, 7, np.uint32))
    documents[-1][-1] = 1
    shard = token_store.Shard.from_bytes(token_store.Shard.build([*range(80), None], np.concatenate(documents), np.array([*map(len, documents)])).to_bytes())
    whole = np.concatenate(documents)
    ids, sizes = shard.all_tokens()
    assert np.array_equal(ids, whole) and sizes.tolist() == [len(d) for d in documents]
    assert len(shard.sequence) < 0.5 * len(whole)
    for n in (0, 17, 80):
        assert np.array_equal(shard.document(n), documents[n])
    for at, count in ((0, 1), (1234, 77), (len(whole) - 5, 5)):
        assert np.array_equal(shard.tokens(at, count), whole[at : at + count])


@pytest.mark.parametrize("clashes", [False, True])
def test_packing(spark, clashes):
    rows = documents()
    got = packing.pack_documents(frame(spark, rows, clashes), BYTE).collect()
    ids = {r[0]: ids_of(BYTE, r[1], 0) for r in rows}
    pieces, sequences = {}, {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for spans, end in [(s, len(ids[d])) for d, s in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == end if end is not None else at <= 1024
    total = sum(map(len, ids.values()))
    assert len(sequences) == -(-total // 1024)


def test_first_fit_decreasing_fills_all_bins_but_one():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 3000, 400).tolist()
    bins = packing.first_fit_decreasing(lengths, 1024)
    assert len(bins) == -(-sum(lengths) // 1024) and max(sum(p[2] for p in b) for b in bins) <= 1024
    assert sum(p[2] for b in bins for p in b) == sum(lengths)


@pytest.mark.parametrize("clashes", [False, True])
def test_sharding(spark, clashes):
    rows = documents(400)
    got = sharding.shard_documents(frame(spark, rows, clashes)).collect()
    text = {r[0]: (r[1] or "").encode() for r in rows}
    slots = {}
    for r in got:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "key")
        assert r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0 < sum(r.grown_shard == 8 for r in got) < 0.25 * len(rows)


def brute_shard(doc_id, shards):
    score = {}
    for n in range(shards):
        digits = hashlib.md5(f"={doc_id}#{n}".encode()).hexdigest()[:13]
        score[n] = -1 / np.log((int(digits, 16) + 0.5) / 2**52)
    return max(score, key=lambda n: (score[n], -n))


def test_sharding_against_brute_force_with_null_and_repeated_ids(spark):
    rows = documents(200) + [(None, t, None, None, 1) for t in ("a", "b", "b", None)] + [(1, "again", None, None, 5), (1, None, None, None, 0)]
    docs = frame(spark, rows, True).withColumn("hash", F.lit("y")).withColumn("bucket", F.lit("y")).withColumn("row", F.lit("y"))
    got = sharding.shard_documents(docs).collect()
    named = [r for r in got if r.doc_id is not None]
    assert all((r.shard, r.grown_shard) == (brute_shard(r.doc_id, 8), brute_shard(r.doc_id, 9)) for r in named)
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sharding.shard_rows(docs, ["doc_id"], [1.0, 2.0])
    assert {r["hash"] + r["bucket"] + r["row"] for r in whole.collect()} == {"yyy"}


def test_weights_shift_rows_to_heavier_shards(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    counts = {r.shard: r["count"] for r in sharding.shard_rows(df, ["k"], [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(counts[1] / 20000 - 0.75) < 0.02


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for result in (
        exact_dedup.exact_groups(empty), simhash_dedup.near_groups(empty), token_store.store_documents(empty, WORD),
        packing.pack_documents(empty, BYTE), sharding.shard_documents(empty),
    ):
        assert result.collect() == []


def test_null_ids(spark):
    rows = [(None, "a b c", None, None, 5), (None, "d", None, None, 1), (4, "a b c", None, None, 5)]
    docs = frame(spark, rows)
    assert sorted((r.doc_id is None, r.component_id) for r in simhash_dedup.near_groups(docs).collect() if r.component_id) == [(False, 4), (True, 4)]
    assert [r.doc_id for r in token_store.store_documents(docs, WORD).orderBy("start").collect()] == [None, None, 4]
    assert packing.pack_documents(docs, BYTE).count() == 3
    assert sharding.shard_documents(docs).count() == 3


def test_tokens_of_rows_that_share_an_id_fill_several_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "LEAST_DOCUMENTS", 64)
    monkeypatch.setattr(token_store, "RANGE_DOCUMENTS", 64)
    lowest = -(1 << 63)
    rows = [(None, f"text {k % 90} of many", None, None, 0) for k in range(400)] + [(5, "one text", None, None, 0)] * 300 + [(lowest, "x", None, None, 0), (4, "y", None, None, 0), (6, "z", None, None, 0)]
    docs = frame(spark, rows)
    token_store.write_tokens(docs, WORD, 1, str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.select("range").distinct().count() >= 8 and stored.agg({"n_docs": "max"}).first()[0] < 200
    got = [tuple(r) for r in token_store.read_tokens(spark, str(tmp_path / "s")).orderBy("start").collect()]
    assert [r[0] for r in got] == [None] * 400 + [lowest, 4] + [5] * 300 + [6]
    ends = np.cumsum([r[2] for r in got]).tolist()
    assert [r[1] for r in got] == [0, *ends[:-1]]
    want = sorted((r[0] is not None, r[0] or 0, crc(ids_of(WORD, r[1], 1))) for r in rows)
    assert sorted((r[0] is not None, r[0] or 0, r[3]) for r in got) == want
