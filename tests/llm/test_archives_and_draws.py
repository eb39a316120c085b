"""Importance resampling, web archives and fill-in-the-middle against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, frame
from weft.llm import fill_middle, importance, warc

# --------------------------------------------------------- fill in the middle


def brute_middle(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_rows():
    rng = random.Random(3)
    rows = documents()
    line = lambda: rng.choice(["", "a", "é中\U0001f600", "<", "<S", "P>", "long words here", "\r"])
    texts = ["\n", "\n\n\n", "no end", "end\n", "a<P>b\nc\nd", "<\n<S\n<P\n<M\n", "\x00\n\x00"]
    texts += ["\n".join(line() for _ in range(rng.randint(1, 400))) for _ in range(40)]
    return rows + [(1000 + i, t, None, None, 0) for i, t in enumerate(texts)] + [(None, "x\ny\nz\n", None, None, 0), rows[5], rows[5]]


@pytest.mark.parametrize("clashes", [False, True])
def test_fill_in_middle(spark, clashes):
    rows = middle_rows()
    docs = frame(spark, rows)
    if clashes:
        docs = docs.withColumn("output", F.lit("x")).withColumn("Form", F.lit(1)).withColumn("n", F.lit(None))
    got = fill_middle.fill_in_middle(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], *brute_middle(r[0], r[1])) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = fill_middle.fill_in_middle(docs).select("text", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_rates_and_empty_table(spark):
    docs = frame(spark, middle_rows())
    for rate, spm in ((0, 50), (30, 0), (60, 100)):
        got = {(r.doc_id, r.form) for r in fill_middle.fill_in_middle(docs, rate=rate, spm=spm).collect()}
        assert got == {(r[0], brute_middle(r[0], r[1], rate, spm)[1]) for r in middle_rows()}
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_cuts_at_every_line_and_block():
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice(["\n", "\n", "a", "é", "中", "\U0001f600"]) for _ in range(rng.randint(0, 300)))
        data, lines = text.encode(), re.findall(r"[^\n]*\n|[^\n]+", text)
        index = fill_middle.LineIndex(data, stride=rng.choice([1, 2, 7, 64]), block_bytes=rng.choice([1, 3, 16, 1 << 20]))
        assert index.count == len(lines) and index.size == len(text)
        for k in range(len(lines) + 1):
            head = "".join(lines[:k])
            assert index.cut(k) == (len(head.encode()), len(head))


# --------------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string"


def page_rows():
    rng = random.Random(8)
    body = lambda: "<p>" + " ".join(rng.choice(["the", "garden", "größe", "中文"]) for _ in range(rng.randint(1, 200)))
    rows = [(i, f"http://h/{i}", body()) for i in range(40)]
    rows += [(100 + i, "http://same/\r\nWARC-Type: x", "same page") for i in range(300)]
    rows += [(50, None, None), (51, "", ""), (52, "u", "\r\n\r\n"), (None, "u", "same page"), (None, "u", "only nulls"), (None, "v", "only nulls")]
    rows += [(7, "again", rows[7][2]), (3, "http://h/3", rows[3][2]), (3, "other", "other payload"), (60, "big", "x" * 6_000_000)]
    rng.shuffle(rows)
    return rows


def brute_archive(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html or "") if len(data) >= least else None
        refers = None if refers == page else refers
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 12])
def test_archived_pages(spark, least):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).withColumn("sha", F.lit("x")).withColumn("first", F.lit(1)).withColumn("size", F.lit("y"))
    got = [tuple(r) for r in warc.archive_pages(pages, least).collect()]
    assert sorted(got, key=repr) == brute_archive(rows, least)


def test_files_are_plain_archives_with_a_dictionary(spark, tmp_path):
    rows = page_rows()
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), archive_bytes=3_000_000)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part") and p.stat().st_size]
    assert len(files) > 1
    seen, known = 0, 0
    for path in files:
        data = path.read_bytes()
        found = list(warc.frames(data))
        known += found[0][1] == warc.DICTIONARY
        seen += sum(magic == warc.FRAME for _, magic, _ in found)
        # Every byte lies in a frame, and a frame holds one record.
        assert all(f is not None and p is None for _, f, p in warc.decode(data))
    assert seen == len(rows) and known >= 1
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for r in got:
        if r.record_type == "response":
            first[r.record_id] = bytes(r.payload).decode()
            assert r.payload_bytes == len(r.payload) and r.payload_digest == warc.payload_digest(bytes(r.payload))
    whole = [first[r.record_id if r.record_type == "response" else r.refers_to] for r in got]
    assert sorted(whole) == sorted(h or "" for _, _, h in rows)
    uris = {r.target_uri for r in got}
    assert "http://same/%0D%0AWARC-Type:%20x" in uris and None in uris


def archive(records, known=None, plain=True):
    head = b""
    if known is not None:
        content = known.as_bytes() if plain else zstandard.ZstdCompressor().compress(known.as_bytes())
        head = warc.DICTIONARY.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content
    return head + b"".join(zstandard.ZstdCompressor(dict_data=known).compress(r) for r in records)


def test_dictionaries_plain_and_compressed_and_streamed_frames():
    records = [warc.record(f"urn:page:{i}:x", "u", "2020-01-01T00:00:00Z", f"page {i} ".encode() * (i + 1)) for i in range(60)]
    known = zstandard.train_dictionary(2048, records * 10, k=64, d=8)
    for plain in (True, False):
        assert [f["payload_bytes"] for _, f, _ in warc.decode(archive(records, known, plain))] == [len(f"page {i} ") * (i + 1) for i in range(60)]
    stream = zstandard.ZstdCompressor().compressobj()
    unsized = stream.compress(records[9] * 1) + stream.flush()
    assert [f["record_id"] for _, f, _ in warc.decode(archive(records[:2]) + unsized)] == ["urn:page:0:x", "urn:page:1:x", "urn:page:9:x"]


def test_damaged_records_are_told(spark, tmp_path):
    good = warc.record("urn:page:1:x", "u", "2020-01-01T00:00:00Z", b"payload")
    bad = {
        "version": good.replace(b"WARC/1.1", b"WARC/9.9"),
        "the block has": good + b"more", "digest": good.replace(b"payload\r\n", b"Payload\r\n"), "warc-date": good.replace(b"WARC-Date", b"WARC-Dat"),
        "HTTP header tells": good.replace(b"Content-Length: 7", b"Content-Length: 6"),
    }
    bad["content-length"] = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\n\r\nHTTP", good)
    for problem, data in bad.items():
        (_, fields, told), (_, after, fine) = list(warc.decode(archive([data, good])))
        assert fields is None and problem in told and after["payload"] == b"payload" and fine is None
    whole = archive([good, good, good])
    for cut in range(1, len(whole), 7):
        found = list(warc.decode(whole[:cut]))
        assert len([1 for _, f, _ in found if f]) <= cut * 3 // len(whole) and all(f or p for _, f, p in found)
    assert [p for _, _, p in warc.decode(archive([good]) + b"junk")][1].startswith("no frame")
    assert "bytes" in list(warc.decode(archive([good]), most_bytes=10))[0][2]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.zst").write_bytes(archive([good, bad["digest"], good]))
    got = warc.read_archives(spark, str(tmp_path / "a"), report=True).orderBy("offset").collect()
    assert [r.record_type for r in got] == ["response", None, "response"] and "digest" in got[1].problem
    with pytest.raises(Exception, match="digest differs"):
        warc.read_archives(spark, str(tmp_path / "a")).collect()


def test_empty_table_of_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


# --------------------------------------------------------------- importance


def brute_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute_resample(rows, target, percent=25, least=20):
    found = [(r[0], *brute_features(r[1])) for r in rows]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, _, f in found:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, brute_features(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 10000) / ((a + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for doc_id, words, f in found:
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


TARGET = ["The river house, the stone house.", None, "", "walk slowly 123 中文 house"]


@pytest.mark.parametrize("clashes", [False, True])
def test_resample(spark, clashes):
    rows = documents(200) + [(5000 + k, t, None, None, 0) for k, t in enumerate(["x" * 300 + " " + "é" * 500, "A1 b2\x00c3", "é" * 60])]
    rows += [(None, "the stone house " * 30, None, None, 0)] + [(9, "walk in the garden " * 9, None, None, 0)] * 3
    docs = frame(spark, rows, clashes)
    if clashes:
        docs = docs.withColumn("row", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("weight", F.lit(None))
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, score int")
    got = [tuple(r) for r in importance.resample(docs, target).collect()]
    want = brute_resample(rows, TARGET)
    assert sorted(r[:4] for r in got if r[0] is not None) == sorted(r[:4] for r in want if r[0] is not None)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rows_that_repeat_everything_are_drawn_one_by_one(spark):
    rows = [(None, "the same words again " * 10, None, None, 0)] * 150 + documents(60)
    docs = frame(spark, rows)
    got = importance.resample(docs, docs.limit(0).select("text"), percent=90).collect()
    want = brute_resample(rows, [], percent=90)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(1 for r in want if r[4]) + 1))


def test_empty_tables(spark):
    docs = frame(spark, documents())
    assert importance.resample(docs.limit(0), docs.select("text")).count() == 0
    short = importance.resample(docs.where("length(text) < 20"), docs.limit(0).select("text"))
    assert short.count() > 0 and short.where("rank IS NOT NULL").count() == 0


def test_features_do_not_depend_on_blocks():
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "B", "7", "é", "中", " ", "-", "\n"]) for _ in range(rng.randint(0, 200))) for _ in range(30)] + [None, "", "end"]
    whole = pa.concat_arrays([pa.array(["cut off"]), pa.array(texts)])[1:]
    for size in (1, 5, 64, 1 << 20):
        found, words = {}, {}
        for rows, buckets, mine in importance.Features(block_bytes=size).of(whole):
            for r, b in zip(rows.tolist(), buckets.tolist()):
                found.setdefault(r, []).append(b)
            for r in mine.tolist():
                words[r] = words.get(r, 0) + 1
        for r, text in enumerate(texts):
            w, f = brute_features(text)
            assert sorted(found.get(r, [])) == sorted(f) and words.get(r, 0) == len(w)


@pytest.mark.parametrize("sizes", [[], [0], [1], [3, 0, 5, 1], [2] * 9])
def test_tournament_tree(sizes):
    rng = random.Random(2)
    runs = [sorted((rng.randint(0, 5), k, n) for n in range(size)) for k, size in enumerate(sizes)]
    assert [runs[r][p] for r, p in importance.TournamentTree(runs)] == sorted(x for run in runs for x in run)


def test_many_short_runs_and_ranges(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice([None, n % 50]), 1, 2, rng.choice([7, 7, 7, rng.randint(-50, 50)])) for n in range(3000)]
    df = spark.createDataFrame(rows, "row long, doc_id long, n_features long, weight long, score long").repartition(13)
    order = sorted(rows, key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[0]))
    got = importance.ranked(df, 1777, 3000, run_rows=200, block_rows=16, range_rows=100).orderBy("rank").collect()
    assert [(r["row"], r["rank"]) for r in got] == [(r[0], k + 1) for k, r in enumerate(order[:1777])]
    ranges = importance.ranked(df, 3000, 3000, run_rows=200, block_rows=16, range_rows=100).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in ranges) == 3000
