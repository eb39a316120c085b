"""The operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from weft.llm import (
    embed_dedup,
    exact_dedup,
    fill_middle,
    importance,
    langid,
    license_scan,
    mixing,
    packing,
    secret_scan,
    sharding,
    simhash_dedup,
    token_store,
    warc,
)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return langid.identify_documents(_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op5_token_store(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_store.store_documents(_table(spark, sf_dir, "documents"), str(path), end_id=1)


def op6_packing(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), str(path), end_id=0)


def op7_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark, sf_dir):
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_warc(spark, sf_dir):
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op13_fill_middle(spark, sf_dir):
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, four bits at a time, the lower half of a byte first."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    digits = f"string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), '')"
    values = f"list_transform({digits}, lambda c: CAST(instr('123456789ABCDEF', c) AS BIGINT))"
    step = f"xor(acc >> 4, {table}[(xor(acc, x) & 15) + 1])"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, {values}), lambda acc, x: {step}), 4294967295) END"


def _shard_sql(shards: int) -> str:
    """The shard with the largest score 1 / -ln(u) of a key's MD5, the smaller on a tie."""
    u = "(CAST('0x' || substr(md5('=' || doc_id || '#' || n), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
    return f"(SELECT arg_max(CAST(n AS INTEGER), (1.0 / -ln({u}), -n)) FROM range({shards}) r(n))"


OP9_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, CAST({_crc32_sql("text")} AS BIGINT) AS text_crc32 FROM t),
p AS (SELECT *, {_shard_sql(8)} AS shard, {_shard_sql(9)} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5('=' || doc_id || '|=' || text_crc32 || '|=' || size)) - 1 AS slot, grown_shard
FROM p
"""

OP11_SQL = rf"""
WITH texts AS (
  SELECT true AS own, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), item_id, text FROM benchmark
), w AS (
  SELECT own, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), f AS (
  SELECT own, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w
), per AS (SELECT own, r, f, count(*) AS n FROM f GROUP BY own, r, f),
names AS (SELECT f, CAST({_crc32_sql("f")} AS BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT f FROM per)),
used AS (SELECT own, r, bucket, sum(n) AS n FROM per JOIN names USING (f) GROUP BY own, r, bucket),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM used GROUP BY bucket),
sums AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((CAST(c.t AS DOUBLE) + 1) * (CAST(sums.s AS DOUBLE) + 10000) / ((CAST(c.s AS DOUBLE) + 1) * (CAST(sums.t AS DOUBLE) + 10000)))) AS gain FROM counts c, sums
), weights AS (SELECT r, sum(n) AS n, floor(sum(n * gain) / sum(n)) AS weight FROM used JOIN gains USING (bucket) WHERE own GROUP BY r),
scores AS (
  SELECT w.r, doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weights ON weights.r = w.r WHERE own
), ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM scores WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= 25 * total // 100 THEN rank END AS BIGINT) AS rank FROM scores LEFT JOIN ranks USING (r)
"""


def _base32_sql(digest: str) -> str:
    """Base32 of a hex digest of 40 digits: four characters for every five digits."""
    five = f"CAST('0x' || substr({digest}, 5 * k + 1, 5) AS BIGINT)"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({five} >> {shift} & 31 AS INTEGER) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda k: {letters}), '')"


OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_base32_sql("sha1(html)")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM k
"""


def _hash_number(k: int) -> str:
    return f"CAST('0x' || substr(sha256('7:' || doc_id), {8 * k + 1}, 8) AS BIGINT)"


OP13_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines FROM t),
c AS (
  SELECT *, len(lines) AS n, {_hash_number(0)} % (len(lines) + 1) AS x, {_hash_number(1)} % (len(lines) + 1) AS y,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_hash_number(2)} % 100 >= 100 AS plain,
         CASE WHEN {_hash_number(3)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS moved FROM u
), d AS (
  SELECT *, array_to_string(lines[1:least(x, y)], '') AS p, array_to_string(lines[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(lines[greatest(x, y) + 1:], '') AS s FROM c
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' ELSE moved END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN moved = 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM d
"""


def queries():
    return {
        "op1_language_id": op1_language_id,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_mixing": op4_mixing,
        "op5_token_store": op5_token_store,
        "op6_packing": op6_packing,
        "op7_license_scan": op7_license_scan,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_sharding": op9_sharding,
        "op10_secret_scan": op10_secret_scan,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_warc": op12_warc,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql():
    return {
        "op8_exact_dedup": OP8_SQL,
        "op9_sharding": OP9_SQL,
        "op11_importance_resampling": OP11_SQL,
        "op12_warc": OP12_SQL,
        "op13_fill_middle": OP13_SQL,
    }
