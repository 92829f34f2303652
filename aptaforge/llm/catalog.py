"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aptaforge.llm import exact_dedup, language, mixing, packing, pseudonyms, quality, revisits, sharding, simhash, token_counts
from aptaforge.llm.common import table

#: The key of the registered query; real ones belong in a secret store.
DEMO_KEY = "demonstration"
DAY = 86_400


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def crawl_records(pages: DataFrame) -> DataFrame:
    """A capture and a later not-modified record of each page, in eight kinds of validator agreement by page_id."""
    etag, digest = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.md5(F.concat(F.lit("sha:"), "html"))
    modified = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    kind, pid = F.col("page_id") % 8, F.col("page_id")
    empty = F.lit(None).cast("string")
    # ref reads the url the second crawl saw: another scheme, prefix or fragment of the same page
    again = F.concat(F.regexp_replace("url", "^https?://", "https://"), F.lit("#again"))
    capture = pages.select(
        (2 * pid).alias("record_id"), "page_id", "url", (pid * DAY).alias("warc_date"), F.lit("response").alias("record_type"), F.lit(200).alias("status"),
        etag.alias("etag"), modified.alias("last_modified"), digest.alias("payload_digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("etag"), etag, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    revisit = pages.select(
        (2 * pid + 1).alias("record_id"), "page_id", again.alias("url"),
        F.when(kind == 7, pid * DAY - 1).otherwise(pid * DAY + DAY // 2).alias("warc_date"), F.lit("revisit").alias("record_type"), F.lit(304).alias("status"),
        F.when(kind == 0, etag).when(kind == 1, F.concat(F.lit("W/"), etag)).when(kind == 2, F.lit('"other"')).otherwise(empty).alias("etag"),
        F.when(kind == 3, modified).when(kind == 4, F.lit("another day")).otherwise(empty).alias("last_modified"),
        F.when(kind == 5, digest).otherwise(empty).alias("payload_digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=90"), F.lit("date"), pid.cast("string")).alias("headers"),
    )
    return capture.unionByName(revisit)


def op2_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("merged_headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.select("record_id", "page_id", "canonical_url", "verdict", "resolved_id", "resolved_digest", F.array_join(lines, "\n").alias("merged_headers"))


_CANONICAL = r"""
  regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^(www|m)\.', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN q <> '' THEN '?' || array_to_string(list_sort(string_split(q, '&')), '&') ELSE '' END
"""

OP2_SQL = rf"""
WITH c AS (
  SELECT 2 * page_id AS record_id, page_id, url, page_id * {DAY} AS warc_date, 'response' AS record_type,
         '"' || md5(html) || '"' AS etag, 'day ' || page_id AS last_modified, md5('sha:' || html) AS payload_digest, strlen(html) AS n
  FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, page_id, regexp_replace(url, '^https?://', 'https://') || '#again',
         CASE WHEN page_id % 8 = 7 THEN page_id * {DAY} - 1 ELSE page_id * {DAY} + {DAY // 2} END, 'revisit',
         CASE page_id % 8 WHEN 0 THEN '"' || md5(html) || '"' WHEN 1 THEN 'W/"' || md5(html) || '"' WHEN 2 THEN '"other"' END,
         CASE page_id % 8 WHEN 3 THEN 'day ' || page_id WHEN 4 THEN 'another day' END,
         CASE page_id % 8 WHEN 5 THEN md5('sha:' || html) END, 0
  FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(bare, '\?(.*)$', 1), '(^|&)(utm_[^&=]*|fbclid|gclid|ref)=[^&]*', '', 'g'), '^&', '') AS q FROM b),
u AS (SELECT * EXCLUDE (bare, q), {_CANONICAL} AS canonical_url FROM q),
w AS (SELECT *, last_value(CASE WHEN record_type = 'response' THEN record_id END IGNORE NULLS) OVER (
        PARTITION BY canonical_url ORDER BY warc_date, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rid FROM u),
j AS (SELECT w.*, r.record_id AS r_id, r.payload_digest AS r_digest, r.etag AS r_etag, r.n AS r_n,
        coalesce(regexp_replace(w.etag, '^W/', '') = regexp_replace(r.etag, '^W/', ''), w.last_modified = r.last_modified, w.payload_digest = r.payload_digest) AS ok
      FROM w LEFT JOIN u r ON r.record_id = w.rid),
v AS (SELECT *, CASE WHEN record_type = 'response' THEN 'full' WHEN r_id IS NULL THEN 'missing' WHEN ok IS NULL THEN 'unverified'
        WHEN ok THEN 'match' ELSE 'mismatch' END AS verdict FROM j)
SELECT record_id, page_id, canonical_url, verdict,
  CASE WHEN verdict = 'full' THEN record_id WHEN verdict IN ('match', 'unverified') THEN r_id END AS resolved_id,
  CASE WHEN verdict = 'full' THEN payload_digest WHEN verdict IN ('match', 'unverified') THEN r_digest END AS resolved_digest,
  CASE WHEN verdict = 'full' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || etag
       WHEN verdict IN ('match', 'unverified') THEN 'cache-control: max-age=90' || chr(10) || 'content-length: ' || r_n || chr(10) || 'content-type: text/html'
            || chr(10) || 'date: ' || page_id || chr(10) || 'etag: ' || r_etag END AS merged_headers
FROM v
"""


def op3_pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
    changed = F.filter("pii", lambda p: p["token"] != p["pseudonym"])
    return out.select("doc_id", "text", F.size("pii").alias("n_found"), F.size(changed).alias("n_replaced"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc.doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op10_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1') AS key FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS alls FROM src),
l AS (SELECT *, cap / weight AS ratio, row_number() OVER o AS pos,
             (1.5::DOUBLE * alls - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, rank)),
f AS (SELECT min(pos) AS first_pos, arg_min(level, pos) AS first_level FROM l WHERE ratio > level),
t AS (SELECT source, source_size, CAST(CASE WHEN pos >= first_pos THEN weight * first_level ELSE cap END AS DOUBLE) AS target FROM l, f),
p AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM p
"""

OP4_SQL = r"""
WITH m AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM m)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
b AS (SELECT m.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, word_chars, n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM m LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n,
        sum(CASE WHEN base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 5 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
            THEN 1 ELSE 0 END) AS f FROM f GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(f * f / n) AS f2 FROM h),
a AS (SELECT *, least(greatest(f / n, 0.5 / n), 1 - 0.5 / n) AS m FROM s),
c AS (SELECT m, least(greatest(m * (1 - m) / greatest(f2 / n - (f / n) * (f / n) - m * (1 - m) * k / n, 1e-6) - 1, 1.0), 1000.0) AS strength FROM a),
v AS (SELECT source, (h.f + m * strength) / (h.n + strength) > 0.5 AS rejected FROM h, c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""



def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: a byte's table value is the exclusive or of its bits' values, each eight shifts of the reflected polynomial."""
    step = "a >> 8"
    for bit in range(8):
        value = 1 << bit
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        step = f"xor({step}, (xor(a, b) >> {bit} & 1) * {value})"
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda y: CAST('0x' || y AS BIGINT))"
    return f"xor(list_reduce({bytes_}, lambda a, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP7_SQL = f"""
WITH s AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER () AS total FROM s),
n AS (SELECT *, CAST(least((2 * start + size) * 40 // (2 * total), 39) AS INT) AS shard FROM p)
SELECT doc_id, size, {crc32_sql('t')} AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_resolve_revisits, op3_pseudonymise, op4_quality_rules, op5_exact_dedup, op6_pack_sequences,
        op7_balanced_shards, op8_count_tokens, op9_simhash_groups, op10_identify_language, pipeline,
    )
}

ORACLE_SQL = {"op1_mix_sources": OP1_SQL, "op2_resolve_revisits": OP2_SQL, "op4_quality_rules": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op7_balanced_shards": OP7_SQL}
