"""The queries ``opN_<name>``: each operator over its whole table, as digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontaminate, line_dedup, media_png, near_dedup, packing, secrets, sharding, staging, suffix_dedup, toxicity, warc_revisit


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the contract's columns, ``n_passages`` tells of repeated passages of 250 bytes, which hold over 50 short words."""
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=400, with_kept=False, report=250)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256", "n_passages")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.histogram_shards(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), most=1024)
    return packing.pack(pieces, tokens=1024)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.split_item(_table(spark, sf_dir, "benchmark"))
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), items)


#: Seconds of the first capture.
_WARC_BEGIN = 1_700_000_000


def op5_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a full response, and a revisit some captures later.

    A fifth of the revisits bring another entity tag, a seventh only the date.
    """
    pages = _table(spark, sf_dir, "pages")
    html, n, mark = F.coalesce("html", F.lit("")), F.col("page_id"), F.floor(F.pmod(F.col("page_id") * 2654435761, F.lit(1 << 32)) / 65536)
    begin = F.lit(_WARC_BEGIN) + n * 10
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    date = F.concat(F.lit("day "), F.floor(n / 100).cast("string"))
    response = warc_revisit.write_record(
        F.lit("response"), F.concat(F.lit("page:"), n), F.col("url"), begin, "200 OK",
        [("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length(html).cast("string")), ("ETag", tag), ("Last-Modified", date), ("Cache-Control", F.lit("max-age=60"))],
        html,
    )
    revisit = warc_revisit.write_record(
        F.lit("revisit"), F.concat(F.lit("again:"), n), F.col("url"), begin + 5 + 1000 * (mark % 4), "304 Not Modified",
        [
            ("ETag", F.when(mark % 5 == 0, F.lit('"other"')).when(mark % 7 != 0, tag)), ("Last-Modified", date),
            ("Cache-Control", F.concat(F.lit("max-age="), n)), ("Content-Length", F.lit("0")), ("Content-Type", F.lit("text/plain")),
        ],
        F.lit(""),
    )
    records = warc_revisit.read_records(pages.select(F.explode(F.array(response, revisit)).alias("raw")))
    out = warc_revisit.resolve_revisits(staging.stage(records.drop("body"), "warc-records"))
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return out.select(
        number("record_id").alias("page_id"), "time", "resolution", number("response_id").alias("response_page_id"), "response_time",
        *(F.col("headers")[name].alias(name.replace("-", "_")) for name in ("content-type", "content-length", "etag", "last-modified", "cache-control")),
    )


OP5_SQL = rf"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, {_WARC_BEGIN} + page_id * 10 AS t,
         '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || (page_id // 100) AS modified,
         regexp_replace(regexp_replace(trim(url), '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
         (page_id * 2654435761 % 4294967296) // 65536 AS c
  FROM pages),
canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    array_to_string(list_sort([x FOR x IN string_split(regexp_extract(rest, '\?(.*)$', 1), '&')
      IF x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)')]), '&') AS q
  FROM p),
full_ AS (SELECT page_id, t, tag, modified, strlen(html) AS n, place || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS u FROM canon),
again AS (
  SELECT page_id, t + 5 + 1000 * (c % 4) AS t, CASE WHEN c % 5 = 0 THEN '"other"' WHEN c % 7 <> 0 THEN tag END AS tag, modified,
         place || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS u
  FROM canon),
j AS (SELECT a.*, f.page_id AS fp, f.t AS ft, f.tag AS ftag, f.modified AS fmod, f.n AS fn,
        CASE WHEN a.tag IS NOT NULL THEN a.tag = f.tag ELSE a.modified = f.modified END AS agreed
      FROM again a ASOF LEFT JOIN full_ f ON a.u = f.u AND a.t > f.t)
SELECT page_id, t AS time,
  CASE WHEN u IS NULL THEN 'no_url' WHEN fp IS NULL THEN 'no_earlier_response' WHEN agreed THEN 'resolved' ELSE 'validator_mismatch' END AS resolution,
  CASE WHEN agreed THEN fp END AS response_page_id, CASE WHEN agreed THEN ft END AS response_time,
  CASE WHEN agreed THEN 'text/html' ELSE 'text/plain' END AS content_type,
  CASE WHEN agreed THEN fn::VARCHAR ELSE '0' END AS content_length,
  CASE WHEN agreed THEN coalesce(tag, ftag) ELSE tag END AS etag,
  modified AS last_modified, 'max-age=' || page_id AS cache_control
FROM j
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
often AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (k IN (SELECT k FROM often))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM often)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    kinds = F.transform("spans", lambda x: x["kind"])
    count = [F.size(F.array_remove(kinds, k)) for k in range(4)]
    count = [(F.size(kinds) - n).cast("long").alias(f"n_{kind}") for n, kind in zip(count, secrets.KINDS, strict=True)]
    return out.select("doc_id", *count, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_near_copies(_table(spark, sf_dir, "documents"), percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op10_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_png.media_columns(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.lower(F.hex("hash")).alias("feature"),
    )


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc_revisit": op5_warc_revisit,
    "op6_line_dedup": op6_line_dedup,
    "op7_secrets": op7_secrets,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_media_png": op10_media_png,
}

ORACLE_SQL = {"op5_warc_revisit": OP5_SQL, "op6_line_dedup": OP6_SQL}
