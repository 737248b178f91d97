"""The registered queries of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_lexicon, host_suffix, ngram_join, packing, quality_rules, revisits, simhash_anchors, site_classifier, suffix_dedup, syncmers, turn_repair, url_filter, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_closed_syncmers")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query("op3_host_suffix_array")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffix.main_text(table(spark, sf_dir, "pages"))


_PERMITTED = ", ".join(f"'{x}'" for x in revisits.PERMITTED)
_CANONICAL = r"""
 SELECT *, regexp_replace(url, '#.*$', '', 's') AS bare,
  regexp_replace(lower(regexp_extract(bare, '^[^:/?#]+://[^/?#]*')), '^(http://.*):80$|^(https://.*):443$', '\1\2') AS site,
  regexp_replace(bare, '^[^:/?#]+://[^/?#]*', '') AS rest, regexp_extract(rest, '^[^?]*', 0, 's') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1, 's'), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS params,
  site || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url
 FROM records
"""
_REVISITS = f"""
WITH tagged AS (SELECT *, '"' || md5(coalesce(html, '')) || '"' AS one, '"' || md5(coalesce(html, '') || '2') || '"' AS two, page_id % 3 <> 0 AS changed,
 'day ' || (page_id // 100) AS day, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, 'example', 'EXAMPLE', 'g') ELSE url END || '#again' AS again FROM pages),
records AS (
 SELECT 'r' || page_id || 'a' AS record_id, 'response' AS kind, url, page_id * 10 AS ts, one AS etag, day AS modified, NULL AS date, one AS bare_tag FROM tagged
 UNION ALL SELECT 'r' || page_id || 'b', 'response', url, page_id * 10 + 5000, two, day || '+', NULL, two FROM tagged WHERE changed
 UNION ALL SELECT 'v' || page_id || 'a', 'revisit', again, page_id * 10 + 2505, one, NULL, CAST(page_id AS VARCHAR), one FROM tagged
 UNION ALL SELECT 'v' || page_id || 'b', 'revisit', again, page_id * 10 + 10005,
  CASE page_id % 4 WHEN 0 THEN CASE WHEN changed THEN two ELSE one END WHEN 1 THEN 'W/' || one END, CASE page_id % 4 WHEN 2 THEN day END, CAST(page_id AS VARCHAR),
  CASE page_id % 4 WHEN 0 THEN CASE WHEN changed THEN two ELSE one END WHEN 1 THEN one END FROM tagged
 UNION ALL SELECT 'v' || page_id || 'c', 'revisit', again, page_id * 10 - 7, NULL, NULL, CAST(page_id AS VARCHAR), NULL FROM tagged WHERE page_id % 5 = 0),
named AS ({_CANONICAL}),
hits AS (
 SELECT v.*, r.record_id AS response_id, r.ts AS response_ts, r.etag AS r_etag, r.modified AS r_modified,
  CASE WHEN r.record_id IS NULL THEN 'no_response' WHEN coalesce(v.bare_tag = r.bare_tag, v.modified = r.modified) THEN 'verified'
   WHEN coalesce(v.bare_tag = r.bare_tag, v.modified = r.modified) = false THEN 'mismatch' ELSE 'unverified' END AS outcome
 FROM (SELECT * FROM named WHERE kind = 'revisit') v ASOF LEFT JOIN (SELECT * FROM named WHERE kind = 'response') r
  ON v.canonical_url = r.canonical_url AND v.ts > r.ts)
SELECT record_id, canonical_url, response_id, response_ts, outcome,
 CASE WHEN outcome IN ('verified', 'unverified')
  THEN 'content-type=text/html; date=' || date || '; etag=' || coalesce(etag, r_etag) || '; last-modified=' || coalesce(modified, r_modified) || '; server=a'
  ELSE 'date=' || date || coalesce('; etag=' || etag, '') || coalesce('; last-modified=' || modified, '') || '; server=b' END AS headers
FROM hits
"""


@query("op4_revisit_resolution", _REVISITS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "canonical_url", "response_id", "response_ts", "outcome", F.array_join(entries, "; ").alias("headers"))


ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")
#: Names of domains that put a host on the list.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
_LISTED = r"(^|\.)(" + "|".join(LISTED_NAMES) + r")\."


def _fits(rule: str) -> str:
    domain, _, rest = rule.partition("/")
    return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{rest}')"


_URL_RULES = " ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in sorted([*ALLOW, *BLOCK], key=lambda r: (-len(r), r)))
_URLS = rf"""
WITH parsed AS (
 SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
ruled AS (SELECT *, CASE {_URL_RULES} END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({", ".join(f"'{r}'" for r in ALLOW)}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN regexp_matches(host, '{_LISTED}') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


@query("op8_bloom_cascade", _URLS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key")).distinct()
    return url_filter.judge(pages, "url", ALLOW, BLOCK, hosts.where(F.col("key").rlike(_LISTED)), keep=["page_id"])


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_bpe_lexicon")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.encode(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@query("op11_lanczos_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_simhash_anchors")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.near_copies(table(spark, sf_dir, "documents"))


@query("op13_turn_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))
