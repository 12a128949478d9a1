"""URL filter: a blocked Bloom filter of all listed keys, then an exact hash join of what it lets pass.

Two kinds of entry are listed.  A canonical URL blocks every address with that canonical form.
A rule (host, path, action) fits its host and all subdomains where the path starts with the
rule's; the longest rule (host and path together; of two as long, the longer host) decides, also
against a listed URL.  What neither decides is allowed.

An address has one key for its canonical form and one for each (ending of the host, beginning
of the path) whose label count and length some rule has.  The filter is an array of blocks of
eight 64-bit words; a key sets one bit in each word of one block.  It takes 16 bits a key up to
FILTER_BYTES, which is also all that is broadcast: beyond about 8 million entries it lets more
pass, and the join still decides.  Possible hits are judged once for each address and joined
back, so a hot address is one row there, and its pages are split by adaptive execution.

A null url or one without "://" has an empty host and path; a listed null or URL without host is
no entry.  Repeated pages are judged each, repeated entries count once (of two actions for one
rule, block); an empty list or rule table decides nothing.  Only `page_id` and `url` are read;
other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import stored, table

FILTER_BYTES, BLOCK_WORDS, BITS_A_KEY = 16 << 20, 8, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name no content.
TRACKING = "^(utm_|ref=|fbclid=|gclid=|mc_eid=)"
#: The rules of the query (host, path, action).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words of a host name whose pages the query lists.
HOST_WORDS = "(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "^[\\s\\S]*?://", "")).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without user, www., closing point and usual port; path without closing slashes; parameters sorted, without tracking."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), "^[^/?#]*@", ""), ":(80|443)$", ""), "^www\\.|\\.$", "")
    query = F.split(F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1), "&")
    query = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when(host == "", "").otherwise(F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), tail))


def _entries(listed: DataFrame, rules: DataFrame) -> DataFrame:
    """key, rule, action, rank: one row a key."""
    urls = listed.select(canonical(F.col("url")).alias("c")).where("c <> ''").distinct()
    urls = urls.select(F.concat(F.lit("u "), "c").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("action"), F.lit(None).cast("struct<a:int,b:int>").alias("rank"))
    keyed = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action")
    keyed = keyed.groupBy("host", "path").agg(F.max("action").alias("action")).withColumn("rule", F.concat("host", "path"))
    rank = F.struct(F.length("rule").alias("a"), F.length("host").alias("b"))
    return urls.unionByName(keyed.select(F.concat(F.lit("r "), "rule").alias("key"), "rule", "action", rank.alias("rank")))


def build_filter(keys: DataFrame, most_bytes: int = FILTER_BYTES) -> np.ndarray:
    """blocks x 8 words; only blocks come to the driver, most_bytes of them at most."""
    n = keys.count()
    blocks = max(1, min(most_bytes // (8 * BLOCK_WORDS), -(-n * BITS_A_KEY // (64 * BLOCK_WORDS))))
    # Each word takes its bit from six bits of the second hash.
    bits = [F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(second, {6 * w}) & 63 AS INT))") for w in range(BLOCK_WORDS)]
    rows = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.xxhash64(F.lit(1), "key").alias("second"))
    rows = rows.groupBy("block").agg(*[F.bit_or(b).alias(f"w{w}") for w, b in enumerate(bits)])
    words = np.zeros((blocks, BLOCK_WORDS), np.int64)
    for r in rows.toLocalIterator():
        words[r["block"]] = r[1:]
    return words.view(np.uint64)


def may_hold(words: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether all eight bits of each key are set."""
    block = words[np.mod(first, len(words))]
    at = (second.view(np.uint64)[:, None] >> np.arange(0, 6 * BLOCK_WORDS, 6, dtype=np.uint64)) & np.uint64(63)
    return ((block >> at) & np.uint64(1)).all(axis=1)


def _possible(words_bc):
    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        hit = may_hold(words_bc.value, *(c.flatten().to_numpy(zero_copy_only=False) for c in (first, second)))
        size = np.concatenate([[0], np.cumsum(first.value_lengths().to_numpy(zero_copy_only=False))])
        where = np.flatnonzero(hit)
        ends = np.searchsorted(where, size)
        row = np.searchsorted(size, where, "right") - 1
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((where - size[row]).astype(np.int32)))

    return F.arrow_udf(run, "array<int>")


def _distinct_numbers(rules: DataFrame, value: Column) -> str:
    """The values as an SQL array: lists of all different lengths are as long as the root of what they hold."""
    found = sorted(r[0] for r in rules.select(value.cast("int")).where(value.isNotNull()).distinct().collect())
    return f"CAST(array({', '.join(map(str, found))}) AS ARRAY<INT>)"


def filter_urls(pages: DataFrame, listed: DataFrame, rules: DataFrame, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """page_id, url, host, path, rule, listed, verdict of each page.

    listed has `url`; rules have `host`, `path` and `action` (allow or block)."""
    spark = pages.sparkSession
    entries = stored(_entries(listed, rules), "url-entries")
    words = spark.sparkContext.broadcast(build_filter(entries, most_bytes))
    labels, lengths = (_distinct_numbers(rules, v) for v in (F.size(F.split("host", "\\.")), F.length("path")))
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    endings = f"transform(filter({labels}, c -> c <= size(split(host, '\\\\.'))), c -> substring_index(host, '.', -c))"
    starts = f"transform(filter({lengths}, c -> c <= length(path)), c -> substring(path, 1, c))"
    keys = F.expr(f"concat(array(concat('u ', canonical)), flatten(transform({endings}, h -> transform({starts}, p -> concat('r ', h, p)))))")
    rows = rows.withColumn("keys", keys).withColumn("hit", _possible(words)(F.expr("transform(keys, k -> xxhash64(k))"), F.expr("transform(keys, k -> xxhash64(1, k))")))
    rows = stored(rows.withColumn("keys", F.expr("transform(hit, k -> keys[k])")).drop("hit"), "url-possible")
    address = ["host", "path", "canonical"]
    possible = rows.where("size(keys) > 0")
    tried = possible.dropDuplicates(address).select(*address, F.explode("keys").alias("key"))
    found = tried.join(entries, "key").groupBy(*address).agg(F.max_by("rule", "rank").alias("rule"), F.max_by("action", "rank").alias("action"), F.bool_or(F.col("rank").isNull()).alias("listed"))
    hits = possible.join(found, address, "left").select("page_id", "url", "host", "path", "rule", "action", F.coalesce("listed", F.lit(False)).alias("listed"))
    clear = rows.where("size(keys) = 0").select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"), F.lit(False).alias("listed"))
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow"))
    return hits.unionByName(clear).select("page_id", "url", "host", "path", "rule", "listed", verdict.alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is what the table itself holds of hosts named after unwanted matter: it grows with the pages."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(host_of(F.col("url")).rlike(HOST_WORDS)).select("url")
    return filter_urls(pages, listed, spark.createDataFrame(RULES, "host string, path string, action string")).drop("url", "listed")


OP13_SQL = r"""
WITH r(host, path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^/?#]*@', ''), ':(80|443)$', ''), '^www\.|\.$', '', 'g') AS name,
 list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|ref=|fbclid=|gclid=|mc_eid=)'))) AS args FROM p),
c AS (SELECT *, name || regexp_replace(path, '/+$', '') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical FROM q),
l AS (SELECT DISTINCT canonical FROM c WHERE name <> '' AND regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)')),
f AS (SELECT c.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.action, length(r.host || r.path)) AS action
 FROM c JOIN r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY c.page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN name <> '' AND canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f USING (page_id)
"""
