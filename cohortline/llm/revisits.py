"""Not-modified revisits of a crawl, resolved to the full responses that they stand for.

A revisit record says that a url answered 304. Its body is that of the latest earlier full response of the same canonical url, if the validators
agree; the 304 may renew some headers. The as-of join is a union of both kinds of record ordered by time. Time is cut into slices, so that a url
with a large share of all records is spread over many groups: within a slice the last response is found by a window, and one row for each
url and slice carries the last response of earlier slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Slices of the time between the first and the last record.
SLICES = 256
#: Headers that a 304 may renew (RFC 9110 15.4.5, RFC 9111 3.2), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, / for an empty path, query parameters sorted without utm_*."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    site = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^:/?#]+://[^/?#]*", 0)), "^(http://.*):80$|^(https://.*):443$", "$1$2")
    rest = F.regexp_replace(bare, "^[^:/?#]+://[^/?#]*", "")
    path = F.regexp_extract(rest, "(?s)^[^?]*", 0)
    query = F.regexp_extract(rest, "(?s)^[^?]*\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    return F.concat(site, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the first in order."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    sorted_ = F.array_sort(named)
    first = F.filter(sorted_, lambda e, i: (i == 0) | (F.get(sorted_, i - 1)["key"] != e["key"]))
    return F.map_from_entries(first)


def _etag(headers: Column) -> Column:
    """Weak comparison: without the mark of weakness."""
    return F.regexp_replace(headers["etag"], "^W/", "")


_RESPONSE = "struct<ts: bigint, record_id: string, headers: array<struct<key: string, value: string>>>"


def _slice(table: DataFrame) -> Column:
    """The time slice of a row; slices hold about equally many rows, wherever the times lie."""
    shares = [i / SLICES for i in range(1, SLICES)]
    borders = table.agg(F.percentile_approx("ts", shares, 10 * SLICES)).first()[0] or []
    edges = F.lit(sorted(set(borders))).cast("array<bigint>")
    return F.size(F.filter(edges, lambda b: b < F.col("ts")))


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit of `records` (record_id, kind: response or revisit, url, ts, headers map<string,string>).

    Returns record_id, canonical_url, ts, response_id, response_ts, outcome, headers. The response is the latest with the same canonical url
    and an earlier ts (equal ts: the larger record_id). outcome: `no_response`; `mismatch` if entity tags, or failing those modification
    dates, are there on both sides and differ; `verified` if they agree; `unverified` without a validator on both sides. headers are the response's with the permitted ones of
    the revisit in their place, unless mismatched or without response: then the revisit's own. Records without url, ts or kind are no candidates;
    such revisits come out as `no_response`. Repeated revisits are repeated in the result; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    table = records.select(
        F.col("record_id"), F.col("kind"), canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), _lowered(F.col("headers")).alias("headers")
    )
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    # Revisits that can have no response take no part in the search.
    lost = table.where((F.col("kind") == "revisit") & ~usable).withColumn("hit", F.lit(None).cast(_RESPONSE))
    table = table.where(F.col("kind").isin("revisit", "response") & usable)
    response = F.when(F.col("kind") == "response", F.struct(F.col("ts"), F.col("record_id"), F.map_entries("headers").alias("headers")).cast(_RESPONSE))
    table = table.withColumn("slice", _slice(table)).withColumn("response", response)
    in_slice = table.groupBy("canonical_url", "slice").agg(F.max("response").alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = in_slice.select("canonical_url", "slice", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    # Strictly earlier: of one ts, revisits come first.
    within = Window.partitionBy("canonical_url", "slice").orderBy("ts", F.col("kind") == "response", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = table.withColumn("found", F.last("response", ignorenulls=True).over(within)).where(F.col("kind") == "revisit")
    joined = found.join(carried, ["canonical_url", "slice"], "left").withColumn("hit", F.coalesce("found", "carried"))
    columns = ["record_id", "canonical_url", "ts", "headers", "hit"]
    joined = joined.select(*columns).unionByName(lost.select(*columns))
    stored = F.coalesce(F.map_from_entries("hit.headers"), F.create_map().cast("map<string,string>"))
    joined = joined.withColumn("stored", stored)
    same_tag, same_date = _etag(F.col("headers")) == _etag(F.col("stored")), F.col("headers")["last-modified"] == F.col("stored")["last-modified"]
    agrees = F.coalesce(same_tag, same_date)
    outcome = F.when(F.col("hit").isNull(), "no_response").when(agrees, "verified").when(~agrees, "mismatch").otherwise("unverified")
    renewed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(renewed, k)), renewed)
    return joined.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "ts",
        F.col("hit.record_id").alias("response_id"),
        F.col("hit.ts").alias("response_ts"),
        "outcome",
        F.when(F.col("outcome").isin("verified", "unverified"), merged).otherwise(F.col("headers")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records from a table of pages (page_id, url, html), with several captures of each.

    A page p is fetched at 10 p, and unless 3 divides p again at 10 p + 5,000 with another body. A response's entity tag is its body's hash. Revisits come
    between the fetches, with the first body's tag; after them, by p modulo 4 with the latest tag, the first one marked weak, the first date alone, or
    no validator; and if 5 divides p once before any fetch. Revisits write the url with a fragment, those of even p with another case of the host.
    """
    page, even = F.col("page_id"), F.pmod("page_id", F.lit(2)) == 0
    changed, turn = F.pmod("page_id", F.lit(3)) != 0, F.pmod("page_id", F.lit(4))
    body = F.coalesce("html", F.lit(""))
    first, second = [F.concat(F.lit('"'), F.md5(x), F.lit('"')) for x in (body, F.concat(body, F.lit("2")))]
    day = F.concat(F.lit("day "), F.floor(page / 100).cast("string"))
    later = F.concat(day, F.lit("+"))
    again = F.concat(F.when(even, F.regexp_replace("url", "example", "EXAMPLE")).otherwise(F.col("url")), F.lit("#again"))

    def named(letter: str, suffix: str) -> Column:
        return F.concat(F.lit(letter), page.cast("string"), F.lit(suffix)).alias("record_id")

    def response(suffix: str, at: int, tag: Column, modified: Column) -> Column:
        headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Server"), F.lit("a"))
        return F.struct(named("r", suffix), F.lit("response").alias("kind"), F.col("url").alias("url"), (page * 10 + at).alias("ts"), headers.alias("headers"))

    def revisit(suffix: str, at: int, tag: Column, modified: Column) -> Column:
        headers = F.create_map(F.lit("etag"), tag, F.lit("LAST-MODIFIED"), modified, F.lit("Server"), F.lit("b"), F.lit("Date"), page.cast("string"))
        sent = F.map_filter(headers, lambda _, v: v.isNotNull())
        return F.struct(named("v", suffix), F.lit("revisit").alias("kind"), again.alias("url"), (page * 10 + at).alias("ts"), sent.alias("headers"))

    none = F.lit(None).cast("string")
    sent = F.when(turn == 0, F.when(changed, second).otherwise(first)).when(turn == 1, F.concat(F.lit("W/"), first))
    records = F.array(
        response("a", 0, first, day), F.when(changed, response("b", 5_000, second, later)), revisit("a", 2_505, first, none),
        revisit("b", 10_005, sent, F.when(turn == 2, day)), F.when(F.pmod("page_id", F.lit(5)) == 0, revisit("c", -7, none, none)),
    )
    return pages.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")
