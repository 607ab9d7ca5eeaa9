"""WARC not-modified revisits: the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ordered import last_where, running

# Headers that a not-modified answer may renew.
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment and empty path."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substr(bare, F.length(head) + 1)
    head = F.regexp_replace(F.regexp_replace(head, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    return F.concat(head, F.when(rest == "", "/").otherwise(rest))


def resolve_revisits(records: DataFrame, rows_per_piece: int | None = None) -> DataFrame:
    """One row a revisit: record_id, url, response_id, status, headers.

    `records`: record_id, url, ts, kind (response or revisit), etag, last_modified, headers (map, lower-case
    names). One pass in time order for each canonical URL, also when one URL has very many records (pieces of
    `rows_per_piece`). At one time responses come first, then smaller ids. Status is `no_response`; `changed` if both sides have an
    etag that differs, or without that a last_modified that differs; else `resolved`, and then the response's
    headers with the permitted ones of the revisit. A null url or time resolves to nothing, other kinds and null
    are neither side, null headers are none. Repeated
    rows come out each; an empty table gives none; further columns are not looked at.
    """
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("url"), "ts", "etag", "last_modified", "headers",
        F.when(F.col("kind") == "response", 0).when(F.col("kind") == "revisit", 1).alias("again"),
    ).where("again IS NOT NULL")
    full = F.struct("record_id", "etag", "last_modified", "headers")
    known = (F.col("again") == 0) & F.col("url").isNotNull() & F.col("ts").isNotNull()
    found = running(rows, ["url"], ["ts", "again", "record_id"], rows_per_piece=rows_per_piece, before=last_where(full, known)).where("again = 1")
    found = found.withColumn("before", F.when(F.col("url").isNotNull() & F.col("ts").isNotNull(), F.col("before")))
    same_tag = F.col("etag") == F.col("before.etag")
    same = F.coalesce(same_tag, F.col("last_modified") == F.col("before.last_modified"), F.lit(True))
    status = F.when(F.col("before").isNull(), "no_response").when(~same, "changed").otherwise("resolved")
    empty = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce("headers", empty), lambda k, v: k.isin(*RENEWED))
    old = F.map_filter(F.coalesce("before.headers", empty), lambda k, v: ~F.map_contains_key(new, k))
    return found.select(
        "record_id", "url", F.when(status == "resolved", F.col("before.record_id")).alias("response_id"),
        status.alias("status"), F.when(status == "resolved", F.map_concat(old, new)).alias("headers"),
    )
