"""Not-modified revisits: each joined to the latest earlier full response of its URL.

Captures are compared by canonical URL.  Time is cut into ranges; inside a range and
URL a window finds the latest earlier response, and what earlier ranges hold is
carried over from one row for each range and URL.  So a URL that owns a third of all
captures is spread over the ranges.  The response's headers travel with its id; no
payload is moved.

A revisit is resolved when a validator agrees: entity tags by weak comparison, else
modification dates.  Its permitted headers then replace the response's.

Defined cases: a null URL never resolves; a response without time is earlier than no
other capture, and no response is earlier than a revisit without time; captures at the same time are not earlier
than one another; of responses at one time the largest id counts; repeated captures
resolve alike; responses of another status than 200 are not full; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

#: Headers that a not-modified answer may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not tell pages apart.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="
#: Ranges of time.
RANGES = 128


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, ``www.`` or ``m.``, user and default port; no fragment,
    no tracking parameters, parameters sorted, no trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), "^(www|m)\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(captures: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``record_id, url, response_id, outcome, headers`` of each revisit.

    ``captures`` holds ``record_id, ts, kind`` (``response`` or ``revisit``), ``url``,
    ``status`` and ``headers`` (a map of lower-case names).
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = cut(
        captures.filter(full | (F.col("kind") == "revisit")).select(
            F.col("record_id").cast("long"), F.col("ts").cast("long"), canonical_url(F.col("url")).alias("url"), full.alias("_full"), "headers"
        )
    )
    cuts = rows.agg(F.percentile_approx("ts", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    slot = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts)))), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    kept = F.struct("ts", F.col("record_id").alias("id"), F.to_json("headers").alias("headers"))
    placed = rows.withColumn("_slot", slot.cast("int")).withColumn("_own", F.when(F.col("_full") & F.col("ts").isNotNull(), kept))
    ends = placed.filter("_full AND url IS NOT NULL").groupBy("url", "_slot").agg(F.max("_own").alias("_end"))
    asked = placed.filter("NOT _full").select("url", "_slot").distinct()
    marks = ends.join(asked, ["url", "_slot"], "full")
    carried = marks.withColumn("_before", F.max("_end").over(W.partitionBy("url").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1))).filter("_before IS NOT NULL").select("url", "_slot", "_before")
    inside = F.max("_own").over(W.partitionBy("url", "_slot").orderBy("ts").rangeBetween(W.unboundedPreceding, -1))
    found = placed.filter("url IS NOT NULL").withColumn("_here", inside).filter("NOT _full").join(carried, ["url", "_slot"], "left")
    found = found.withColumn("_r", F.coalesce("_here", "_before")).unionByName(placed.filter("NOT _full AND url IS NULL"), allowMissingColumns=True)
    stored, new = F.from_json("_r.headers", "map<string,string>"), F.col("headers")
    found = found.withColumn("_stored", stored)
    by_tag = F.col("_stored")["etag"].isNotNull() & new["etag"].isNotNull()
    by_date = F.col("_stored")["last-modified"].isNotNull() & new["last-modified"].isNotNull()
    outcome = (
        F.when(F.col("_r").isNull(), "no earlier response")
        .when(by_tag, F.when(_tag(F.col("_stored")) == _tag(new), "resolved").otherwise("validator differs"))
        .when(by_date, F.when(F.col("_stored")["last-modified"] == new["last-modified"], "resolved").otherwise("validator differs"))
        .otherwise("no validator")
    )
    renewed = F.map_filter(new, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("_stored", lambda k, _: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    out = found.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return out.select("record_id", "url", F.when(done, F.col("_r.id")).alias("response_id"), "outcome", F.when(done, lines).alias("headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures from the pages table: each page as a full response, and a revisit of it.

    The revisit asks with the page's own tag (weak for every third page, another for
    every seventh, none for every eleventh), shortly before or after the page's turn.
    """
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    response = F.struct(
        (page * 2).alias("record_id"), (page * 10).alias("ts"), F.lit("response").alias("kind"), F.col("url"), F.when(page % 17 == 0, 404).otherwise(200).alias("status"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), text(F.octet_length(html)), F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag).alias("headers"),
    )
    asked = F.when(page % 11 == 0, F.lit(None).cast("string")).when(page % 7 == 0, F.lit('"0"')).when(page % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = F.struct(
        (page * 2 + 1).alias("record_id"), (page * 10 + (page % 5 - 1) * 10 + 5).alias("ts"), F.lit("revisit").alias("kind"), F.col("url"), F.lit(304).alias("status"),
        F.map_filter(F.create_map(F.lit("cache-control"), text("max-age=", page % 100), F.lit("content-length"), F.lit("0"), F.lit("etag"), asked, F.lit("x-cache"), text("r", page % 7)), lambda _, v: v.isNotNull()).alias("headers"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("c")).select("c.*")
