"""URL filters with dated lists: an as-of join of captures with validity intervals.

A list is a log of dated entries (list, pattern, verdict, action, since): ``add`` makes the pattern
active from that time on, ``remove`` ends it.  Per list and pattern the log becomes intervals that don't overlap;
several entries of one time count by the last of add, remove in that order, and a repeated add continues the
interval with its own verdict.  Patterns are read in lower case; they are a host suffix of whole labels ("example.com", "m.example.com") or a
host with the first path segment ("m.example.com/en").

A capture asks for each of its own patterns (one per label, and one with the path), so the join is
an equi-join on the pattern with the capture's time inside the interval: at most one hit per list
and pattern.  Captures are first reduced to their distinct (host, segment, time), since a hot host repeats
them.  Of several hits the longest pattern decides, then ``allow`` before ``block``, then the list's name.

Edge cases: a null or malformed URL has no patterns and is allowed; a null time matches nothing; entries
with a null pattern or time are ignored; captures that repeat are judged each; without entries all
captures are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._frames import packed

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    """The host in lower case, without the dots that may end a full name."""
    return F.lower(F.nullif(F.regexp_replace(F.regexp_extract(url, URL, 1), r"\.+$", ""), F.lit("")))


def segment_of(url: Column) -> Column:
    """The first path segment, '' if there is none."""
    return F.regexp_extract(F.regexp_extract(url, URL, 2), r"^/([^/]*)", 1)


def patterns_of(host: Column, segment: Column) -> Column:
    """The patterns that apply to a URL: host suffixes of two labels or more, the host with its segment."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(suffixes, F.array(F.concat_ws("/", host, segment)))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, verdict, since, until) from the log; until is null while an entry lasts."""
    e = entries.where("pattern is not null and since is not null").withColumn("pattern", F.lower("pattern"))
    # one entry per list, pattern and time: remove wins over add, block over allow
    key = F.struct(F.col("action"), F.col("verdict"))
    e = e.groupBy("list", "pattern", "since").agg(F.max(key).alias("e"))
    w = Window.partitionBy("list", "pattern").orderBy("since")
    e = e.withColumn("until", F.lead("since").over(w))
    return e.where("e.action = 'add'").select("list", "pattern", F.col("e.verdict").alias("verdict"), "since", "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched, ...) with host, blocked, list and pattern of the deciding entry."""
    row, unpacked = packed(captures, ("host", "blocked", "list", "pattern"))
    c = captures.select(row, host_of(captures["url"]).alias("host"), segment_of(captures["url"]).alias("segment"), captures["fetched"].alias("fetched"))
    asked = c.where("host is not null and fetched is not null").select("host", "segment", "fetched").distinct()
    asked = asked.withColumn("pattern", F.explode(patterns_of(F.col("host"), F.col("segment"))))
    hits = asked.join(intervals(entries), "pattern").where("fetched >= since and (until is null or fetched < until)")
    # least of (-length, allow before block, list): the deciding hit
    best = F.min(F.struct((-F.length("pattern")).alias("l"), "verdict", "list", "pattern")).alias("hit")
    found = hits.groupBy("host", "segment", "fetched").agg(best)
    j = c.join(found, ["host", "segment", "fetched"], "left")
    blocked = F.coalesce(F.col("hit.verdict") == "block", F.lit(False))
    return j.select(*unpacked(), "host", blocked.alias("blocked"), F.col("hit.list").alias("list"), F.col("hit.pattern").alias("pattern"))


def _digit(host: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(host.cast("binary")), at, 2), 16, 10).cast("int")


def sample_entries(hosts: DataFrame) -> DataFrame:
    """Dated lists for the hosts (host) at hand: the tables bring none, so a hash of the name makes them."""
    day = lambda at: (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(_digit(F.col("host"), at))).alias("since")
    row = lambda name, pattern, verdict, action, since: (F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), since)
    h, domain = F.col("host"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    parts = [
        hosts.where(_digit(h, 1) < 100).select(*row("spam", h, "block", "add", day(3))),
        hosts.where(_digit(h, 1) < 60).select(*row("spam", h, "block", "remove", day(5))),
        hosts.where(_digit(h, 1) < 30).select(*row("spam", h, "block", "add", day(7))),
        hosts.where(_digit(h, 9) < 25).select(*row("adult", domain, "block", "add", day(11))),
        hosts.where(_digit(h, 13) < 90).select(*row("trusted", F.concat(h, F.lit("/en")), "allow", "add", day(15))),
        hosts.where(_digit(h, 13) < 40).select(*row("trusted", F.concat(h, F.lit("/en")), "allow", "remove", day(17))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op6(pages: DataFrame) -> DataFrame:
    """Every page as a capture whose fetch hour follows from its id, against lists for the pages' hosts."""
    hour = F.pmod(F.col("page_id") * 7919, F.lit(366 * 24)).cast("int")
    captures = pages.select("page_id", "url", (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(0), hour)).alias("fetched"))
    hosts = captures.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    j = judge(captures, sample_entries(hosts))
    return j.select("page_id", "host", F.col("fetched").cast("timestamp_ntz").alias("fetched"), "blocked", "list", "pattern")


SQL = r"""
WITH c AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_hours(CAST((page_id * 7919) % 8784 AS INTEGER)) AS fetched,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+(?::[0-9]*)?/([^/?#]*)', 1) AS seg
  FROM pages),
h AS (SELECT DISTINCT host, md5(host) AS m FROM c WHERE host IS NOT NULL),
d AS (SELECT host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS dom,
  CAST('0x' || m[1:2] AS INTEGER) AS x1, CAST('0x' || m[3:4] AS INTEGER) AS x3, CAST('0x' || m[5:6] AS INTEGER) AS x5, CAST('0x' || m[7:8] AS INTEGER) AS x7,
  CAST('0x' || m[9:10] AS INTEGER) AS x9, CAST('0x' || m[11:12] AS INTEGER) AS x11, CAST('0x' || m[13:14] AS INTEGER) AS x13, CAST('0x' || m[15:16] AS INTEGER) AS x15, CAST('0x' || m[17:18] AS INTEGER) AS x17 FROM h),
e AS (
  SELECT 'spam' AS list, host AS pattern, 'block' AS verdict, 'add' AS action, x3 AS dd FROM d WHERE x1 < 100
  UNION ALL SELECT 'spam', host, 'block', 'remove', x5 FROM d WHERE x1 < 60
  UNION ALL SELECT 'spam', host, 'block', 'add', x7 FROM d WHERE x1 < 30
  UNION ALL SELECT 'adult', dom, 'block', 'add', x11 FROM d WHERE x9 < 25
  UNION ALL SELECT 'trusted', host || '/en', 'allow', 'add', x15 FROM d WHERE x13 < 90
  UNION ALL SELECT 'trusted', host || '/en', 'allow', 'remove', x17 FROM d WHERE x13 < 40),
o AS (SELECT list, pattern, verdict, max(action) AS action, TIMESTAMP '2024-01-01' + to_days(dd) AS since FROM e GROUP BY list, pattern, verdict, dd),
i AS (SELECT *, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS until FROM o),
hit AS (
  SELECT page_id, list, pattern, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, verdict, list, pattern) AS n, verdict
  FROM c JOIN i ON (host = pattern OR ends_with(host, '.' || pattern) OR host || '/' || seg = pattern)
  WHERE action = 'add' AND fetched >= since AND (until IS NULL OR fetched < until))
SELECT c.page_id, host, fetched, coalesce(verdict = 'block', false) AS blocked, list, pattern
FROM c LEFT JOIN (SELECT * FROM hit WHERE n = 1) x ON x.page_id = c.page_id
"""
