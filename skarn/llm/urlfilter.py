"""URL filters by a temporal list join, in DataFrame expressions only.

A list is a log of dated entries: at `listed_at`, `domain` was added to or removed from it under a category. Entries of
one domain and category become validity intervals, each lasting until the next entry of the same domain and category;
other categories of the domain run on by themselves. Captures are judged by an as-of join: probes of a (domain, category)
and the starts of its intervals go through one window in order of time, so each probe finds the interval that began
last at or before it, and is blocked if that has not ended. A domain covers its subdomains, and the most specific active
entry names the verdict (of several categories the last by name).

Captures of one host at one time meet the list once: distinct (host, time) pairs are judged and the verdicts are
written and joined back. A window holds the distinct fetch times of one (domain, category), never its captures.

Defined cases: a null or hostless URL, or a null time, is never blocked; of entries of one domain, category and time, a
removal wins; a removal without an addition, or a repeated entry, changes nothing; entries with a null domain or time are
ignored, and a null category is a category; an address (IPv4, or IPv6 in brackets) is covered by an entry of itself only;
names are compared in lower case as they are written, without a translation between scripts; repeated captures
are judged each; empty captures or lists give an empty result or no block; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.llm.scratch import Scratch

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)"
ADDRESS = r"^(\[.*|\d{1,3}(\.\d{1,3}){3})$"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more; a host of one label, or an address, is its own."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "."))
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(every)


def intervals(entries: DataFrame) -> DataFrame:
    """domain, category, valid_from, valid_to of additions; valid_to is null where nothing follows."""
    order = Window.partitionBy("domain", "category").orderBy("listed_at")
    named = entries.where("domain is not null and listed_at is not null").select(F.lower("domain").alias("domain"), "category", "listed_at", (F.col("action") == "add").alias("added"))
    known = named.groupBy("domain", "category", "listed_at").agg(F.min("added").alias("added"))
    dated = known.withColumn("valid_to", F.lead("listed_at").over(order))
    return dated.where("added").select("domain", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def active(probes: DataFrame, listed: DataFrame) -> DataFrame:
    """The probes (domain, at) with each category whose interval holds at that time: domain, category, at."""
    kinds = listed.select("domain", "category").distinct()
    asked = probes.join(kinds, "domain").select("domain", "category", "at", F.lit(None).cast(listed.schema["valid_from"].dataType).alias("valid_from"), F.lit(None).cast(listed.schema["valid_to"].dataType).alias("valid_to"), F.lit(1).alias("side"))
    starts = listed.select("domain", "category", F.col("valid_from").alias("at"), "valid_from", "valid_to", F.lit(0).alias("side"))
    so_far = Window.partitionBy("domain", "category").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("side") == 0, F.struct("valid_from", "valid_to")), ignorenulls=True).over(so_far)
    found = starts.unionByName(asked).withColumn("last", last).where("side = 1 and last is not null")
    return found.where("last.valid_to is null or at < last.valid_to").select("domain", "category", "at")


def judge(spark: SparkSession, captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_at) with host, blocked, entry_domain and category."""
    scratch = Scratch(spark, "urlfilter")
    own = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at")
    asked = own.where("host <> '' and fetched_at is not null").select("host", "fetched_at").distinct()
    spread = scratch.cut(asked.select("host", F.col("fetched_at").alias("at"), F.explode(suffixes(F.col("host"))).alias("domain")), "spread")
    listed = scratch.cut(intervals(entries), "intervals")
    hits = active(spread.select("domain", "at").distinct(), listed)
    best = spread.join(hits, ["domain", "at"]).groupBy("host", F.col("at").alias("fetched_at")).agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "category")).alias("hit"))
    # Written before it is joined: the join then lies right on its two exchanges, where a hot host can be split.
    best = scratch.cut(best, "best")
    joined = own.join(best, ["host", "fetched_at"], "left")
    return joined.select("page_id", "host", "fetched_at", F.col("hit").isNotNull().alias("blocked"), F.col("hit.domain").alias("entry_domain"), F.col("hit.category").alias("category"))


_CAPTURES = "SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS fetched_at FROM pages"
#: A list that follows the hosts: a third of them are listed on a day that their letters give, and most of those are taken off later, some to return.
_ENTRIES = """
SELECT host AS domain, CAST(DATE '2024-01-01' + CAST(k % 300 AS INT) AS DATE) AS listed_at, 'add' AS action, CASE WHEN k % 2 = 0 THEN 'spam' ELSE 'malware' END AS category FROM hosts WHERE k % 3 = 0
UNION ALL SELECT host, CAST(DATE '2024-01-01' + CAST(k % 300 + 45 AS INT) AS DATE), 'remove', CASE WHEN k % 2 = 0 THEN 'spam' ELSE 'malware' END FROM hosts WHERE k % 3 = 0 AND k % 5 <> 0
UNION ALL SELECT host, CAST(DATE '2024-01-01' + CAST(k % 300 + 60 AS INT) AS DATE), 'add', 'relisted' FROM hosts WHERE k % 3 = 0 AND k % 7 = 0
UNION ALL SELECT host, CAST(DATE '2024-01-01' + CAST(k % 200 AS INT) AS DATE), 'add', 'adult' FROM hosts WHERE k % 4 = 0
UNION ALL SELECT host, CAST(DATE '2024-01-01' + CAST(k % 200 + 90 AS INT) AS DATE), 'remove', 'adult' FROM hosts WHERE k % 8 = 0
UNION ALL SELECT 'example.org', DATE '2024-03-01', 'add', 'campaign'
UNION ALL SELECT 'example.org', DATE '2024-05-01', 'remove', 'campaign'
UNION ALL SELECT 'example.org', DATE '2024-05-01', 'add', 'campaign'
"""
_NUMBER = "length(host) * 31 + ascii(host) * 17 + ascii(substr(host, 3, 1)) * 7 + ascii(substr(host, 5, 1))"


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures, one day a page in 2024, against a dated list of their hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = spark.sql(_CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().select("host", F.expr(_NUMBER).alias("k"))
    entries = spark.sql(_ENTRIES.replace("FROM hosts", "FROM {hosts}"), hosts=hosts)
    return judge(spark, captures, entries).withColumn("fetched_at", F.col("fetched_at").cast("string"))


OP9_SQL = rf"""
WITH c AS (SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '\.+$', '') AS host, fetched_at FROM ({_CAPTURES})),
hosts AS (SELECT host, {_NUMBER} AS k FROM (SELECT DISTINCT host FROM c WHERE host <> '')),
e AS (SELECT lower(domain) AS domain, category, listed_at, bool_and(action = 'add') AS added FROM ({_ENTRIES}) GROUP BY ALL),
p AS (SELECT host, fetched_at, domain, category FROM (
    SELECT host, fetched_at, unnest(CASE WHEN regexp_full_match(host, '\[.*|\d{{1,3}}(\.\d{{1,3}}){{3}}') THEN [host] ELSE list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END) AS domain
    FROM (SELECT DISTINCT host, fetched_at FROM c WHERE host <> '')) JOIN (SELECT DISTINCT domain, category FROM e) USING (domain)),
h AS (SELECT p.host, p.fetched_at, p.domain, p.category FROM p ASOF JOIN e ON p.domain = e.domain AND p.category = e.category AND p.fetched_at >= e.listed_at WHERE e.added)
SELECT page_id, c.host, CAST(c.fetched_at AS VARCHAR) AS fetched_at, domain IS NOT NULL AS blocked, domain AS entry_domain, category
FROM c LEFT JOIN (SELECT DISTINCT ON (host, fetched_at) * FROM h ORDER BY host, fetched_at, length(domain) DESC, domain DESC, category DESC) AS h ON c.host = h.host AND c.fetched_at = h.fetched_at
"""
