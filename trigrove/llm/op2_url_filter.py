"""URL filters: a blocked Bloom filter before an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm.common import BLOOM_WORDS, bloom_block, bloom_blocks, bloom_has, bloom_size, table

#: (verdict, host, path), as the contract of the query fixes them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 8 << 20


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and path without a last ``/``, ``.html`` or index page; no scheme, query or fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(host, path))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent domain of it and whose path starts the url's path."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found.otherwise(F.lit(None)) if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_filter(pages: DataFrame, listed_urls: DataFrame, rules=RULES, bits_per_url: int = 16) -> DataFrame:
    """Judge ``pages(page_id, url, ...)`` against rules and the list ``listed_urls(url)``.

    Returns page_id, host, path, rule, verdict, canonical, possible (the Bloom filter let it through) and listed.
    A rule decides first (the longest one); else a page whose canonical url is listed is blocked; else allowed.
    The filter has about ``bits_per_url`` bits for each listed url; it is broadcast only while its size, known
    from the count of blocks, is at most ``BROADCAST_BYTES``, and joined by block beyond that. Possible hits go
    to an exact join on the canonical url, so false positives never show.
    Null urls, and urls without ``://``: empty host and path, no rule, never listed, allowed. Repeated pages
    give repeated rows. An empty list lists nothing. Other columns of either table are ignored.
    """
    listed = listed_urls.select(canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct()
    n = listed.count()
    blocks = bloom_size(n, bits_per_url)
    bloom = bloom_blocks(listed, "canonical", blocks)
    if blocks * (8 * BLOOM_WORDS + 16) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    judged = judged.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules)).withColumn("block", bloom_block(F.col("canonical"), blocks))
    judged = judged.join(bloom, "block", "left").withColumn("possible", F.coalesce(bloom_has(F.col("canonical")), F.lit(False)))
    # Only possible hits carry a join key; the others have a null key, which no row of the list matches.
    probe = judged.withColumn("_key", F.when(F.col("possible"), F.col("canonical")))
    exact = listed.select(F.col("canonical").alias("_key"), F.lit(True).alias("_listed"))
    hits = probe.where("possible").join(exact, "_key", "left")
    misses = probe.where("not possible").withColumn("_listed", F.lit(None).cast("boolean"))
    both = hits.unionByName(misses)
    is_listed = F.coalesce(F.col("_listed"), F.lit(False))
    return both.select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
        "canonical", "possible", is_listed.alias("listed"),
    )


def listed_from_pages(pages: DataFrame) -> DataFrame:
    """The list of this repository's query: urls of hosts that have a label with ``spam`` in it."""
    return pages.select("url").where(host_of(F.col("url")).contains("spam"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, listed_from_pages(pages)).drop("possible")


SQL = r"""
with p as (
  select page_id, url, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p
), c as (
  select *, case when host <> '' then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') end as canonical from q
), l as (select distinct canonical as listed_url from c where contains(host, 'spam'))
, r as (
  select c.*, l.listed_url is not null as listed,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from c left join l on c.canonical = l.listed_url
)
select page_id, host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' when listed then 'block' else 'allow' end as verdict,
  canonical, listed
from r
"""
