"""URL filters as of the time of fetch: dated list entries, validity intervals, an as-of join.

A list is a history of entries: on a day a key is added or removed. A key names an exact address, a
first path segment of a host, a host or a registered domain. Entries of a key become intervals that
run from one entry's day to the next one's. A capture meets, for each of its own keys, the interval
that holds the day of its fetch: intervals are dealt out by key and month, so that the join is on
equal values and a key with a long history or many captures is spread over its months.

Everything is made of Spark's own functions. Defined cases: a null address has no keys and is not
blocked; a capture without a time, or an entry without a key or day, meets nothing; a day with both
an addition and a removal of a key counts as a removal; repeated rows are one capture; a key has at
most one interval a day, so the history of a key is bounded by its days; no rows give no rows; other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helioquant.llm.common import read_table

#: Kinds of keys, the most specific last.
KINDS = ("domain", "host", "prefix", "url")


def url_keys(url: Column) -> dict[str, Column]:
    """The keys of an address by kind; null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)", 2))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    segment = F.regexp_extract(path, r"^(/[^/]+)", 1)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    known = (host != "") & url.isNotNull()
    return {
        "domain": F.when(known & (domain != ""), domain),
        "host": F.when(known, host),
        "prefix": F.when(known & (segment != ""), F.concat(host, segment)),
        "url": F.when(known & (path != ""), F.concat(host, path)),
    }


def validity(entries: DataFrame) -> DataFrame:
    """kind, key, valid_from, valid_to (null: open) and active; entries: kind, key, listed (date), added (boolean)."""
    days = (
        entries.where("kind is not null and key is not null and listed is not null")
        .groupBy("kind", "key", "listed").agg(F.min(F.coalesce("added", F.lit(False))).alias("active"))
    )
    following = F.lead("listed").over(Window.partitionBy("kind", "key").orderBy("listed"))
    return days.select("kind", "key", F.col("listed").alias("valid_from"), following.alias("valid_to"), "active")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each capture (id, url, fetched: a date): what was active on the day of its fetch.

    blocked; n_active, the number of its keys that were listed; rule_kind, rule_key and
    listed_since of the most specific one.
    """
    last = F.lit(captures.agg(F.max("fetched")).first()[0]).cast("date")  # no later month is needed
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)
    spans = validity(entries).where("active")
    spans = spans.where(F.col("valid_from") <= until).select(
        "kind", "key", "valid_from", "valid_to",
        F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(until, "month"), F.expr("interval 1 month"))).alias("month"),
    )
    keys = url_keys(F.col("url"))
    own = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), keys[k].alias("key")) for i, k in enumerate(KINDS)])
    asked = captures.select("id", "url", "fetched", F.explode(own).alias("own")).select(
        "id", "url", "fetched", "own.rank", "own.kind", "own.key", F.trunc("fetched", "month").alias("month")
    )
    met = asked.alias("a").join(
        spans.alias("s"),
        (F.col("a.kind") == F.col("s.kind")) & (F.col("a.key") == F.col("s.key")) & (F.col("a.month") == F.col("s.month"))
        & (F.col("a.fetched") >= F.col("s.valid_from")) & (F.col("s.valid_to").isNull() | (F.col("a.fetched") < F.col("s.valid_to"))),
        "left",
    )
    rule = F.when(F.col("s.key").isNotNull(), F.struct("a.rank", "s.kind", "s.key", "s.valid_from"))
    found = met.select("a.id", "a.url", "a.fetched", rule.alias("rule")).groupBy("id", "url", "fetched").agg(
        F.size(F.collect_set("rule.rank")).alias("n_active"), F.max("rule").alias("rule")
    )
    return found.select(
        "id", "url", "fetched", (F.col("n_active") > 0).alias("blocked"), F.col("n_active").cast("long").alias("n_active"),
        F.col("rule.kind").alias("rule_kind"), F.col("rule.key").alias("rule_key"), F.col("rule.valid_from").alias("listed_since"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """pages as captures. The table has no times; a day of 2024 is derived from page_id."""
    return pages.select(
        F.col("page_id").alias("id"), "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 366) as int))").alias("fetched")
    )


def entries_of(pages: DataFrame) -> DataFrame:
    """List entries derived from pages, which stand in for a filter list: each page gives one entry.

    page_id decides the kind of its key, the day, and whether the key is added or removed (a third).
    """
    keys = url_keys(F.col("url"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    key = F.element_at(F.array(*[keys[k] for k in KINDS]), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    return pages.select(
        kind.alias("kind"), key.alias("key"),
        F.expr("date_add(date'2023-06-01', cast(pmod(page_id * 53, 730) as int))").alias("listed"),
        (F.pmod(F.floor(F.col("page_id") / 4), F.lit(3)) != 0).alias("added"),
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries of its time."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rows = evaluate(captures_of(pages), entries_of(pages)).withColumnRenamed("id", "page_id")
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("fetched", "listed_since")})


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)', 2)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path
  FROM pages),
keyed AS (
  SELECT page_id, url, [
    {'rank': 0, 'kind': 'domain', 'key': nullif(regexp_extract(host, '([^.]+\.[^.]+)$', 1), '')},
    {'rank': 1, 'kind': 'host', 'key': nullif(host, '')},
    {'rank': 2, 'kind': 'prefix', 'key': CASE WHEN host <> '' AND regexp_extract(path, '^(/[^/]+)', 1) <> '' THEN host || regexp_extract(path, '^(/[^/]+)', 1) END},
    {'rank': 3, 'kind': 'url', 'key': CASE WHEN host <> '' AND path <> '' THEN host || path END}] AS keys
  FROM parts),
days AS (
  SELECT keys[page_id % 4 + 1].kind AS kind, keys[page_id % 4 + 1].key AS key,
    DATE '2023-06-01' + CAST(page_id * 53 % 730 AS INTEGER) AS listed, bool_and((page_id // 4) % 3 <> 0) AS active
  FROM keyed WHERE keys[page_id % 4 + 1].key IS NOT NULL GROUP BY ALL),
captures AS (
  SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched, keys FROM keyed),
asked AS (
  SELECT page_id, url, fetched, own.rank AS rank, own.kind AS kind, own.key AS key
  FROM (SELECT page_id, url, fetched, unnest(keys) AS own FROM captures)),
met AS (
  SELECT a.page_id, a.url, a.fetched, a.rank, d.kind, d.key, d.listed
  FROM asked a ASOF JOIN days d ON a.kind = d.kind AND a.key = d.key AND a.fetched >= d.listed
  WHERE d.active)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, count(m.rank) > 0 AS blocked, count(m.rank) AS n_active,
  arg_max(m.kind, m.rank) AS rule_kind, arg_max(m.key, m.rank) AS rule_key, strftime(arg_max(m.listed, m.rank), '%Y-%m-%d') AS listed_since
FROM captures c LEFT JOIN met m ON c.page_id = m.page_id AND c.url = m.url
GROUP BY c.page_id, c.url, c.fetched
"""
