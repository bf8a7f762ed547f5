"""URL filters: dated list entries become validity intervals, joined to captures as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.llm.tables import table

SALTS = 16


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and leading dots; null if the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def url_keys(url: Column, labels_up_to: int | None = None, segments_up_to: int | None = None) -> Column:
    """Lookup keys of a URL: every suffix of its host, and its host with every leading part of its path.

    The limits, if given, leave out keys of more labels or segments than any list entry has.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")

    def up_to(n: Column, most: int | None) -> Column:
        n = n if most is None else F.least(n, F.lit(most))
        return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    domains = F.transform(up_to(F.size(labels), labels_up_to), lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(labels, -n, n), ".")))
    prefixes = F.transform(up_to(F.size(parts), segments_up_to),
                           lambda n: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(host.isNotNull(), F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>"))))


def longest_entries(entries: DataFrame, url_key: str = "url_key") -> tuple[int, int]:
    """The most host labels and the most path segments of any list entry: two numbers."""
    k = F.col(url_key)
    found = entries.agg(F.max(F.when(k.startswith("d:"), F.size(F.split(k, r"\.")))), F.max(F.when(k.startswith("p:"), F.size(F.split(k, "/")) - 1))).first()
    return found[0] or 0, found[1] or 0


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, url_key, valid_from, valid_to) from dated entries (list_name, url_key, action, listed_at).

    ``action`` is 'add' or 'remove' and counts from its own time on (of several at one time 'remove' wins), until the next
    time with another action; an open interval ends with null. Rows with nulls are left out. Repeats of an action
    within a day are dropped before a key's whole history is put in order, so a hot key takes part with its changes only.
    """
    times = entries.dropna(subset=["list_name", "url_key", "action", "listed_at"]).groupBy("list_name", "url_key", "listed_at").agg(F.max("action").alias("action"))
    own = ["list_name", "url_key"]
    for part in ([*own, F.to_date("listed_at")], own):
        prior = F.lag("action").over(Window.partitionBy(*part).orderBy("listed_at"))
        times = times.withColumn("prior", prior).where(F.col("prior").isNull() | (F.col("prior") != F.col("action")))
    spans = times.withColumn("valid_to", F.lead("listed_at").over(Window.partitionBy(*own).orderBy("listed_at")))
    return spans.where(F.col("action") == "add").select(*own, F.col("listed_at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at",
                    key: str = "page_id") -> DataFrame:
    """Every capture with the entries that were active at the time when it was fetched.

    Returns one row per distinct (``key``, ``url``, ``fetched``): these, url_host, n_entries (active matches),
    first_list, first_key (by name) and blocked. A null or unreadable URL, or no fetch time, matches nothing; an empty list
    blocks nothing. Entries of any depth count: the longest ones bound what is looked up.

    Captures meet intervals by equality of key and salt: a host may hold a third of all captures, so its
    rows are dealt over SALTS partitions and the (much smaller) interval table is repeated as often.
    """
    rows = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(fetched).alias("at")).distinct()
    keyed = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).withColumn(
        "k", F.explode(url_keys(F.col("url"), *longest_entries(entries))))
    spans = validity_intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("url_key", "k")
    hits = keyed.join(spans, ["k", "salt"]).where((F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    found = hits.groupBy("key", "url", "at").agg(F.count(F.lit(1)).alias("n_entries"), F.min(F.struct("list_name", "k")).alias("first"))
    found = found.select(F.col("key").alias("f_key"), F.col("url").alias("f_url"), F.col("at").alias("f_at"), "n_entries", "first")
    same = F.col("key").eqNullSafe(F.col("f_key")) & F.col("url").eqNullSafe(F.col("f_url")) & F.col("at").eqNullSafe(F.col("f_at"))
    return rows.join(found, same, "left").select(
        F.col("key").alias(key), F.col("url").alias(url), F.col("at").alias(fetched), host_of(F.col("url")).alias("url_host"),
        F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"), F.col("first.list_name").alias("first_list"),
        F.col("first.k").alias("first_key"), F.col("n_entries").isNotNull().alias("blocked"))


def captures_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures: every page, fetched on one of forty days that follows from its id. Entries: events of pages.

    An 'error' on a page lists its host, a 'signup' its host and first path segment, a 'purchase' takes
    the host off the list again; the page of an event is the one with the user's number.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("timestamp'2024-01-01' + make_dt_interval(int(pmod(page_id * 7919, 40)), int(pmod(page_id, 24)), 0, 0)"))
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup", "purchase")).select("user_id", "ts", "event_type")
    said = events.join(pages, events.user_id == pages.page_id)
    path = F.element_at(url_keys(F.col("url")), -1)
    host = F.concat(F.lit("d:"), host_of(F.col("url")))
    entries = said.select(
        F.when(F.col("event_type") == "signup", "paths").otherwise("hosts").alias("list_name"),
        F.when(F.col("event_type") == "signup", path).otherwise(host).alias("url_key"),
        F.when(F.col("event_type") == "purchase", "remove").otherwise("add").alias("action"), F.col("ts").alias("listed_at"))
    return captures, entries


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_captures(*captures_and_entries(spark, sf_dir))
    return out.select("page_id", "url_host", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"),
                      "n_entries", "first_list", "first_key", F.col("blocked").cast("string").alias("blocked"))


SQL = """
WITH pg AS (
  SELECT page_id, url, NULLIF(REGEXP_EXTRACT(LOWER(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
         LIST_FILTER(STRING_SPLIT(REGEXP_EXTRACT(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda p: p <> '') AS parts,
         TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(page_id * 7919 % 40 AS INT) + INTERVAL 1 HOUR * CAST(page_id % 24 AS INT) AS fetched
  FROM pages),
split_ AS (SELECT *, STRING_SPLIT(host, '.') AS labels FROM pg WHERE host IS NOT NULL),
keyed AS (
  SELECT page_id, url, fetched, host, LIST_CONCAT(
    LIST_TRANSFORM(RANGE(1, LEN(labels) + 1), lambda n: 'd:' || ARRAY_TO_STRING(labels[LEN(labels) - n + 1:], '.')),
    LIST_TRANSFORM(RANGE(1, LEN(parts) + 1), lambda n: 'p:' || host || '/' || ARRAY_TO_STRING(parts[1:n], '/'))) AS ks
  FROM split_),
entries AS (
  SELECT CASE WHEN event_type = 'signup' THEN 'paths' ELSE 'hosts' END AS list_name,
         CASE WHEN event_type = 'signup' THEN ks[-1] ELSE 'd:' || host END AS k,
         CASE WHEN event_type = 'purchase' THEN 'remove' ELSE 'add' END AS action, ts
  FROM events JOIN keyed ON user_id = page_id WHERE event_type IN ('error', 'signup', 'purchase')),
times AS (SELECT list_name, k, ts, MAX(action) AS action FROM entries GROUP BY ALL),
changed AS (SELECT * FROM (SELECT *, LAG(action) OVER (PARTITION BY list_name, k ORDER BY ts) AS prior FROM times) WHERE prior IS NULL OR prior <> action),
spans AS (SELECT * FROM (SELECT list_name, k, action, ts AS valid_from, LEAD(ts) OVER (PARTITION BY list_name, k ORDER BY ts) AS valid_to FROM changed) WHERE action = 'add'),
hits AS (
  SELECT page_id, list_name, s.k FROM (SELECT page_id, fetched, UNNEST(ks) AS k FROM keyed) c JOIN spans s ON c.k = s.k
  WHERE fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)),
found AS (SELECT page_id, COUNT(*) AS n, MIN({'l': list_name, 'k': k}) AS first FROM hits GROUP BY page_id)
SELECT pg.page_id, host AS url_host, STRFTIME(fetched, '%Y-%m-%d %H:%M:%S') AS fetched_at, COALESCE(n, 0) AS n_entries,
       first.l AS first_list, first.k AS first_key, CAST(n IS NOT NULL AS VARCHAR) AS blocked
FROM pg LEFT JOIN found ON pg.page_id = found.page_id
"""
