"""URL filters by a temporal list join, by DataFrame functions only.

A list is a log: a pattern is added or removed at a date. Entries become validity intervals, and each capture
of a URL is judged by the entries that were active when it was fetched. Patterns are domains (with all hosts
below), hosts, or a host with the first part of its path. A capture asks for a handful of keys, one for each
suffix of its host, by an equi-join; the intervals of a key come as one sorted array, so a hot host meets one
row, however often its entries changed, and no capture is multiplied by intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: str | Column) -> Column:
    """Lower-case host of a URL, without user, port and final dot; null if there is none. An IPv6 address keeps
    its brackets."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#\s]*\]|[^/:?#\s\[]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def section_of(url: str | Column) -> Column:
    """First part of a URL's path, empty if there is none."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]*/([^/?#]*)", 1)


#: An address, which has no domains.
ADDRESS = r"^(\[.*|[0-9]{1,3}(\.[0-9]{1,3}){3})$"


def domain_of(host: Column) -> Column:
    """The last two labels of a host; an address as it is."""
    return F.when(host.rlike(ADDRESS), host).otherwise(F.substring_index(host, ".", -2))


def keys_of(host: Column, section: Column) -> Column:
    """What a list can name a capture by: ``domain:`` for each suffix of two labels or more (or the only label, or
    the whole address), ``host:`` and ``path:``."""
    labels = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.least(F.lit(2), n), n), lambda k: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -k, k), ".")))
    own = F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("path:"), host, F.lit("/"), section))
    return F.concat(suffixes, own)


def intervals(entries: DataFrame) -> DataFrame:
    """entries (key, verdict, category, action, at) -> (key, verdict, category, since, until): from an add to
    the next entry of the same key, verdict and category. Of entries at one time the removal counts last;
    nulls in key, action or at make an entry void; an add while active changes nothing but the start."""
    w = Window.partitionBy("key", "verdict", "category").orderBy("at", F.col("action") == "remove")
    valid = entries.where("key is not null and action in ('add', 'remove') and at is not null").distinct()
    ended = valid.withColumn("until", F.lead("at").over(w)).where("action = 'add'")
    return ended.where("until is null or at < until").select("key", "verdict", "category", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, at_col: str) -> DataFrame:
    """One row for each capture: (id_col, url_col, host, at_col, verdict, matched, category, active_since).

    The longest matching pattern decides; of equals a path before a host before a domain, then allow before
    block, then the first category (null before all), then the earliest start. ``verdict`` is allow or block, none without an active entry, invalid for a
    null URL or one without a host. A null time matches nothing. Repeated captures stay. Empty tables and
    columns of other names are fine."""
    own = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("t")).withColumn("host", host_of("url"))
    invalid = own.where("host is null")  # has no key, so it doesn't go to the join, where all of them would meet in one task
    own = own.where("host is not null").withColumn("keys", keys_of(F.col("host"), section_of("url")))
    asked = own.select("id", "url", "t", "host", F.size("keys").alias("asks"), F.explode("keys").alias("key"))
    found = intervals(entries).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("since", "until", "verdict", "category"))).alias("spans"))
    pattern = F.substring_index("key", ":", -1)
    kind = F.element_at(F.create_map(*map(F.lit, ("path", 2, "host", 1, "domain", 0))), F.substring_index("key", ":", 1))
    active = F.filter("spans", lambda s: (s["since"] <= F.col("t")) & (s["until"].isNull() | (F.col("t") < s["until"])))
    rank = lambda s: F.struct((-F.length(pattern)).alias("n"), (-kind).alias("kind"), (s["verdict"] != "allow").alias("block"), s["category"].alias("category"), s["since"].alias("since"), F.col("key").alias("key"), s["verdict"].alias("verdict"))
    judged = asked.join(found, "key", "left").withColumn("best", F.array_min(F.transform(active, rank)))
    best = judged.groupBy("id", "url", "t", "host").agg(F.min("best").alias("best"), F.count("*").alias("rows"), F.max("asks").alias("asks"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / F.col("asks")).cast("int"))))
    names = (F.col("id").alias(id_col), F.col("url").alias(url_col), "host", F.col("t").alias(at_col))
    decided = best.select(*names, F.coalesce("best.verdict", F.lit("none")).alias("verdict"), F.col("best.key").alias("matched"), F.col("best.category").alias("category"), F.col("best.since").alias("active_since"))
    nothing = (F.lit(None).cast(decided.schema[c].dataType).alias(c) for c in ("matched", "category", "active_since"))
    return decided.union(invalid.select(*names, F.lit("invalid").alias("verdict"), *nothing))


#: The day from which the query's captures and list count.
FIRST_DAY = "2024-01-01"


def _number(c: Column) -> Column:
    """A number below 2^28 that depends on a text."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 7), 16, 10).cast("long")


def _day(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The tables have no fetch times: a page is fetched on a day of a year that its number picks."""
    return pages.select("page_id", "url", _day(F.col("page_id") * 7919 % 366).alias("fetched_on"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list about the hosts of the table: known farms from the first day on; a quarter of the domains
    blocked for a while, some of them again; some hosts allowed from a day on; some paths blocked."""
    own = pages.select(host_of("url").alias("host"), section_of("url").alias("section")).where("host is not null").distinct()
    domains = own.select(domain_of(F.col("host")).alias("d")).distinct().withColumn("n", _number(F.col("d")))
    hosts = own.select("host").distinct().withColumn("n", _number(F.col("host")))
    paths = own.select(F.concat("host", F.lit("/"), "section").alias("p")).where("p not like '%/'").distinct().withColumn("n", _number(F.col("p")))

    def entry(df: DataFrame, where: str, prefix: str, name: str, verdict: str, category: str, action: str, day: Column) -> DataFrame:
        return df.where(where).select(F.concat(F.lit(prefix), name).alias("key"), F.lit(verdict).alias("verdict"), F.lit(category).alias("category"), F.lit(action).alias("action"), _day(day).alias("at"))

    n = F.col("n")
    parts = [
        entry(hosts, "host rlike '^(spam-farm|cheap-pills)[.]'", "host:", "host", "block", "farm", "add", F.lit(0)),
        entry(domains, "n % 4 = 0", "domain:", "d", "block", "spam", "add", n % 200),
        entry(domains, "n % 4 = 0 and n % 3 <> 0", "domain:", "d", "block", "spam", "remove", n % 200 + 60 + n % 60),
        entry(domains, "n % 4 = 0 and n % 3 = 1", "domain:", "d", "block", "spam", "add", n % 200 + 140 + n % 60),
        entry(hosts, "n % 7 = 0", "host:", "host", "allow", "reviewed", "add", n % 150),
        entry(paths, "n % 5 = 0", "path:", "p", "block", "section", "add", n % 250),
        entry(paths, "n % 5 = 0", "path:", "p", "block", "section", "remove", n % 250 + 45),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


_HOST = r"nullif(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#\s]*\]|[^/:?#\s\[]+)', 1), '\.+$', ''), '')"
_SECTION = r"regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]*/([^/?#]*)', 1)"
ORACLE = f"""
WITH c AS (SELECT page_id, url, DATE '{FIRST_DAY}' + CAST(page_id * 7919 % 366 AS INTEGER) AS t, {_HOST} AS host, {_SECTION} AS section FROM pages),
x AS (SELECT *, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN [host] ELSE string_split(host, '.') END AS l FROM c),
o AS (SELECT DISTINCT host, section, array_to_string(l[-2:], '.') AS d FROM x WHERE host IS NOT NULL),
dom AS (SELECT DISTINCT d AS k, ('0x' || substr(md5(d), 1, 7))::BIGINT AS n FROM o),
hos AS (SELECT DISTINCT host AS k, ('0x' || substr(md5(host), 1, 7))::BIGINT AS n FROM o),
pat AS (SELECT DISTINCT host || '/' || section AS k, ('0x' || substr(md5(host || '/' || section), 1, 7))::BIGINT AS n FROM o WHERE section <> ''),
ev AS (
  SELECT 'host:' || k AS key, 'block' AS verdict, 'farm' AS category, 'add' AS action, 0 AS day FROM hos WHERE regexp_matches(k, '^(spam-farm|cheap-pills)[.]')
  UNION ALL SELECT 'domain:' || k, 'block', 'spam', 'add', n % 200 FROM dom WHERE n % 4 = 0
  UNION ALL SELECT 'domain:' || k, 'block', 'spam', 'remove', n % 200 + 60 + n % 60 FROM dom WHERE n % 4 = 0 AND n % 3 <> 0
  UNION ALL SELECT 'domain:' || k, 'block', 'spam', 'add', n % 200 + 140 + n % 60 FROM dom WHERE n % 4 = 0 AND n % 3 = 1
  UNION ALL SELECT 'host:' || k, 'allow', 'reviewed', 'add', n % 150 FROM hos WHERE n % 7 = 0
  UNION ALL SELECT 'path:' || k, 'block', 'section', 'add', n % 250 FROM pat WHERE n % 5 = 0
  UNION ALL SELECT 'path:' || k, 'block', 'section', 'remove', n % 250 + 45 FROM pat WHERE n % 5 = 0),
iv AS (SELECT key, verdict, category, action, DATE '{FIRST_DAY}' + CAST(day AS INTEGER) AS since,
  DATE '{FIRST_DAY}' + CAST(lead(day) OVER (PARTITION BY key, verdict, category ORDER BY day, action = 'remove') AS INTEGER) AS until FROM ev),
q AS (SELECT page_id, url, host, t, unnest(list_concat(list_transform(range(least(2, len(l)), len(l) + 1), lambda k: 'domain:' || array_to_string(l[-k:], '.')), ['host:' || host, 'path:' || host || '/' || section])) AS key FROM x WHERE host IS NOT NULL),
m AS (SELECT q.page_id, iv.*, row_number() OVER (PARTITION BY q.page_id ORDER BY length(q.key) - length(split_part(q.key, ':', 1)) DESC,
    CASE split_part(q.key, ':', 1) WHEN 'path' THEN 2 WHEN 'host' THEN 1 ELSE 0 END DESC, iv.verdict = 'allow' DESC, iv.category) AS r
  FROM q JOIN iv ON q.key = iv.key AND iv.action = 'add' AND iv.since <= q.t AND (iv.until IS NULL OR q.t < iv.until))
SELECT c.page_id, c.url, c.host, c.t AS fetched_on, CASE WHEN c.host IS NULL THEN 'invalid' ELSE coalesce(m.verdict, 'none') END AS verdict,
  m.key AS matched, m.category, m.since AS active_since
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.r = 1
"""
