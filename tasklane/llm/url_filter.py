"""URL filters as a temporal list join.

A list is a log of dated changes: a pattern is added or removed, as a block
or an allow entry. Changes become validity intervals (a pattern and kind
holds from an addition to the next removal), and every capture is joined to
the intervals that hold on the day it was fetched. A pattern is a host suffix
by whole labels with an optional path prefix by whole segments; the most
specific active entry decides.

Captures and intervals meet in equi-joins: a capture gives one key for each
host suffix and path prefix, no deeper than any pattern is. Keys are salted,
since one host may hold a third of all captures; the list is repeated once
for each salt. Only URLs are shuffled, never page bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tasklane.llm.common import prepare, table
from tasklane.session import cut_lineage

SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host of a URL or a bare pattern; empty if there is none."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")),
                            "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    name = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*", 0), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(
        F.lower(name), ":[0-9]*$", ""), r"\.+$", "")


def segments_of(url: Column) -> Column:
    """Path segments, as written, without query and fragment."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")),
                            "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _key(host: Column, segments: Column) -> Column:
    return F.concat(host, F.lit("/"), F.array_join(segments, "/"))


def intervals(changes: DataFrame) -> DataFrame:
    """``(pattern, kind, action, day)`` -> ``(key, kind, depth, since,
    until)``: the day an entry starts to hold, and the first on which it
    doesn't (null: still holds).

    ``kind`` is ``block`` or ``allow``, ``action`` ``add`` or ``remove``;
    rows with other values, a null or a pattern without host are ignored.
    Repeated changes count once; of changes on one day an addition wins. So
    a pattern's group holds at most one row for each day of the calendar."""
    rows = changes.where(
        "day is not null and kind in ('block', 'allow') and action in "
        "('add', 'remove')").select(
            host_of(F.col("pattern")).alias("host"),
            segments_of(F.col("pattern")).alias("path"), "kind",
            (F.col("action") == "add").cast("int").alias("on"),
            F.col("day").cast("date").alias("since")).where("host != ''")
    rows = rows.select(_key(F.col("host"), F.col("path")).alias("key"),
                       F.size("path").alias("depth"), "kind", "on", "since")
    rows = rows.groupBy("key", "kind", "depth", "since").agg(
        F.max("on").alias("on"))
    order = W.partitionBy("key", "kind").orderBy("since")
    rows = rows.withColumn("changed", F.coalesce(
        F.lag("on").over(order), F.lit(0)) != F.col("on"))
    rows = rows.where("changed").withColumn(
        "until", F.lead("since").over(order))
    return rows.where("on = 1").select("key", "kind", "depth", "since",
                                       "until")


def url_filter(captures: DataFrame, changes: DataFrame,
               salts: int = SALTS) -> DataFrame:
    """``(page_id, url, fetched)`` -> one row for each capture with ``host``,
    ``n_active`` (entries that match and hold on the day), ``entry``,
    ``kind`` and ``since`` of the deciding one (the longest key; of two, the
    block) and ``blocked``.

    A null or empty URL, or a null day, matches nothing. Repeated captures
    each get a row. A host of digits and points only is matched whole. Empty
    tables give no rows or no matches. Other columns aren't read."""
    prepare(captures.sparkSession)
    held = cut_lineage(intervals(changes))
    deepest = held.agg(F.max("depth")).first()[0] or 0
    own = captures.select(
        F.col("page_id").alias("page_id"), F.col("url").alias("url"),
        F.col("fetched").cast("date").alias("fetched"))
    own = own.withColumn("host", host_of(F.col("url")))
    distinct = own.where("host != '' and fetched is not null").select(
        "url", "fetched", "host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host").rlike("^[0-9.]+$"), F.array(
        "host")).otherwise(F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    path = F.slice(segments_of(F.col("url")), 1, max(1, deepest)) \
        if deepest else F.array().cast("array<string>")
    keys = distinct.select(
        "url", "fetched", "host", F.explode(suffixes).alias("suffix"),
        path.alias("path"))
    keys = keys.select("url", "fetched", "suffix", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("path")),
        lambda n: F.slice("path", 1, n))).alias("part"), "path")
    keys = keys.select(
        "url", "fetched", _key(F.col("suffix"), F.col("part")).alias("key"),
        F.pmod(F.xxhash64("url", "fetched"), F.lit(salts)).alias("salt"))
    spread = held.withColumn("salt", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    active = keys.join(spread, ["key", "salt"]).where(
        "since <= fetched and (until is null or fetched < until)")
    best = F.max(F.struct(
        F.length("key").alias("size"),
        (F.col("kind") == "block").alias("block"), "key", "kind", "since"))
    verdict = active.groupBy("url", "fetched").agg(
        F.count("*").alias("n_active"), best.alias("best"))
    verdict = verdict.select(F.col("url").alias("_url"),
                             F.col("fetched").alias("_fetched"),
                             "n_active", "best")
    found = own.join(verdict, (own.url == verdict["_url"])
                     & (own.fetched == verdict["_fetched"]), "left")
    return found.select(
        "page_id", "url", "host", "fetched",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.key").alias("entry"), F.col("best.kind").alias("kind"),
        F.col("best.since").alias("since"),
        F.coalesce(F.col("best.block"), F.lit(False)).alias("blocked"))


# The supplied pages carry neither fetch days nor a list. Both are derived
# from them by digests, in SQL that Spark and DuckDB read alike: {n:x} stands
# for the number of the first four hex digits of md5(x).
_FETCHED = ("date '2024-01-01' + cast({n:'t' || cast(page_id as varchar)}"
            " % 366 as int)")
_CHANGES = (
    ("host", "block", "add", "{n:'b' || host} % 300",
     "{n:'a' || host} % 3 = 0"),
    ("host", "block", "remove",
     "{n:'b' || host} % 300 + 30 + {n:'c' || host} % 50",
     "{n:'a' || host} % 3 = 0 and {n:'d' || host} % 2 = 0"),
    ("host", "block", "add",
     "{n:'b' || host} % 300 + 50 + {n:'c' || host} % 50",
     "{n:'a' || host} % 3 = 0 and {n:'d' || host} % 4 = 0"),
    ("host || '/en/'", "allow", "add", "{n:'g' || host} % 366",
     "{n:'f' || host} % 4 = 0"),
    ("regexp_replace(host, '^[^.]*[.]', '')", "block", "add",
     "{n:'j' || host} % 366", "{n:'i' || host} % 5 = 0"),
)


def _digits(sql: str, form: str) -> str:
    """``{n:x}`` in the form of one SQL dialect."""
    out, rest = "", sql
    while "{n:" in rest:
        head, _, tail = rest.partition("{n:")
        inner, _, rest = tail.partition("}")
        out += head + form.format(inner)
    return out + rest


_SPARK = "cast(conv(substr(md5({}), 1, 4), 16, 10) as int)"
_DUCK = "cast('0x' || substr(md5({}), 1, 4) as int)"


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures with the derived fetch day."""
    day = _digits(_FETCHED, _SPARK).replace("varchar", "string")
    return pages.select("page_id", "url", F.expr(day).alias("fetched"))


def changes_of(pages: DataFrame) -> DataFrame:
    """The derived list: changes for a share of the hosts of ``pages``."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where(
        "host != ''").distinct()
    one = F.array(*[F.expr(_digits(
        f"case when {when} then struct({pattern} as pattern, '{kind}' as "
        f"kind, '{action}' as action, date '2024-01-01' + cast({day} as int)"
        " as day) end", _SPARK))
        for pattern, kind, action, day, when in _CHANGES])
    return hosts.select(F.explode(one).alias("c")).where(
        "c is not null").select("c.*")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the derived list on every page."""
    pages = table(spark, sf_dir, "pages")
    return url_filter(captures_of(pages), changes_of(pages))


def oracle_sql() -> str:
    """The same in DuckDB."""
    def host(x: str) -> str:
        return (f"regexp_replace(regexp_replace(lower(regexp_replace("
                f"regexp_extract(regexp_replace(coalesce({x}, ''), "
                f"'^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*'), "
                f"'^.*@', '')), ':[0-9]*$', ''), '\\.+$', '')")

    def path(x: str) -> str:
        return (f"list_filter(string_split(regexp_extract(regexp_replace("
                f"coalesce({x}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), "
                f"'^[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')")
    changes = " UNION ALL ".join(_digits(
        f"SELECT {p} AS pattern, '{k}' AS kind, '{a}' AS action, "
        f"date '2024-01-01' + cast({d} as int) AS day FROM hosts WHERE {w}",
        _DUCK) for p, k, a, d, w in _CHANGES)
    return f"""
WITH caps AS (SELECT page_id, url, {host('url')} AS host,
    {path('url')} AS segs, {_digits(_FETCHED, _DUCK)} AS fetched FROM pages),
hosts AS (SELECT DISTINCT host FROM caps WHERE host <> ''),
changes AS ({changes}),
days AS (SELECT {host('pattern')} || '/' ||
      array_to_string({path('pattern')}, '/') AS key, kind, day AS since,
    max(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS listed
  FROM changes GROUP BY ALL),
turns AS (SELECT *, coalesce(lag(listed) OVER (PARTITION BY key, kind
    ORDER BY since), 0) <> listed AS changed FROM days),
held AS (SELECT * FROM (SELECT key, kind, since, listed, lead(since) OVER (
    PARTITION BY key, kind ORDER BY since) AS until FROM turns WHERE changed)
  WHERE listed = 1),
keys AS (SELECT page_id, url, fetched, suffix || '/' ||
      array_to_string(segs[1:n], '/') AS key FROM (
    SELECT *, unnest(range(0, len(segs) + 1)) AS n FROM (
      SELECT *, unnest(CASE WHEN regexp_matches(host, '^[0-9.]+$')
        THEN [host] ELSE list_transform(range(1, len(string_split(host, '.'))
          + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
        END) AS suffix FROM caps WHERE host <> ''))),
best AS (SELECT page_id, k.url, fetched, count(*) AS n_active,
    max({{'size': length(h.key), 'block': h.kind = 'block', 'key': h.key,
         'kind': h.kind, 'since': h.since}}) AS b
  FROM keys k JOIN held h ON k.key = h.key AND h.since <= k.fetched
    AND (h.until IS NULL OR k.fetched < h.until) GROUP BY ALL)
SELECT c.page_id, c.url, c.host, c.fetched,
  coalesce(n_active, 0)::BIGINT AS n_active, b.key AS entry, b.kind AS kind,
  b.since AS since, coalesce(b.block, false) AS blocked
FROM caps c LEFT JOIN best ON c.page_id = best.page_id AND c.url = best.url
  AND c.fetched = best.fetched"""
