"""URL filters: a temporal join of captures with dated list entries.

Dated list events (an entry is added or removed on a day) become validity intervals [valid_from,
valid_until). A capture has one key for its host, one for each domain above it and one for each path prefix; an
as-of join evaluates every capture against the entries that were active when it was fetched: the distinct days
on which a key is asked for are merged with the spans of the key's entries in order of time, and the span that began last
is carried forward.
The most specific active entry decides (longest key, a host before a domain of equal length); among lists
that hold the same key an allow entry wins, then the interval that began last.

Native DataFrame work. Captures are reduced to distinct (url, day), and to distinct (key, day) before the as-of
join, so a hot host has no more rows there than days; where its answers meet its URLs it is a skewed
join key with one answer a day, which Spark splits. Only URL and id are read of the pages.

Defined results: a null or unparsable URL has no keys and the decision "none", as has a null day; adding
an active entry again or removing an inactive one changes nothing; events of one entry, list and day are
one event, the removal counts; repeated captures are each returned; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigia.llm.common import table

START, DAYS = "2024-01-01", 365


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    at = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(at, r"\.+$", ""), F.lit(""))


def path(url: Column) -> Column:
    """Path without query and fragment, without its leading slash."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^?#]*)", 1)


def keys(url: Column) -> Column:
    """array<struct<kind, key>>: the host, every domain of at least two labels, every path prefix of whole segments."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, k, n), ".").alias("key")))
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda k: k > 0), lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(h, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")).alias("key")))
    return F.when(h.isNotNull(), F.concat(F.array(F.struct(F.lit("host").alias("kind"), h.alias("key"))), domains, prefixes))


def validity(events: DataFrame) -> DataFrame:
    """(list, kind, key, action, valid_from, valid_until) of events (list, kind, key, action, day, added)."""
    per_day = events.groupBy("list", "kind", "key", "action", "day").agg(F.min("added").alias("added"))
    w = Window.partitionBy("list", "kind", "key", "action").orderBy("day")
    changes = per_day.withColumn("was", F.lag("added").over(w)).filter(F.col("added") != F.coalesce("was", F.lit(False)))
    spans = changes.select("list", "kind", "key", "action", "added", F.col("day").alias("valid_from"), F.lead("day").over(w).alias("valid_until"))
    return spans.filter("added").drop("added")


def as_of(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """(list, kind, key, action, d, valid_from) of the ``spans`` that are valid on the days of ``asked`` (kind, key, d).

    Days and spans of one entry are put in order and the last span that has begun is carried forward, so no day
    meets the whole history of its key: it meets each entry of the key (one a list and action) once.
    """
    entries = spans.select("kind", "key", "list", "action").distinct()
    days = asked.join(entries, ["kind", "key"]).select("list", "kind", "key", "action", F.col("d").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("struct<valid_from:date,valid_until:date>").alias("span"))
    begun = spans.select("list", "kind", "key", "action", F.col("valid_from").alias("at"), F.lit(0).alias("asks"), F.struct("valid_from", "valid_until").alias("span"))
    w = Window.partitionBy("list", "kind", "key", "action").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = begun.unionByName(days).withColumn("span", F.last("span", ignorenulls=True).over(w))
    valid = carried.filter("asks = 1 AND span IS NOT NULL AND (span.valid_until IS NULL OR at < span.valid_until)")
    return valid.select("list", "kind", "key", "action", F.col("at").alias("d"), "span.valid_from")


def decide(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """``captures`` with decision (allow, block, none), list, kind, key and valid_from of the deciding entry.

    Own columns of those five names are replaced; other columns stay.
    """
    seen = captures.select(F.col(url).alias("u"), F.col(day).alias("d")).filter("u IS NOT NULL AND d IS NOT NULL").distinct()
    asked = seen.withColumn("k", F.explode(keys(F.col("u")))).select("u", "d", "k.kind", "k.key")
    active = as_of(asked.select("kind", "key", "d").distinct(), validity(events))
    rank = F.struct(F.length("key").alias("size"), (F.col("kind") == "host").alias("exact"), (F.col("action") == "allow").alias("allow"), "valid_from", "list", "kind", "key", "action")
    by_key = active.groupBy("kind", "key", "d").agg(F.max(rank).alias("b"))
    best = asked.join(by_key, ["kind", "key", "d"]).groupBy("u", "d").agg(F.max("b").alias("b"))
    made = {"decision": F.coalesce("b.action", F.lit("none")), **{c: F.col(f"b.{c}") for c in ("list", "kind", "key", "valid_from")}}
    inner = captures.toDF(*(f"_{k}" for k in range(len(captures.columns))))
    at = {c: F.col(f"_{k}") for k, c in enumerate(captures.columns)}
    out = inner.join(best, (at[url] == F.col("u")) & (at[day] == F.col("d")), "left")
    return out.select(*(x.alias(c) for c, x in at.items() if c not in made), *(x.alias(c) for c, x in made.items()))


def _number(text: Column, of: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % of


def _later(name: str, key: Column, days: int = DAYS) -> Column:
    return _number(F.concat(F.lit(name), key), days).cast("int")


def list_history(pages: DataFrame) -> DataFrame:
    """Dated events for the hosts, domains and sections that the pages have (the given tables hold no lists)."""
    h = pages.select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p")).filter("h IS NOT NULL").distinct()
    start = F.lit(START).cast("date")

    def event(list_name, kind, action, day, added, key="key"):
        return F.struct(F.lit(list_name).alias("list"), F.lit(kind).alias("kind"), F.col(key).alias("key"), F.lit(action).alias("action"), F.date_add(start, day).alias("day"), F.lit(added).alias("added"))

    domain = h.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("key")).filter("key != ''").distinct().filter(_number(F.col("key"), 3) < 2)
    a = _later("a", F.col("key"))
    blocked = domain.select(F.explode(F.array(event("abuse", "domain", "block", a, True), event("abuse", "domain", "block", a + 60, False), event("abuse", "domain", "block", a + 150, True))).alias("e"))
    exact = h.select(F.col("h").alias("key")).distinct().filter(_number(F.concat(F.lit("h"), F.col("key")), 5) == 0)
    allowed = exact.select(event("trusted", "host", "allow", _later("t", F.col("key")), True).alias("e"))
    section = h.select(F.concat("h", F.lit("/"), F.split("p", "/")[0]).alias("key")).filter("NOT endswith(key, '/')").distinct().filter(_number(F.concat(F.lit("p"), F.col("key")), 4) == 0)
    b = _later("s", F.col("key"))
    parts = section.select(F.explode(F.array(event("sections", "prefix", "block", b, True), event("sections", "prefix", "block", b + 90, False))).alias("e"))
    return blocked.unionByName(allowed).unionByName(parts).select("e.*")


def op3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit(START).cast("date"), _number(F.concat(F.lit("fetch"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), DAYS + 200).cast("int"))
    return decide(pages.withColumn("fetched", day), list_history(pages)).drop("url")


def _sql_number(text: str, of: int) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {of})"


def _sql_day(number: str) -> str:
    return f"(DATE '{START}' + CAST({number} AS INTEGER))"


_HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^?#]*)', 1)"
_A, _B = _sql_number("'a' || key", DAYS), _sql_number("'s' || key", DAYS)

ORACLE = f"""
WITH c AS (SELECT page_id, url, {_HOST} AS h, {_PATH} AS p,
                  {_sql_day(_sql_number("'fetch' || coalesce(CAST(page_id AS VARCHAR), '')", DAYS + 200))} AS fetched FROM pages),
domain AS (SELECT DISTINCT regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AS key FROM c WHERE h IS NOT NULL),
section AS (SELECT DISTINCT h || '/' || split_part(p, '/', 1) AS key FROM c WHERE h IS NOT NULL),
spans AS (
  SELECT 'abuse' AS list, 'domain' AS kind, key, 'block' AS action, {_sql_day(_A + ' + o')} AS valid_from,
         CASE WHEN o = 0 THEN {_sql_day(_A + ' + 60')} END AS valid_until
  FROM domain, (VALUES (0), (150)) t(o) WHERE key != '' AND {_sql_number('key', 3)} < 2
  UNION ALL SELECT 'trusted', 'host', key, 'allow', {_sql_day(_sql_number("'t' || key", DAYS))}, NULL
  FROM (SELECT DISTINCT h AS key FROM c WHERE h IS NOT NULL) WHERE {_sql_number("'h' || key", 5)} = 0
  UNION ALL SELECT 'sections', 'prefix', key, 'block', {_sql_day(_B)}, {_sql_day(_B + ' + 90')}
  FROM section WHERE key NOT LIKE '%/' AND {_sql_number("'p' || key", 4)} = 0),
hits AS (
  SELECT c.page_id, c.url, c.fetched, s.*, row_number() OVER (PARTITION BY c.url, c.fetched ORDER BY length(s.key) DESC,
         s.kind = 'host' DESC, s.action = 'allow' DESC, s.valid_from DESC, s.list DESC, s.kind DESC, s.key DESC, s.action DESC) AS rn
  FROM (SELECT DISTINCT NULL AS page_id, url, fetched, h, p FROM c) c JOIN spans s
    ON (s.kind = 'host' AND s.key = c.h) OR (s.kind = 'domain' AND (c.h = s.key OR c.h LIKE '%.' || s.key))
    OR (s.kind = 'prefix' AND (c.h || '/' || c.p || '/') LIKE s.key || '/%')
  WHERE s.valid_from <= c.fetched AND (s.valid_until IS NULL OR c.fetched < s.valid_until))
SELECT c.page_id, c.fetched, coalesce(x.action, 'none') AS decision, x.list, x.kind, x.key, x.valid_from
FROM c LEFT JOIN hits x ON x.rn = 1 AND x.url = c.url AND x.fetched = c.fetched
"""
