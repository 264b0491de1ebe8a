"""Queries over pages: captures and list entries are derived from the given pages, so that they grow
with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.llm import revisits, url_lists
from doctriage.llm.registry import query, table

HOST = r"//([^/]*)"


def header_map(**fields: Column | str) -> Column:
    """A map of the fields that are not null; underscores in names stand for hyphens."""
    pairs = []
    for name, value in fields.items():
        pairs += [F.lit(name.replace("_", "-")), F.lit(value) if isinstance(value, str) else value]
    return F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())


def page_captures(pages: DataFrame) -> DataFrame:
    """Three captures of every page: a full response, a revisit of its address written in another
    way (sometimes too early, sometimes with wrong or no validators), and one of its host's front
    page, every tenth of them in full."""
    page = F.col("page_id")
    number = lambda c: c.cast("string")
    rows = pages.select(
        "page_id",
        "url",
        F.regexp_extract("url", HOST, 1).alias("host"),
        F.md5("html").alias("body_md5"),
        F.octet_length("html").cast("long").alias("body_bytes"),
    )
    tag = F.concat(F.lit('"'), F.substring("body_md5", 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), number(page % 97))
    date = F.concat(F.lit("moment "), number(page))
    age = F.concat(F.lit("max-age="), number(page % 300))
    kind = page % 5
    first = rows.select(
        (page * 4).alias("capture_id"),
        "url",
        (page * 60).alias("second"),
        F.lit(200).alias("status"),
        header_map(
            ETag=tag,
            Last_Modified=day,
            Content_Type="text/html",
            Content_Length=number(F.col("body_bytes")),
            Cache_Control="max-age=60",
        ).alias("headers"),
        "body_md5",
        "body_bytes",
    )
    again = rows.select(
        (page * 4 + 1).alias("capture_id"),
        F.concat(
            F.lit("HTTPS://WWW."),
            F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"^https?://", ""),
            F.when(F.col("url").contains("?"), "&utm_medium=x#r").otherwise("?utm_medium=x#r"),
        ).alias("url"),
        (page * 60 + (page % 7 - 1) * 30).alias("second"),
        F.lit(304).alias("status"),
        header_map(
            etag=F.when(kind.isin(0, 4), F.concat(F.lit("W/"), tag)).when(kind == 2, '"other"'),
            Last_Modified=F.when(kind == 1, day),
            Vary=F.when(kind == 4, "accept"),
            Cache_Control=age,
            Content_Length="0",
            DATE=date,
        ).alias("headers"),
        F.lit(None).cast("string").alias("body_md5"),
        F.lit(None).cast("long").alias("body_bytes"),
    )
    full = page % 10 == 0
    version = F.floor((page - page % 10) / 30).cast("string")
    front = rows.select(
        (page * 4 + 2).alias("capture_id"),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/?utm_source=feed")).alias("url"),
        (page * 60 + 15).alias("second"),
        F.when(full, 200).otherwise(304).alias("status"),
        header_map(
            ETag=F.concat(F.lit('"v'), version, F.lit('"')),
            Date=date,
            Content_Type=F.when(full, "text/html"),
        ).alias("headers"),
        F.when(full, F.col("body_md5")).alias("body_md5"),
        F.when(full, F.col("body_bytes")).alias("body_bytes"),
    )
    captures = first.unionByName(again).unionByName(front)
    return captures.withColumn("fetched_at", F.timestamp_seconds("second")).drop("second")


def sql_canonical(url: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^[^/?]*')), ':(80|443)?$', ''), '^www[.]', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*(/[^?]*)?', 1), '/+$', '')"
    kept = f"""list_sort(list_filter(string_split(regexp_extract({bare}, '[?](.*)$', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)')))"""
    asked = f"(CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"
    return f"(CASE WHEN {host} <> '' THEN {host} || {path} || {asked} END)"


PERMITTED = ", ".join(f"'{name}'" for name in revisits.PERMITTED)


@query(
    f"""
WITH p AS (
    SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS host, md5(html) AS body_md5,
           CAST(strlen(html) AS BIGINT) AS body_bytes FROM pages
), captures AS (
    SELECT page_id * 4 AS capture_id, url, page_id * 60 AS moment, 200 AS status,
           ['etag="' || substr(body_md5, 1, 16) || '"', 'last-modified=day ' || (page_id % 97),
            'content-type=text/html', 'content-length=' || body_bytes, 'cache-control=max-age=60'] AS headers,
           '"' || substr(body_md5, 1, 16) || '"' AS tag, 'day ' || (page_id % 97) AS day,
           body_md5, body_bytes FROM p
    UNION ALL
    SELECT page_id * 4 + 1,
           'HTTPS://WWW.' || regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://', '')
             || CASE WHEN contains(url, '?') THEN '&utm_medium=x#r' ELSE '?utm_medium=x#r' END,
           page_id * 60 + (page_id % 7 - 1) * 30, 304,
           list_filter([
             CASE WHEN page_id % 5 IN (0, 4) THEN 'etag=W/"' || substr(body_md5, 1, 16) || '"'
                  WHEN page_id % 5 = 2 THEN 'etag="other"' END,
             CASE WHEN page_id % 5 = 1 THEN 'last-modified=day ' || (page_id % 97) END,
             CASE WHEN page_id % 5 = 4 THEN 'vary=accept' END,
             'cache-control=max-age=' || (page_id % 300), 'date=moment ' || page_id],
             lambda h: h IS NOT NULL),
           CASE WHEN page_id % 5 IN (0, 4) THEN '"' || substr(body_md5, 1, 16) || '"'
                WHEN page_id % 5 = 2 THEN '"other"' END,
           CASE WHEN page_id % 5 = 1 THEN 'day ' || (page_id % 97) END, NULL, NULL FROM p
    UNION ALL
    SELECT page_id * 4 + 2, 'https://' || host || '/?utm_source=feed', page_id * 60 + 15,
           CASE WHEN page_id % 10 = 0 THEN 200 ELSE 304 END,
           list_filter(['etag="v' || ((page_id - page_id % 10) // 30) || '"', 'date=moment ' || page_id,
             CASE WHEN page_id % 10 = 0 THEN 'content-type=text/html' END], lambda h: h IS NOT NULL),
           '"v' || ((page_id - page_id % 10) // 30) || '"', NULL, body_md5, body_bytes FROM p
), keyed AS (
    SELECT *, {sql_canonical('url')} AS key FROM captures
), found AS (
    SELECT r.capture_id, r.key AS url, r.headers, r.tag, r.day, f.capture_id AS f_id,
           f.headers AS f_headers, f.tag AS f_tag, f.day AS f_day, f.body_md5, f.body_bytes
    FROM keyed r LEFT JOIN keyed f ON f.status = 200 AND f.key = r.key AND f.moment < r.moment
    WHERE r.status = 304
    QUALIFY row_number() OVER (PARTITION BY r.capture_id ORDER BY f.moment DESC, f.capture_id DESC) = 1
), judged AS (
    SELECT *, CASE WHEN f_id IS NULL THEN 'no earlier response'
                   WHEN tag IS NULL AND day IS NULL THEN 'no validator'
                   WHEN tag IS NOT NULL AND tag = f_tag THEN 'resolved'
                   WHEN tag IS NULL AND day = f_day THEN 'resolved'
                   ELSE 'validator mismatch' END AS outcome,
           list_filter(headers, lambda h: split_part(h, '=', 1) IN ({PERMITTED})) AS fresh
    FROM found
)
SELECT capture_id, url, outcome,
       CASE WHEN outcome = 'resolved' THEN f_id END AS response_id,
       CASE WHEN outcome = 'resolved' THEN md5(array_to_string(list_sort(list_concat(fresh,
         list_filter(f_headers, lambda h: NOT list_contains(list_transform(fresh, lambda x: split_part(x, '=', 1)),
           split_part(h, '=', 1))))), chr(10))) END AS headers_md5,
       CASE WHEN outcome = 'resolved' THEN body_md5 END AS body_md5,
       CASE WHEN outcome = 'resolved' THEN body_bytes END AS body_bytes
FROM judged
"""
)
def op4_revisits(spark: SparkSession, folder: str) -> DataFrame:
    captures = page_captures(table(spark, folder, "pages"))
    resolved = revisits.resolve(captures)
    lines = F.transform(
        F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    digests = resolved.select(
        "capture_id",
        "url",
        "outcome",
        "response_id",
        F.md5(F.array_join(F.array_sort(lines), "\n")).alias("headers_md5"),
    )
    return revisits.with_payload(digests, captures, ["body_md5", "body_bytes"])


# The moments of list entries and fetches, in seconds.
SPAN = 1_000_003


def page_entries(pages: DataFrame) -> DataFrame:
    """One dated list entry from each page: its host, the domain above it or its first path prefix
    is added to or removed from one of two lists."""
    page = F.col("page_id")
    kind = page % 3
    host = F.regexp_extract("url", HOST, 1)
    bare = F.regexp_replace(host, r"^www\.", "")
    folder = F.regexp_extract("url", r"//[^/]*(/[^/?#]*)", 1)
    return pages.select(
        page.alias("entry_id"),
        F.concat(F.lit("list "), (page % 2).cast("string")).alias("list_name"),
        F.when(kind == 0, url_lists.HOST)
        .when(kind == 1, url_lists.DOMAIN)
        .otherwise(url_lists.PREFIX)
        .alias("kind"),
        F.when(kind == 0, bare)
        .when(kind == 1, F.regexp_extract(bare, r"[^.]*\.[^.]*\.[^.]*$", 0))
        .otherwise(F.concat(bare, folder))
        .alias("value"),
        F.when(F.floor(page / 3) % 4 == 0, "remove").otherwise("add").alias("action"),
        (page % 11 == 0).alias("allow"),
        F.concat(F.lit("class "), (page % 5).cast("string")).alias("category"),
        F.timestamp_seconds(page * 7919 % SPAN).alias("dated"),
    )


@query(
    f"""
WITH entries AS (
    SELECT page_id AS entry_id, 'list ' || (page_id % 2) AS list_name,
           CASE page_id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'domain' ELSE 'prefix' END AS kind,
           CASE page_id % 3 WHEN 0 THEN bare
                WHEN 1 THEN regexp_extract(bare, '[^.]*[.][^.]*[.][^.]*$')
                ELSE bare || regexp_extract(url, '//[^/]*(/[^/?#]*)', 1) END AS value,
           (page_id // 3) % 4 <> 0 AS adds, page_id % 11 = 0 AS allow,
           'class ' || (page_id % 5) AS category, page_id * 7919 % {SPAN} AS dated
    FROM (SELECT *, regexp_replace(regexp_extract(url, '//([^/]*)', 1), '^www[.]', '') AS bare FROM pages)
), held AS (
    SELECT *, lead(dated) OVER (PARTITION BY list_name, kind, value ORDER BY dated, entry_id) AS until
    FROM entries
), fetched AS (
    SELECT page_id AS capture_id, url, {sql_canonical('url')} AS key, page_id * 104729 % {SPAN} AS moment
    FROM pages
), split AS (
    SELECT *, regexp_extract(key, '^[^/?]*') AS host, regexp_extract(key, '^[^?]*') AS address FROM fetched
), covering AS (
    SELECT f.capture_id, e.*, CASE e.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END AS grade,
           CASE e.kind WHEN 'prefix' THEN len(string_split(e.value, '/')) - 1
                WHEN 'domain' THEN len(string_split(e.value, '.')) ELSE 0 END AS size
    FROM split f JOIN held e
      ON e.adds AND e.value <> '' AND e.dated <= f.moment AND (e.until IS NULL OR f.moment < e.until)
     AND CASE e.kind WHEN 'host' THEN f.host = e.value
              WHEN 'domain' THEN f.host = e.value OR ends_with(f.host, '.' || e.value)
              ELSE f.address = e.value OR starts_with(f.address, e.value || '/') END
), decided AS (
    SELECT *, count(*) OVER (PARTITION BY capture_id) AS active FROM covering
    QUALIFY row_number() OVER (PARTITION BY capture_id
      ORDER BY grade DESC, size DESC, NOT allow, list_name, kind, value, category) = 1
)
SELECT f.capture_id, f.url, f.moment AS fetched_second, coalesce(NOT d.allow, false) AS blocked,
       coalesce(d.active, 0) AS active, d.list_name, d.kind, d.value, d.category
FROM split f LEFT JOIN decided d USING (capture_id)
"""
)
def op6_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    captures = pages.select(
        F.col("page_id").alias("capture_id"),
        "url",
        F.timestamp_seconds(F.col("page_id") * 104729 % SPAN).alias("fetched_at"),
    )
    judged = url_lists.judge(captures, page_entries(pages))
    return judged.withColumn("fetched_second", F.unix_seconds("fetched_at")).drop("fetched_at")
