"""Scalar helper queries (F01–F21) applied to whole driver-table texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.conventions import AS_OF
from vigil.functions import dates as D
from vigil.functions import lookups as L
from vigil.functions import price as P
from vigil.functions import text as X
from vigil.plans.oracle_views import AS_OF as AS_OF_SQL
from vigil.plans.oracle_views import ts_text as ts_sql
from vigil.plans.oracle_views import with_views
from vigil.plans.registry import query, r6, ts_text
from vigil.sources import fixtures as fx

WS = r"'^\s+|\s+$'"


def _strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, {WS}, '', 'g')"


@query("strip_html", f"""
SELECT page_id, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS text_md5
FROM (SELECT page_id, {_strip_sql("regexp_replace(html, '<[^>]+>', '', 'g')")} AS s FROM pages)""")
def strip_html(spark, sf_dir):
    s = X.strip_html("html")
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", F.length(s).cast("bigint").alias("n_chars"), F.md5(s).alias("text_md5"))


@query("truncate_ellipsis", """
SELECT doc_id,
       md5(CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '…' ELSE text END) AS t120,
       md5(CASE WHEN length(text) > 280 THEN substring(text, 1, 280) || '…' ELSE text END) AS t280
FROM documents""")
def truncate_ellipsis(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(X.truncate_ellipsis("text", 120)).alias("t120"),
        F.md5(X.truncate_ellipsis("text", 280)).alias("t280"))


@query("truncate_hard", """
SELECT doc_id, substring(text, 1, 60) AS t60, md5(substring(text, 1, 300)) AS t300
FROM documents""")
def truncate_hard(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", X.truncate_hard("text", 60).alias("t60"),
        F.md5(X.truncate_hard("text", 300)).alias("t300"))


@query("author_line", f"""
SELECT doc_id, array_to_string(list_slice(l, 1, 3), ', ')
         || CASE WHEN len(l) > 3 THEN ' et al.' ELSE '' END AS authors,
       CAST(len(l) AS BIGINT) AS n_names
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ';'),
                                 lambda x: {_strip_sql('x')}), lambda x: x <> '') AS l
      FROM documents)""")
def author_line(spark, sf_dir):
    names = X.split_names("text", ";")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", X.author_line(names).alias("authors"),
        F.size(names).cast("bigint").alias("n_names"))


@query("absolute_url", """
SELECT page_id, CAST(pos AS BIGINT) AS pos,
       CASE WHEN starts_with(href, 'http') THEN href ELSE base || href END AS abs_url
FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS base,
             unnest(h) AS href, unnest(generate_series(1, len(h))) AS pos
      FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h
            FROM pages))""")
def absolute_url(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return (pages.select("page_id", F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("base"),
                         F.posexplode(hrefs).alias("p", "href"))
            .select("page_id", (F.col("p") + 1).cast("bigint").alias("pos"),
                    X.absolute_url("href", F.col("base")).alias("abs_url")))


TERMS = ["data", "the", "und"]


@query("term_filter", """
SELECT doc_id, lang,
       list_bool_or(list_transform(['data', 'the', 'und'],
                                   lambda t: contains(lower(text), lower(t)))) AS matched
FROM documents""")
def term_filter(spark, sf_dir):
    terms = F.array(*[F.lit(t) for t in TERMS])
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", X.term_filter("text", terms).alias("matched"))


@query("html_escape", """
SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'),
                   '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5
FROM documents""")
def html_escape(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(X.html_escape("text")).alias("escaped_md5"))


def _icon_sql(expr: str) -> str:
    whens = " ".join(f"WHEN contains(lower({expr}), '{k}') THEN '{v}'" for k, v in L.TOPIC_ICONS)
    return f"CASE {whens} ELSE '{L.TOPIC_ICON_DEFAULT}' END"


@query("topic_icon", f"""
SELECT p_partkey, {_icon_sql('p_name')} AS icon FROM part""")
def topic_icon(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", L.topic_icon("p_name").alias("icon"))


@query("score_band", with_views("fx_items") + """
SELECT event_id,
       CASE WHEN novelty_score IS NULL THEN 'muted' WHEN novelty_score >= 0.75 THEN 'green'
            WHEN novelty_score >= 0.55 THEN 'yellow' ELSE 'red' END AS band,
       CASE WHEN novelty_score >= 0.9 THEN 'green' WHEN novelty_score >= 0.8 THEN 'yellow' END AS dot
FROM fx_items""")
def score_band(spark, sf_dir):
    return fx.fx_items(spark, sf_dir).select(
        "event_id", L.score_band("novelty_score").alias("band"),
        L.novelty_dot("novelty_score").alias("dot"))


@query("novelty_dot", with_views("fx_over") + """
SELECT event_id, CASE WHEN novelty_score >= 0.9 THEN 'green'
                      WHEN novelty_score >= 0.8 THEN 'yellow' END AS dot
FROM fx_over""")
def novelty_dot(spark, sf_dir):
    idx = fx.fx_over(spark, sf_dir)
    return idx.select("event_id", L.novelty_dot("novelty_score").alias("dot"))


@query("relative_time", with_views("fx_items") + f"""
SELECT event_id,
       CASE WHEN secs < 3600 THEN CAST(CAST(floor(secs / 60) AS BIGINT) AS VARCHAR) || 'm ago'
            WHEN secs <= 172800 THEN CAST(CAST(floor(secs / 3600) AS BIGINT) AS VARCHAR) || 'h ago'
            ELSE strftime(fetched_at, '%b %-d') END AS rel
FROM (SELECT event_id, fetched_at,
             CAST(floor(epoch({AS_OF_SQL})) AS BIGINT)
               - CAST(floor(epoch(fetched_at)) AS BIGINT) AS secs
      FROM fx_items)""")
def relative_time(spark, sf_dir):
    return fx.fx_items(spark, sf_dir).select(
        "event_id", D.relative_time("fetched_at", AS_OF).alias("rel"))


# --- dates -------------------------------------------------------------------
def _iso_in_spark(e, ts):
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return (F.when(e % 17 == 0, F.lit("not-a-date"))
            .when(e % 3 == 0, F.concat(base, F.lit("Z")))
            .when(e % 3 == 1, F.concat(base, F.lit("+0000")))
            .otherwise(F.concat(base, F.lit("+02:00"))))


_ISO_SQL = """CASE WHEN event_id % 17 = 0 THEN 'not-a-date'
     WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
     WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000'
     ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' END"""


@query("parse_iso", f"""
SELECT event_id, raw,
       {ts_sql(f"COALESCE(TRY_CAST(raw AS TIMESTAMPTZ) AT TIME ZONE 'UTC', {AS_OF_SQL})")} AS parsed
FROM (SELECT event_id, {_ISO_SQL} AS raw FROM events)""")
def parse_iso(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    raw = _iso_in_spark(F.col("event_id"), F.col("ts"))
    return ev.select("event_id", raw.alias("raw")).select(
        "event_id", "raw", ts_text(D.parse_iso("raw", AS_OF)).alias("parsed"))


@query("parse_compact_date", f"""
SELECT event_id, raw,
       {ts_sql(f"COALESCE(try_strptime(raw, '%Y%m%dT%H%M%SZ'), {AS_OF_SQL})")} AS parsed
FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN strftime(ts, '%Y-%m-%d')
                            ELSE strftime(ts, '%Y%m%dT%H%M%SZ') END AS raw FROM events)""")
def parse_compact_date(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 13 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    return (fx.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
            .select("event_id", "raw", ts_text(D.parse_compact_date("raw", AS_OF)).alias("parsed")))


_PUB_SQL = """CASE WHEN o_orderkey % 11 = 0 THEN 'n/a'
     WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y')
     WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y %b')
     WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y %b %-d')
     WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y') || ' Xyz ' || strftime(o_orderdate, '%-d')
     ELSE strftime(o_orderdate, '%Y') || ' Feb 30' END"""


@query("parse_pubmed_date", f"""
SELECT o_orderkey, raw,
       {ts_sql(f'''COALESCE(CASE WHEN y IS NOT NULL AND d IS NOT NULL AND y BETWEEN 1 AND 9999
                 AND d >= 1 THEN TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) END,
                 {AS_OF_SQL})''')} AS parsed
FROM (SELECT o_orderkey, raw, TRY_CAST(p[1] AS INTEGER) AS y,
             CASE WHEN len(p) > 1 THEN COALESCE(
               CASE lower(substring(p[2], 1, 3)) WHEN 'jan' THEN 1 WHEN 'feb' THEN 2
                 WHEN 'mar' THEN 3 WHEN 'apr' THEN 4 WHEN 'may' THEN 5 WHEN 'jun' THEN 6
                 WHEN 'jul' THEN 7 WHEN 'aug' THEN 8 WHEN 'sep' THEN 9 WHEN 'oct' THEN 10
                 WHEN 'nov' THEN 11 WHEN 'dec' THEN 12 END, 1) ELSE 1 END AS m,
             CASE WHEN len(p) > 2 THEN TRY_CAST(p[3] AS INTEGER) ELSE 1 END AS d
      FROM (SELECT o_orderkey, raw, regexp_split_to_array({_strip_sql('raw')}, '\\s+') AS p
            FROM (SELECT o_orderkey, {_PUB_SQL} AS raw FROM orders)))""")
def parse_pubmed_date(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (F.when(k % 11 == 0, F.lit("n/a"))
           .when(k % 5 == 0, F.date_format(d, "yyyy"))
           .when(k % 5 == 1, F.date_format(d, "yyyy MMM"))
           .when(k % 5 == 2, F.date_format(d, "yyyy MMM d"))
           .when(k % 5 == 3, F.concat(F.date_format(d, "yyyy"), F.lit(" Xyz "), F.date_format(d, "d")))
           .otherwise(F.concat(F.date_format(d, "yyyy"), F.lit(" Feb 30"))))
    return (fx.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
            .select("o_orderkey", "raw", ts_text(D.parse_pubmed_date("raw", AS_OF)).alias("parsed")))


@query("parse_feed_date", f"""
SELECT event_id, raw,
       {ts_sql('''COALESCE(try_strptime(regexp_replace(raw, '^[A-Za-z]{3},\\s*', ''),
                                        '%d %b %Y %H:%M:%S GMT'),
                           try_strptime(regexp_replace(raw, '^[A-Za-z]{3},\\s*', ''),
                                        '%d %b %Y %H:%M:%S %z') AT TIME ZONE 'UTC')''')} AS parsed
FROM (SELECT event_id,
             CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
                  ELSE strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0200' END AS raw
      FROM events)""")
def parse_feed_date(spark, sf_dir):
    e = F.col("event_id")
    base = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    raw = F.when(e % 2 == 0, F.concat(base, F.lit(" GMT"))).otherwise(F.concat(base, F.lit(" +0200")))
    return (fx.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
            .select("event_id", "raw", ts_text(D.parse_feed_date("raw")).alias("parsed")))


# --- lookups -------------------------------------------------------------------
def _weather_sql(expr: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in L.WEATHER_CODES.items())
    return f"CASE {expr} {whens} ELSE 'weather code ' || CAST({expr} AS VARCHAR) END"


@query("weather_code_lookup", f"""
SELECT event_id, code, description,
       code IN ({', '.join(str(c) for c in L.NOTABLE_CODES)}) AS notable,
       upper(substring(description, 1, 1)) || substring(description, 2) AS label
FROM (SELECT event_id, code, {_weather_sql('code')} AS description
      FROM (SELECT event_id, CAST(CAST(floor(value) AS BIGINT) % 100 AS INTEGER) AS code
            FROM events))""")
def weather_code_lookup(spark, sf_dir):
    code = (F.floor("value").cast("bigint") % 100).cast("int")
    ev = fx.table(spark, sf_dir, "events").select("event_id", code.alias("code"))
    desc = L.weather_text("code")
    return ev.select("event_id", "code", desc.alias("description"),
                     L.weather_notable("code").alias("notable"),
                     L.capitalize_first(desc).alias("label"))


# --- prices ------------------------------------------------------------------
def fx_shop(spark, sf_dir):
    k = F.col("o_orderkey")
    amount = F.round(F.col("o_totalprice") * 100).cast("bigint")
    null_price = k % 9 == 0
    return fx.table(spark, sf_dir, "orders").select(
        k.alias("item_id"),
        F.when(~null_price, amount).alias("amount"),
        F.lit(100).cast("bigint").alias("divisor"),
        fx.pick(["USD", "EUR", "GBP"], k % 3).alias("currency"))


_SHOP_SQL = """SELECT o_orderkey AS item_id,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS amount,
       CAST(100 AS BIGINT) AS divisor,
       ['USD', 'EUR', 'GBP'][o_orderkey % 3 + 1] AS currency
FROM orders"""


@query("price_text", with_views(extra=[("shop", _SHOP_SQL)]) + """
SELECT item_id,
       CASE WHEN amount IS NULL THEN NULL ELSE '$' || CAST(CAST((amount - amount % 100) / 100 AS BIGINT) AS VARCHAR)
            || '.' || lpad(CAST(amount % 100 AS VARCHAR), 2, '0') || ' ' || currency END AS ebay_text,
       '$' || printf('%.2f', CAST(amount AS DOUBLE) / CAST(divisor AS DOUBLE)) || ' ' || currency AS etsy_text,
       '$' || printf('%.2f', CAST(amount AS DOUBLE) / 100.0) AS grailed_text,
       '¥' || format('{:,}', amount) AS yen_text
FROM shop""".replace("WITH \n", "WITH "))
def price_text(spark, sf_dir):
    s = fx_shop(spark, sf_dir)
    a = F.col("amount")
    value = F.concat(((a - a % 100) / 100).cast("bigint").cast("string"), F.lit("."),
                     F.lpad((a % 100).cast("string"), 2, "0"))
    return s.select(
        "item_id",
        P.price_value_ccy(F.when(a.isNotNull(), value), F.col("currency")).alias("ebay_text"),
        P.price_ratio("amount", "divisor", "currency").alias("etsy_text"),
        P.price_dollars(a.cast("double") / 100.0).alias("grailed_text"),
        P.price_yen(a).alias("yen_text"))


@query("salary_suffix", """
SELECT p_partkey, CASE WHEN lo IS NOT NULL AND lo <> 0 AND hi IS NOT NULL AND hi <> 0
                       THEN ' · $' || format('{:,.0f}', lo) || '–$' || format('{:,.0f}', hi)
                       WHEN lo IS NOT NULL AND lo <> 0 THEN ' · $' || format('{:,.0f}', lo) || '+'
                       ELSE '' END AS salary
FROM (SELECT p_partkey,
             CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE CAST(p_size * 1000 AS DOUBLE) END AS lo,
             CASE p_partkey % 4 WHEN 2 THEN 0.0 WHEN 3 THEN NULL ELSE CAST(p_size * 1500 + 500 AS DOUBLE) END AS hi
      FROM part)""")
def salary_suffix(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    lo = (F.when(k % 4 == 0, F.lit(None).cast("double")).when(k % 4 == 1, F.lit(0.0))
          .otherwise((size * 1000).cast("double")))
    hi = (F.when(k % 4 == 2, F.lit(0.0)).when(k % 4 == 3, F.lit(None).cast("double"))
          .otherwise((size * 1500 + 500).cast("double")))
    return fx.table(spark, sf_dir, "part").select("p_partkey", P.salary_suffix(lo, hi).alias("salary"))
