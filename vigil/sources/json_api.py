"""JSON-API normalisers (S01–S12): landed payload → results rows.

Each normaliser is a pure projection: ``from_json`` with the API's schema,
``posexplode`` of the item array, then column expressions.  No network and
no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.conventions import AS_OF
from vigil.functions.dates import parse_compact_date, parse_iso
from vigil.functions.price import price_dollars, price_ratio, price_value_ccy, price_yen
from vigil.functions.text import strip_html, truncate_ellipsis, truncate_hard
from vigil.sources.landing import explode_items

# Item URL builders of sources whose payload lacks a URL.
HN_ITEM_URL = "https://news.ycombinator.com/item?id="
YOUTUBE_URL = "https://www.youtube.com/watch?v="
GRAILED_URL = "https://www.grailed.com/listings/"
MERCARI_URL = "https://jp.mercari.com/item/"
MASTODON_DEFAULT_INSTANCE = "mastodon.social"

SCHEMAS = {
    "gdelt": "articles ARRAY<STRUCT<url STRING, title STRING, domain STRING, seendate STRING>>",
    "guardian": ("response STRUCT<status STRING, results ARRAY<STRUCT<webTitle STRING, "
                 "webUrl STRING, webPublicationDate STRING, sectionName STRING, "
                 "fields STRUCT<trailText STRING>>>>"),
    "nytimes": ("response STRUCT<docs ARRAY<STRUCT<headline STRUCT<main STRING>, "
                "abstract STRING, web_url STRING, pub_date STRING, section_name STRING>>>"),
    "newsapi": ("articles ARRAY<STRUCT<source STRUCT<name STRING>, title STRING, "
                "description STRING, url STRING, publishedAt STRING>>"),
    "hacker_news": ("hits ARRAY<STRUCT<objectID STRING, title STRING, url STRING, "
                    "created_at STRING, story_text STRING>>"),
    "mastodon": ("statuses ARRAY<STRUCT<id STRING, url STRING, content STRING, "
                 "created_at STRING, account STRUCT<acct STRING>>>"),
    "youtube": ("items ARRAY<STRUCT<id STRUCT<videoId STRING>, snippet STRUCT<title STRING, "
                "description STRING, channelTitle STRING, publishedAt STRING>>>"),
    "ebay": ("itemSummaries ARRAY<STRUCT<itemId STRING, title STRING, itemWebUrl STRING, "
             "shortDescription STRING, price STRUCT<value STRING, currency STRING>>>"),
    "etsy": ("results ARRAY<STRUCT<listing_id BIGINT, title STRING, url STRING, "
             "description STRING, price STRUCT<amount BIGINT, divisor BIGINT, "
             "currency_code STRING>>>"),
    "grailed": ("ARRAY<STRUCT<id BIGINT, title STRING, price DOUBLE, slug STRING, "
                "designer_names ARRAY<STRING>>>"),
    "mercari": "items ARRAY<STRUCT<id STRING, name STRING, price STRING, status STRING>>",
}

SOURCE_TYPES = {"gdelt": "news", "guardian": "news", "nytimes": "news", "newsapi": "news",
                "hacker_news": "social", "mastodon": "social", "youtube": "video",
                "ebay": "shopping", "etsy": "shopping", "grailed": "shopping",
                "mercari": "shopping"}

RESULT_COLUMNS = ["payload_id", "run_id", "topic_name", "source_ord", "item_pos", "url", "title",
                  "snippet", "source", "source_type", "fetched_at", "published_at", "price"]


def _s(c: Column) -> Column:
    """Missing text field → ``""`` (the payload default)."""
    return F.coalesce(c, F.lit(""))


def _parsed(landed: DataFrame, source: str) -> Column:
    return F.from_json(F.col("body"), SCHEMAS[source], {"mode": "PERMISSIVE"})


def _results(df: DataFrame, source: str, *, url: Column, title: Column, snippet: Column,
             label: Column | None = None, fetched_at: Column, published_at: Column | None = None,
             price: Column | None = None) -> DataFrame:
    return df.select(
        "payload_id", "run_id", "topic_name", "source_ord", "item_pos",
        url.alias("url"), title.alias("title"), snippet.alias("snippet"),
        (label if label is not None else F.lit(source)).alias("source"),
        F.lit(SOURCE_TYPES[source]).alias("source_type"),
        fetched_at.alias("fetched_at"),
        (published_at if published_at is not None else F.lit(None).cast("timestamp"))
        .alias("published_at"),
        (price if price is not None else F.lit(None).cast("string")).alias("price"))


def _section_label(name: str, section: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "",
                  F.concat(F.lit(name + ":"), section)).otherwise(F.lit(name))


def _now(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


# S01
def normalise_gdelt(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "gdelt"), lambda p: p["articles"])
    return _results(df, "gdelt", url=_s(it["url"]), title=_s(it["title"]),
                    snippet=_s(it["domain"]),
                    fetched_at=parse_compact_date(it["seendate"], as_of))


# S02
def normalise_guardian(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "guardian"), lambda p: p["response"]["results"])
    return _results(df, "guardian", url=_s(it["webUrl"]), title=_s(it["webTitle"]),
                    snippet=_s(it["fields"]["trailText"]),
                    label=_section_label("guardian", it["sectionName"]),
                    fetched_at=parse_iso(it["webPublicationDate"], as_of))


# S03
def normalise_nytimes(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "nytimes"), lambda p: p["response"]["docs"])
    return _results(df, "nytimes", url=_s(it["web_url"]), title=_s(it["headline"]["main"]),
                    snippet=_s(it["abstract"]),
                    label=_section_label("nytimes", it["section_name"]),
                    fetched_at=parse_iso(it["pub_date"], as_of))


# S04
def normalise_newsapi(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "newsapi"), lambda p: p["articles"])
    name = F.coalesce(it["source"]["name"], F.lit("newsapi"))
    return _results(df, "newsapi", url=_s(it["url"]), title=_s(it["title"]),
                    snippet=_s(it["description"]), label=F.concat(F.lit("newsapi:"), name),
                    fetched_at=parse_iso(it["publishedAt"], as_of))


# S05
def normalise_hacker_news(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "hacker_news"), lambda p: p["hits"])
    url = F.coalesce(F.nullif(it["url"], F.lit("")),
                     F.concat(F.lit(HN_ITEM_URL), _s(it["objectID"])))
    return _results(df, "hacker_news", url=url, title=_s(it["title"]),
                    snippet=_s(it["story_text"]), fetched_at=parse_iso(it["created_at"], as_of))


# S06
def normalise_mastodon(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "mastodon"), lambda p: p["statuses"])
    instance = F.coalesce(F.try_element_at(F.col("filters"), F.lit("instance")),
                          F.lit(MASTODON_DEFAULT_INSTANCE))
    df = df.withColumn("_text", strip_html(_s(it["content"]), ""))
    acct = _s(it["account"]["acct"])
    text = F.col("_text")
    return _results(df, "mastodon", url=_s(it["url"]), title=truncate_ellipsis(text, 120),
                    snippet=F.when(acct != "", F.concat(F.lit("@"), acct, F.lit(": "), text))
                    .otherwise(text),
                    label=F.concat(F.lit("mastodon:"), instance),
                    fetched_at=parse_iso(it["created_at"], as_of))


# S08
def normalise_youtube(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "youtube"), lambda p: p["items"])
    sn = it["snippet"]
    return _results(df, "youtube", url=F.concat(F.lit(YOUTUBE_URL), _s(it["id"]["videoId"])),
                    title=_s(sn["title"]), snippet=_s(sn["description"]),
                    fetched_at=parse_iso(sn["publishedAt"], as_of))


# S09
def normalise_ebay(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """Items lacking the required url or title are left out (see
    :func:`rejects`)."""
    it = F.col("it")
    df = (explode_items(landed, _parsed(landed, "ebay"), lambda p: p["itemSummaries"])
          .where(it["itemWebUrl"].isNotNull() & it["title"].isNotNull()))
    price = F.when(it["price"].isNotNull(),
                   price_value_ccy(it["price"]["value"], it["price"]["currency"]))
    return _results(df, "ebay", url=it["itemWebUrl"], title=it["title"],
                    snippet=_s(it["shortDescription"]), fetched_at=_now(as_of), price=price)


def rejects(landed: DataFrame, source: str) -> DataFrame:
    """The items of a marketplace that lack their url or title."""
    items, url = {"ebay": ("itemSummaries", "itemWebUrl"), "etsy": ("results", "url")}[source]
    it = F.col("it")
    return (explode_items(landed, _parsed(landed, source), lambda p: p[items])
            .where(it[url].isNull() | it["title"].isNull())
            .select("payload_id", "item_pos", it[url].alias("url")))


# S10
def normalise_etsy(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = (explode_items(landed, _parsed(landed, "etsy"), lambda p: p["results"])
          .where(it["url"].isNotNull() & it["title"].isNotNull()))
    p = it["price"]
    price = F.when(p.isNotNull(), price_ratio(p["amount"], p["divisor"], p["currency_code"]))
    return _results(df, "etsy", url=it["url"], title=it["title"],
                    snippet=truncate_hard(_s(it["description"]), 200), fetched_at=_now(as_of),
                    price=price)


# S11
def normalise_grailed(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "grailed"), lambda p: p)
    designers = F.coalesce(it["designer_names"], F.array().cast("array<string>"))
    return _results(df, "grailed", url=F.concat(F.lit(GRAILED_URL), _s(it["id"].cast("string"))),
                    title=_s(it["title"]), snippet=F.array_join(designers, ", "),
                    fetched_at=_now(as_of), price=price_dollars(it["price"]))


# S12
def normalise_mercari(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """A failed payload discards every row of its (run, topic, source)."""
    it = F.col("it")
    failed = (landed.where(F.col("status") != "ok")
              .select("run_id", "topic_name", "source_ord").distinct())
    ok = landed.join(failed, ["run_id", "topic_name", "source_ord"], "left_anti")
    df = explode_items(ok, _parsed(ok, "mercari"), lambda p: p["items"])
    price = F.when(it["price"].isNotNull(), price_yen(it["price"]))
    return _results(df, "mercari", url=F.concat(F.lit(MERCARI_URL), _s(it["id"])),
                    title=_s(it["name"]), snippet=F.lit(""), fetched_at=_now(as_of), price=price)


NORMALISERS = {
    "gdelt": normalise_gdelt, "guardian": normalise_guardian, "nytimes": normalise_nytimes,
    "newsapi": normalise_newsapi, "hacker_news": normalise_hacker_news,
    "mastodon": normalise_mastodon, "youtube": normalise_youtube, "ebay": normalise_ebay,
    "etsy": normalise_etsy, "grailed": normalise_grailed, "mercari": normalise_mercari,
}


# --- weather and papers ---------------------------------------------------------
from vigil.functions.lookups import NOTABLE_CODES, capitalize_first, weather_text  # noqa: E402
from vigil.functions.text import author_line, strip_ws  # noqa: E402

# The forecast page and the paper page of a paper id.
WEATHER_URL = "https://open-meteo.com"
S2_PAPER_URL = "https://www.semanticscholar.org/paper/"

SCHEMAS.update({
    "weather": ("daily STRUCT<time ARRAY<STRING>, weathercode ARRAY<INT>, "
                "temperature_2m_max ARRAY<DOUBLE>, precipitation_sum ARRAY<DOUBLE>>, "
                "daily_units STRUCT<temperature_2m_max STRING, precipitation_sum STRING>"),
    "semantic_scholar": ("data ARRAY<STRUCT<paperId STRING, title STRING, abstract STRING, "
                         "authors ARRAY<STRUCT<name STRING>>, year INT, url STRING>>"),
})
SOURCE_TYPES.update({"weather": "weather", "open_meteo": "weather",
                     "semantic_scholar": "science"})


# S15
def normalise_weather(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """Zip the daily arrays (to the shortest); keep notable codes unless ``notable_only=false``."""
    p = F.from_json(F.col("body"), SCHEMAS["weather"], {"mode": "PERMISSIVE"})
    d = p["daily"]
    shortest = F.least(*(F.coalesce(F.size(d[c]), F.lit(0)) for c in (
        "time", "weathercode", "temperature_2m_max", "precipitation_sum")))
    zipped = F.slice(F.arrays_zip(
        d["time"].alias("time"), d["weathercode"].alias("code"),
        d["temperature_2m_max"].alias("temp"), d["precipitation_sum"].alias("rain")),
        F.lit(1), F.greatest(shortest, F.lit(0)))
    df = (landed.withColumn("_p", p)
          .select("*", F.posexplode_outer(zipped).alias("item_pos", "it"))
          .where(F.col("it").isNotNull()))
    it = F.col("it")
    notable_only = F.coalesce(F.lower(F.try_element_at(F.col("filters"), F.lit("notable_only"))),
                              F.lit("true")) != "false"
    has_place = (F.try_element_at(F.col("filters"), F.lit("lat")).isNotNull()
                 & F.try_element_at(F.col("filters"), F.lit("lon")).isNotNull())
    df = df.where(has_place & (~notable_only | it["code"].isin(*NOTABLE_CODES)))
    location = F.coalesce(F.try_element_at(F.col("filters"), F.lit("location_name")),
                          F.concat(_s(F.try_element_at(F.col("filters"), F.lit("lat"))), F.lit(","),
                                   _s(F.try_element_at(F.col("filters"), F.lit("lon")))))
    desc = weather_text(it["code"])
    df = (df.withColumn("_tu", F.coalesce(F.col("_p")["daily_units"]["temperature_2m_max"], F.lit("°C")))
          .withColumn("_ru", F.coalesce(F.col("_p")["daily_units"]["precipitation_sum"], F.lit("mm"))))
    t_unit, r_unit = F.col("_tu"), F.col("_ru")
    title = F.concat(F.lit("Weather "), location, F.lit(": "), desc, F.lit(" on "), it["time"])
    snippet = F.concat(capitalize_first(desc), F.lit(", high "), it["temp"].cast("string"), t_unit,
                       F.lit(", precipitation "), it["rain"].cast("string"), F.lit(" "), r_unit)
    return _results(df.drop("_p"), "weather", url=F.lit(WEATHER_URL), title=title, snippet=snippet,
                    label=F.lit("open_meteo"), fetched_at=F.lit(as_of).cast("timestamp"))


# S19
def normalise_semantic_scholar(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """Papers without title or id are skipped; year → 1 January UTC; snippet =
    abstract (cut at 280 with an ellipsis) else the author line."""
    it = F.col("it")
    df = (explode_items(landed, _parsed(landed, "semantic_scholar"), lambda p: p["data"])
          .withColumn("_title", strip_ws(_s(it["title"])))
          .withColumn("_id", _s(it["paperId"]))
          .where((F.col("_title") != "") & (F.col("_id") != "")))
    abstract = strip_ws(_s(it["abstract"]))
    names = F.transform(F.coalesce(it["authors"], F.array().cast("array<struct<name:string>>")),
                        lambda a: _s(a["name"]))
    snippet = F.when(abstract != "", truncate_ellipsis(abstract, 280)).otherwise(author_line(names))
    year = it["year"]
    fetched = F.when(F.coalesce(year, F.lit(0)) != 0,
                     F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return _results(df, "semantic_scholar",
                    url=F.coalesce(F.nullif(it["url"], F.lit("")),
                                   F.concat(F.lit(S2_PAPER_URL), F.col("_id"))),
                    title=F.col("_title"), snippet=snippet,
                    fetched_at=F.coalesce(fetched, F.lit(as_of).cast("timestamp")))


NORMALISERS.update({"weather": normalise_weather, "semantic_scholar": normalise_semantic_scholar})


# --- jobs and papers (S16, S18, S20) --------------------------------------------
from vigil.functions.dates import parse_pubmed_date  # noqa: E402
from vigil.functions.price import salary_suffix  # noqa: E402
from vigil.functions.text import split_names, term_filter  # noqa: E402
from pyspark.sql import Window  # noqa: E402

# Fixed value: the record page of a PubMed id.
PUBMED_URL = "https://pubmed.ncbi.nlm.nih.gov/"

SCHEMAS.update({
    "adzuna": ("results ARRAY<STRUCT<redirect_url STRING, title STRING, "
               "company STRUCT<display_name STRING>, description STRING, created STRING, "
               "salary_min DOUBLE, salary_max DOUBLE>>"),
    "pubmed": ("search STRUCT<esearchresult STRUCT<idlist ARRAY<STRING>>>, "
               "summary STRUCT<result MAP<STRING, STRING>>"),
    "biorxiv": ("collection ARRAY<STRUCT<doi STRING, title STRING, abstract STRING, "
                "authors STRING, date STRING, category STRING, server STRING>>, "
                "messages ARRAY<STRUCT<cursor INT, count INT>>"),
})
SOURCE_TYPES.update({"adzuna": "jobs", "pubmed": "science", "biorxiv": "science",
                     "medrxiv": "science"})


PUBMED_SUMMARY = ("title STRING, source STRING, pubdate STRING, "
                  "authors ARRAY<STRUCT<name STRING>>")


# S20
def normalise_adzuna(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """Jobs without a redirect URL are skipped; the title carries the salary
    suffix; snippet = ``company — description`` (description cut at 280)."""
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "adzuna"), lambda p: p["results"]).where(
        _s(it["redirect_url"]) != "")
    desc = truncate_ellipsis(strip_ws(_s(it["description"])), 280)
    company = _s(it["company"]["display_name"])
    snippet = (F.when(company != "", F.when(desc != "", F.concat(company, F.lit(" — "), desc))
                      .otherwise(company)).otherwise(desc))
    title = F.concat(strip_ws(_s(it["title"])), salary_suffix(it["salary_min"], it["salary_max"]))
    return _results(df, "adzuna", url=it["redirect_url"], title=title, snippet=snippet,
                    fetched_at=parse_iso(it["created"], as_of))


# S16
def normalise_pubmed(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """Search ids in order, each looked up in the summary object of the same
    response pair, whose values are parsed one by one (it also holds a list of
    ids); ids without an object summary are skipped."""
    p = _parsed(landed, "pubmed")
    pairs = F.transform(p["search"]["esearchresult"]["idlist"], lambda i: F.struct(
        i.alias("pmid"), F.try_element_at(p["summary"]["result"], i).alias("text")))
    df = (landed.select("*", F.posexplode_outer(pairs).alias("item_pos", "_pair"))
          .withColumn("pmid", F.col("_pair.pmid"))
          .withColumn("it", F.when(F.ltrim("_pair.text").startswith("{"), F.from_json(
              "_pair.text", PUBMED_SUMMARY, {"mode": "PERMISSIVE"})))
          .where(F.col("it").isNotNull())
          .drop("_pair"))
    it = F.col("it")
    names = F.transform(F.coalesce(it["authors"], F.array().cast("array<struct<name:string>>")),
                        lambda a: _s(a["name"]))
    authors = author_line(names)
    journal = _s(it["source"])
    pub = _s(it["pubdate"])
    fetched = F.when(pub != "", parse_pubmed_date(pub, as_of)).otherwise(
        F.lit(as_of).cast("timestamp"))
    return _results(df, "pubmed",
                    url=F.concat(F.lit(PUBMED_URL), F.col("pmid"), F.lit("/")),
                    title=_s(it["title"]),
                    snippet=F.when(authors != "", F.concat(authors, F.lit(" — "), journal))
                    .otherwise(journal),
                    fetched_at=fetched)


# S18
def normalise_biorxiv(landed: DataFrame, as_of=AS_OF, max_results: int = 30) -> DataFrame:
    """Pages of one source entry in order; papers need a title and a DOI and
    must match any term (title + abstract, case-insensitive); at most
    ``max_results`` (or the entry's ``filters.max_results``) are kept after
    that filter."""
    it = F.col("it")
    terms = F.filter(F.split(_s(F.try_element_at(F.col("filters"), F.lit("terms"))), ","),
                     lambda t: t != "")
    df = (explode_items(landed, _parsed(landed, "biorxiv"), lambda p: p["collection"])
          .where((_s(it["title"]) != "") & (_s(it["doi"]) != ""))
          .where(term_filter(F.concat(_s(it["title"]), F.lit(" "), _s(it["abstract"])), terms)))
    w = Window.partitionBy("run_id", "topic_name", "source_ord", "source").orderBy(
        "payload_id", "item_pos")
    most = F.coalesce(F.try_element_at(F.col("filters"), F.lit("max_results")).try_cast("int"),
                      F.lit(max_results))
    df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    names = split_names(_s(it["authors"]), ";")
    abstract = _s(it["abstract"])
    snippet = F.when(abstract != "", truncate_ellipsis(abstract, 280)).otherwise(author_line(names))
    date = F.try_to_timestamp(_s(it["date"]), F.lit("yyyy-MM-dd"))
    server = F.col("source")
    url = F.concat(F.lit("https://www."), server, F.lit(".org/content/"), it["doi"])
    return _results(df, "biorxiv", url=url, title=it["title"], snippet=snippet, label=server,
                    fetched_at=F.coalesce(date, F.lit(as_of).cast("timestamp")))


NORMALISERS.update({"adzuna": normalise_adzuna, "pubmed": normalise_pubmed,
                    "biorxiv": normalise_biorxiv})


# --- social posts and mail (S07, S31) ---------------------------------------------
POST_TYPE = ("STRUCT<uri STRING, author STRUCT<handle STRING>, "
             "record STRUCT<text STRING, createdAt STRING>, indexedAt STRING>")
SCHEMAS.update({
    "bluesky": f"feed ARRAY<STRUCT<post {POST_TYPE}>>, posts ARRAY<{POST_TYPE}>",
    "email": ("messages ARRAY<STRUCT<from_ STRING, subject STRING, text STRING, html STRING, "
              "headers MAP<STRING, ARRAY<STRING>>, uid STRING, date STRING>>"),
})
SOURCE_TYPES.update({"bluesky": "social", "email": "feeds", "email_newsletter": "feeds"})
NO_SUBJECT = "(no subject)"


# S07
def normalise_bluesky(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """Author-feed items (``feed[].post``) first, then search hits
    (``posts[]``); URL from handle + last path segment of ``uri``."""
    p = _parsed(landed, "bluesky")
    posts = F.concat(F.coalesce(F.transform(p["feed"], lambda x: x["post"]),
                                F.array().cast(f"array<{POST_TYPE}>")),
                     F.coalesce(p["posts"], F.array().cast(f"array<{POST_TYPE}>")))
    df = explode_items(landed, posts, lambda x: x)
    it = F.col("it")
    handle = _s(it["author"]["handle"])
    uri = _s(it["uri"])
    rkey = F.when(uri != "", F.element_at(F.split(uri, "/"), -1)).otherwise(F.lit(""))
    url = F.when((handle != "") & (rkey != ""),
                 F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), rkey)
                 ).otherwise(F.lit(""))
    text = _s(it["record"]["text"])
    raw = F.coalesce(F.nullif(it["record"]["createdAt"], F.lit("")), it["indexedAt"])
    return _results(df, "bluesky", url=url, title=truncate_ellipsis(text, 120), snippet=text,
                    fetched_at=F.lit(as_of).cast("timestamp"),
                    published_at=parse_iso(raw, as_of))


# S31
def normalise_email(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """Landed mail: sender filter (any ``filters.senders`` entry as a
    case-insensitive substring), subject default, text body else HTML with
    tags replaced by spaces, first 300 characters stripped, stable URL from
    the Message-ID else the uid, mail date → ``published_at``."""
    it = F.col("it")
    df = explode_items(landed, _parsed(landed, "email"), lambda p: p["messages"])
    senders = F.filter(F.split(_s(F.try_element_at(F.col("filters"), F.lit("senders"))), ","),
                       lambda s: s != "")
    frm = _s(it["from_"])
    df = df.where((F.size(senders) == 0)
                  | F.exists(senders, lambda s: F.contains(F.lower(frm), F.lower(s))))
    body = F.coalesce(F.nullif(it["text"], F.lit("")), strip_html(_s(it["html"]), " "))
    msg_id = F.regexp_replace(_s(F.try_element_at(F.try_element_at(it["headers"], F.lit("message-id")),
                                                  F.lit(1))), "^<+|>+$", "")
    user = F.coalesce(F.try_element_at(F.col("filters"), F.lit("user")), F.lit("inbox"))
    url = F.concat(F.lit("email://"), user, F.lit("/"),
                   F.when(msg_id != "", msg_id).otherwise(_s(it["uid"])))
    return _results(df, "email", url=url,
                    title=F.coalesce(F.nullif(it["subject"], F.lit("")), F.lit(NO_SUBJECT)),
                    snippet=strip_ws(F.substring(body, 1, 300)),
                    label=F.lit("email_newsletter"), fetched_at=F.lit(as_of).cast("timestamp"),
                    published_at=it["date"].try_cast("timestamp"))


NORMALISERS.update({"bluesky": normalise_bluesky, "email": normalise_email})


# --- entertainment (S13, S14) -------------------------------------------------
TMDB_SITE = "https://www.themoviedb.org"
SCHEMAS["tmdb"] = ("results ARRAY<STRUCT<id BIGINT, title STRING, name STRING, "
                   "release_date STRING, first_air_date STRING, overview STRING, "
                   "media_type STRING>>")
SOURCE_TYPES["tmdb"] = "entertainment"


def _tmdb_results(df: DataFrame, media: Column, as_of) -> DataFrame:
    it = F.col("it")
    movie = media == "movie"
    date = F.when(movie, _s(it["release_date"])).otherwise(_s(it["first_air_date"]))
    name = F.when(movie, _s(it["title"])).otherwise(_s(it["name"]))
    title = (F.when(movie & (date != ""), F.concat(name, F.lit(" ("), date, F.lit(")")))
             .when(movie, name)
             .when(date != "", F.concat(name, F.lit(" [TV] ("), date, F.lit(")")))
             .otherwise(F.concat(name, F.lit(" [TV]"))))
    overview = _s(it["overview"])
    snippet = F.when(overview != "", F.substring(overview, 1, 300)).otherwise(
        F.when(movie, F.concat(F.lit("Movie · release "), date))
        .otherwise(F.concat(F.lit("TV premiere · "), date)))
    url = F.concat(F.lit(TMDB_SITE + "/"), media, F.lit("/"), _s(it["id"].cast("string")))
    return _results(df, "tmdb", url=url, title=title, snippet=snippet,
                    fetched_at=F.lit(as_of).cast("timestamp"))


# S14
def normalise_tmdb_search(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """First 10 hits of each search response, *then* people are dropped."""
    df = explode_items(landed, _parsed(landed, "tmdb"), lambda p: F.slice(p["results"], 1, 10))
    df = df.where(F.col("it")["media_type"].isin("movie", "tv"))
    return _tmdb_results(df, F.col("it")["media_type"], as_of)


# S13
def normalise_tmdb_discover(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """One discover response per media type (the landed ``term``), each cut
    at ``filters.max_results`` (default 20)."""
    cap = F.coalesce(F.try_element_at(F.col("filters"), F.lit("max_results")).try_cast("int"),
                     F.lit(20))
    df = explode_items(landed, _parsed(landed, "tmdb"), lambda p: F.slice(p["results"], 1, cap))
    return _tmdb_results(df, F.col("term"), as_of)


NORMALISERS.update({"tmdb_search": normalise_tmdb_search, "tmdb_discover": normalise_tmdb_discover})
