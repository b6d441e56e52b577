"""Feed normalisers (S17, S21–S26): RSS and Atom bodies parsed with the
built-in ``from_xml`` and a fixed schema (attributes as ``_name`` fields);
malformed XML parses to NULL and yields no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.conventions import AS_OF
from vigil.functions.dates import parse_feed_date, parse_iso
from vigil.functions.text import author_line, strip_html, strip_ws, truncate_ellipsis
from vigil.operators.positions import with_positions
from vigil.session import checkpoint_dir
from vigil.sources.json_api import _results, SOURCE_TYPES
from vigil.sources.landing import explode_items

_RSS_ITEM = "STRUCT<title STRING, link STRING, description STRING, pubDate STRING>"
_ATOM_ENTRY = ("STRUCT<id STRING, title STRING, summary STRING, content STRING, "
               "link ARRAY<STRUCT<_href STRING, _rel STRING>>, published STRING, updated STRING, "
               "author ARRAY<STRUCT<name STRING>>, category ARRAY<STRUCT<_term STRING>>>")
RSS_SCHEMA = f"channel STRUCT<title STRING, item ARRAY<{_RSS_ITEM}>>"
ATOM_SCHEMA = f"entry ARRAY<{_ATOM_ENTRY}>"
FEED_SCHEMA = f"{RSS_SCHEMA}, {ATOM_SCHEMA}"

# Fixed value: the abstract page of an arXiv id.
ARXIV_ABS_URL = "https://arxiv.org/abs/"

SOURCE_TYPES.update({"google_news": "news", "rss": "feeds", "slickdeals": "shopping",
                     "camelcamelcamel": "shopping", "indeed": "jobs", "reddit": "social",
                     "arxiv": "science"})


def _xml(col: str, schema: str) -> Column:
    return F.from_xml(F.col(col), schema, {"mode": "PERMISSIVE"})


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filter(name: str) -> Column:
    return F.try_element_at(F.col("filters"), F.lit(name))


def _page_link(entry: Column) -> Column:
    """The entry's first link that is no other relation (``rel`` missing or
    ``alternate``)."""
    rel = lambda x: F.coalesce(x["_rel"], F.lit("alternate"))
    own = F.filter(entry["link"], lambda x: (rel(x) == "alternate") | (rel(x) == ""))
    return F.get(own, F.lit(0))["_href"]


def _published(entry: Column) -> Column:
    return F.coalesce(F.nullif(entry["published"], F.lit("")), entry["updated"])


def _summary(entry: Column) -> Column:
    return F.coalesce(entry["summary"], entry["content"])


def _as_rss(entry: Column) -> Column:
    return F.struct(entry["title"].alias("title"), _page_link(entry).alias("link"),
                    _summary(entry).alias("description"), _published(entry).alias("pubDate"))


def _rss(landed: DataFrame) -> DataFrame:
    """Items of an RSS body, or the entries of an Atom body as such."""
    return explode_items(landed, _xml("body", FEED_SCHEMA), lambda p: F.coalesce(
        p["channel"]["item"], F.transform(p["entry"], _as_rss)))


def normalise_rss_like(source: str, landed: DataFrame, as_of=AS_OF,
                       date_as_published: bool = True) -> DataFrame:
    """S21 google_news, S22 rss (date → ``published_at``) and S24 slickdeals,
    S25 camelcamelcamel (date → ``fetched_at``, else the clock)."""
    it = F.col("it")
    df = _rss(landed)
    date = parse_feed_date(it["pubDate"])
    now = F.lit(as_of).cast("timestamp")
    return _results(df, source, url=_s(it["link"]), title=_s(it["title"]),
                    snippet=_s(it["description"]),
                    fetched_at=now if date_as_published else F.coalesce(date, now),
                    published_at=date if date_as_published else None)


def normalise_google_news(landed, as_of=AS_OF):
    return normalise_rss_like("google_news", landed, as_of, True)


def normalise_rss(landed, as_of=AS_OF):
    return normalise_rss_like("rss", landed, as_of, True)


def normalise_slickdeals(landed, as_of=AS_OF):
    return normalise_rss_like("slickdeals", landed, as_of, False)


def normalise_camelcamelcamel(landed, as_of=AS_OF):
    return normalise_rss_like("camelcamelcamel", landed, as_of, False)


# S26
def normalise_indeed(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """Entries without a link are skipped; the summary loses its tags and is
    cut at 280 characters with an ellipsis."""
    it = F.col("it")
    df = _rss(landed).where(_s(it["link"]) != "")
    snippet = truncate_ellipsis(strip_html(_s(it["description"]), ""), 280)
    return _results(df, "indeed", url=it["link"], title=strip_ws(_s(it["title"])),
                    snippet=snippet,
                    fetched_at=F.coalesce(parse_feed_date(it["pubDate"]),
                                          F.lit(as_of).cast("timestamp")))


def feed_failed(body: str = "body") -> Column:
    """A feed that is malformed and in which no entry even begins; a
    well-formed one may be empty, and one that breaks off later has entries."""
    parsed = F.from_xml(F.col(body), f"{FEED_SCHEMA}, _corrupt STRING",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    malformed = parsed.isNull() | parsed["_corrupt"].isNotNull()
    return malformed & ~F.coalesce(F.col(body).rlike(r"<(item|entry)[\s/>]"), F.lit(False))


def indeed_failed(landed: DataFrame) -> DataFrame:
    """Adds ``failed`` per payload."""
    return landed.withColumn("failed", feed_failed())


def _atom(landed: DataFrame) -> DataFrame:
    return explode_items(landed, _xml("body", ATOM_SCHEMA), lambda p: p["entry"])


# S23
def normalise_reddit(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    it = F.col("it")
    df = _atom(landed)
    return _results(df, "reddit", url=_s(_page_link(it)), title=_s(it["title"]),
                    snippet=_s(_summary(it)),
                    fetched_at=F.coalesce(parse_iso(_published(it)),
                                          F.lit(as_of).cast("timestamp")))


def _one_line(c: Column) -> Column:
    return strip_ws(F.regexp_replace(_s(c), "\n", " "))


# S17
def normalise_arxiv(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    """Id after ``/abs/`` (entries without one are skipped); newlines in
    title/abstract become spaces; snippet = ``authors — categories`` when the
    entry has categories, else the abstract cut at 280 with an ellipsis."""
    it = F.col("it")
    df = (_atom(landed)
          .withColumn("_id", strip_ws(F.element_at(F.split(_s(it["id"]), "/abs/"), -1)))
          .where(F.col("_id") != ""))
    summary = _one_line(it["summary"])
    names = F.transform(F.coalesce(it["author"], F.array().cast("array<struct<name:string>>")),
                        lambda a: _s(a["name"]))
    cats = F.filter(F.transform(F.coalesce(it["category"], F.array().cast("array<struct<_term:string>>")),
                                lambda c: _s(c["_term"])), lambda t: t != "")
    cat_str = F.array_join(cats, ", ")
    snippet = F.when(cat_str != "", F.concat(author_line(names), F.lit(" — "), cat_str)).otherwise(
        truncate_ellipsis(summary, 280))
    return _results(df, "arxiv", url=F.concat(F.lit(ARXIV_ABS_URL), F.col("_id")),
                    title=_one_line(it["title"]), snippet=snippet,
                    fetched_at=F.coalesce(parse_iso(it["published"]),
                                          F.lit(as_of).cast("timestamp")))


NORMALISERS = {
    "google_news": normalise_google_news, "rss": normalise_rss, "slickdeals": normalise_slickdeals,
    "camelcamelcamel": normalise_camelcamelcamel, "indeed": normalise_indeed,
    "reddit": normalise_reddit, "arxiv": normalise_arxiv,
}


# --- substack (S27 discovery, S28 feed read) -------------------------------------
_PUBLICATIONS = "ARRAY<STRUCT<subdomain STRING, handle STRING, slug STRING>>"
SEARCH_SCHEMA = f"publications {_PUBLICATIONS}"
SOURCE_TYPES["substack"] = "feeds"


_ENTRY = ["run_id", "topic_name", "source_ord"]


def substack_discovery(landed: DataFrame, max_pubs: int = 5) -> DataFrame:
    """Feed URLs to read, per source entry (run, topic, source_ord): terms in
    order (``payload_id``), publications in response order; a handle is
    ``subdomain`` else ``handle`` else ``slug``; a handle already taken by an
    earlier publication of the entry is skipped; at most ``max_pubs`` (or the
    entry's ``filters.max_pubs``) new handles per term.  A reply is an object
    with ``publications`` or the list itself.  An entry with its own
    ``filters.feeds`` reads these and searches nothing.

    No entry is gathered: what each term takes is a fixpoint (see ``_claims``),
    and positions come from a sort that splits a large entry."""
    options = {"mode": "PERMISSIVE"}
    pubs = F.when(F.ltrim("body").startswith("["), F.from_json("body", _PUBLICATIONS, options)) \
        .otherwise(F.from_json("body", SEARCH_SCHEMA, options)["publications"])
    most = F.coalesce(_filter("max_pubs").try_cast("int"), F.lit(max_pubs))
    handle = F.coalesce(*[F.nullif(F.col(f"pub.{c}"), F.lit("")) for c in (
        "subdomain", "handle", "slug")])
    offers = (landed.where(_filter("feeds").isNull())
              .select(*_ENTRY, F.col("payload_id").alias("term_ord"), most.alias("most"),
                      F.posexplode(pubs).alias("pos", "pub"))
              .select(*_ENTRY, "term_ord", "most", "pos", handle.alias("handle"))
              .where(F.col("handle").isNotNull()))
    taken = with_positions(_claims(offers), _ENTRY, ["term_ord", "pos"], "feed_pos")
    return taken.select(*_ENTRY, (F.col("feed_pos") - 1).cast("int").alias("feed_pos"), "term_ord",
                        "handle", F.concat(F.lit("https://"), F.col("handle"),
                                           F.lit(".substack.com/feed")).alias("feed_url"))


def _claims(offers: DataFrame) -> DataFrame:
    """What each term takes: its first ``most`` handles that no earlier term of
    the entry has taken.

    Each round gives every term its first free handles, given which term each
    handle was taken by first in the round before; only terms that offer a handle
    whose taker changed are worked out again.  A term is final once all earlier
    ones are, so rounds end; few are needed, as caps seldom free a handle."""
    checkpoint_dir(offers.sparkSession)
    term, by = [*_ENTRY, "term_ord"], [*_ENTRY, "handle"]
    offers = offers.groupBy(*term, "handle").agg(
        F.min("pos").alias("pos"), F.max("most").alias("most")).dropna(subset=_ENTRY).checkpoint()
    page = Window.partitionBy(*term).orderBy("pos")  # one reply

    def take(some: DataFrame, taker: DataFrame | None) -> DataFrame:
        if taker is not None:
            some = some.join(taker, by, "left").where(
                F.col("taker").isNull() | (F.col("taker") >= F.col("term_ord"))).drop("taker")
        return some.withColumn("_r", F.row_number().over(page)).where(F.col("_r") <= F.col("most")).drop("_r")

    def takers(claims: DataFrame) -> DataFrame:
        return claims.groupBy(*by).agg(F.min("term_ord").alias("taker")).checkpoint()

    claims = take(offers, None).checkpoint()
    taker, before = takers(claims), None
    while True:
        changed = taker if before is None else taker.withColumnRenamed("taker", "now").join(
            before, by, "full").where(~F.col("now").eqNullSafe(F.col("taker")))
        again = offers.join(changed.select(*by), by, "left_semi").select(*term).distinct().checkpoint()
        if again.isEmpty():
            return claims
        redone = take(offers.join(again, term, "left_semi"), taker)
        claims = claims.join(again, term, "left_anti").select(*offers.columns).unionByName(
            redone.select(*offers.columns)).checkpoint()
        before, taker = taker, takers(claims)


def substack_direct(landed: DataFrame) -> DataFrame:
    """Feeds that an entry lists itself (``filters.feeds``, a JSON list), in order."""
    feeds = F.from_json(_filter("feeds"), "ARRAY<STRING>")
    return landed.where(_filter("feeds").isNotNull()).select(
        "run_id", "topic_name", "source_ord", feeds.alias("feeds")).distinct().select(
        "run_id", "topic_name", "source_ord", F.posexplode("feeds").alias("feed_pos", "feed_url"))


def normalise_substack(landed: DataFrame, as_of=AS_OF, max_per_feed: int = 10) -> DataFrame:
    """Feed read: the first ``max_per_feed`` (or ``filters.max_per_feed``)
    entries of each feed, *then* entries without link or title are dropped."""
    it = F.col("it")
    most = F.coalesce(_filter("max_per_feed").try_cast("int"), F.lit(max_per_feed))
    df = (explode_items(landed, _xml("body", RSS_SCHEMA),
                        lambda p: F.slice(p["channel"]["item"], F.lit(1), most))
          .where((_s(it["link"]) != "") & (_s(it["title"]) != "")))
    return _results(df, "substack", url=it["link"], title=it["title"],
                    snippet=truncate_ellipsis(_s(it["description"]), 280),
                    fetched_at=F.lit(as_of).cast("timestamp"),
                    published_at=parse_feed_date(it["pubDate"]))


NORMALISERS["substack"] = normalise_substack
