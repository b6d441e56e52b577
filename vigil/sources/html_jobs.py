"""HTML job-board normalisers (S29 playbill_jobs, S30 usitt_jobs).

Only tile extraction needs a parser: a small stdlib ``html.parser`` tree
builder runs inside ``mapInPandas`` (Arrow batches, one page per row) and
emits one row per tile with its raw parts.  Everything after it — href
absolutising (F05), in-page dedup by href (R10, first wins, before the title
check), title fallback, snippet assembly, truncation — is Spark SQL.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.conventions import AS_OF
from vigil.functions.text import absolute_url
from vigil.sources.json_api import SOURCE_TYPES, _results

# Site roots, tile markers and metadata class keys.
PLAYBILL_ROOT = "https://playbill.com"
PLAYBILL_TILE = "pb-tile-tag-job"
META_KEYS = ("company", "location", "org", "meta")
SOURCE_TYPES.update({"playbill_jobs": "jobs", "usitt_jobs": "jobs"})

_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source",
         "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent

    def cls(self) -> str:
        return self.attrs.get("class") or ""

    def walk(self):
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        """Text of the subtree, each piece stripped, joined without spaces."""
        out = []
        for c in self.children:
            if isinstance(c, _Node):
                out.append(c.text())
            else:
                s = c.strip()
                if s:
                    out.append(s)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs, self.cur)
        self.cur.children.append(node)
        if tag not in _VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, attrs, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def _parse(html: str) -> _Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _first(node: _Node, pred):
    return next((n for n in node.walk() if pred(n)), None)


def _playbill_tiles(html: str) -> list[tuple]:
    root = _parse(html)
    container = (_first(root, lambda n: n.attrs.get("id") == "job-listings")
                 or _first(root, lambda n: "job-listings" in n.cls())
                 or _first(root, lambda n: n.tag == "main") or root)
    tiles = [n for n in container.walk() if PLAYBILL_TILE in n.cls()]
    if not tiles:
        tiles = [n for n in container.walk() if n.attrs.get("data-entity-type") == "job"]
    out = []
    for i, tile in enumerate(tiles):
        a = _first(tile, lambda n: n.tag == "a" and n.attrs.get("href") is not None)
        if a is None:
            continue
        heading = _first(tile, lambda n: n.tag in ("h2", "h3", "h4"))
        desc = (_first(tile, lambda n: n.tag == "p")
                or _first(tile, lambda n: "desc" in n.cls()))
        metas = [n.text() for n in tile.walk() if any(k in n.cls() for k in META_KEYS)]
        out.append((i, a.attrs["href"], heading.text() if heading else None, a.text(),
                    desc.text() if desc else "", [m for m in metas if m]))
    return out


TILE_SCHEMA = T.StructType([
    T.StructField("payload_id", T.LongType()), T.StructField("run_id", T.StringType()),
    T.StructField("topic_name", T.StringType()), T.StructField("source_ord", T.IntegerType()),
    T.StructField("tile_pos", T.IntegerType()), T.StructField("href", T.StringType()),
    T.StructField("heading", T.StringType()), T.StructField("link_text", T.StringType()),
    T.StructField("desc", T.StringType()), T.StructField("metas", T.ArrayType(T.StringType()))])


def _extract(batches):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            for tile in _playbill_tiles(r.body):
                rows.append((r.payload_id, r.run_id, r.topic_name, r.source_ord, *tile))
        yield pd.DataFrame(rows, columns=[f.name for f in TILE_SCHEMA.fields])


def playbill_tiles(landed: DataFrame) -> DataFrame:
    return landed.select("payload_id", "run_id", "topic_name", "source_ord", "body").mapInPandas(
        _extract, TILE_SCHEMA)


# S29
def normalise_playbill(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    tiles = playbill_tiles(landed).withColumn(
        "href", absolute_url("href", PLAYBILL_ROOT))
    # First tile per (page, href), before the title check (partial min_by)
    rest = [c for c in tiles.columns if c not in ("payload_id", "href")]
    first = (tiles.groupBy("payload_id", "href")
             .agg(F.min_by(F.struct(*rest), F.col("tile_pos")).alias("t"))
             .select("payload_id", "href", "t.*"))
    title = F.coalesce(F.col("heading"), F.col("link_text"))
    meta = F.array_join(F.col("metas"), " · ")
    snippet = (F.when((meta != "") & (F.col("desc") == ""), meta)
               .when(meta != "", F.concat(meta, F.lit(" — "), F.col("desc")))
               .otherwise(F.col("desc")))
    df = first.where(title != "").withColumn("item_pos", F.col("tile_pos"))
    return _results(df, "playbill_jobs", url=F.col("href"), title=title,
                    snippet=F.substring(snippet, 1, 280),
                    fetched_at=F.lit(as_of).cast("timestamp"))


# --- S30 ------------------------------------------------------------------------
USITT_ROOT = "https://www.usitt.org"
USITT_ROW = "avail-jobs_chart-row"
USITT_DYN = "w-dyn-item"
USITT_FEATURED = "featured-job"

USITT_SCHEMA = T.StructType([
    T.StructField("payload_id", T.LongType()), T.StructField("run_id", T.StringType()),
    T.StructField("topic_name", T.StringType()), T.StructField("source_ord", T.IntegerType()),
    T.StructField("terms", T.StringType()),
    T.StructField("tile_pos", T.IntegerType()), T.StructField("href", T.StringType()),
    T.StructField("heading", T.StringType()), T.StructField("link_text", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StringType()))])


def _usitt_items(html: str) -> list[tuple]:
    root = _parse(html)
    rows = [n for n in root.walk() if USITT_ROW in n.cls().split()]
    if not rows:
        rows = [n for n in root.walk() if USITT_DYN in n.cls()]
    featured = [n for n in root.walk() if USITT_FEATURED in n.cls() and n not in rows]
    out = []
    for i, item in enumerate(rows + featured):
        a = _first(item, lambda n: n.tag == "a" and n.attrs.get("href") is not None)
        if a is None:
            continue
        heading = _first(item, lambda n: n.tag in ("h2", "h3", "h4", "h5"))
        parts = [n.text() for n in item.walk() if n.tag in ("p", "span")]
        out.append((i, a.attrs["href"], heading.text() if heading else None, a.text(), parts))
    return out


def _extract_usitt(batches):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            terms = (r.filters or {}).get("terms") if isinstance(r.filters, dict) else None
            if terms is None and r.filters is not None:
                terms = dict(r.filters).get("terms")
            for item in _usitt_items(r.body):
                rows.append((r.payload_id, r.run_id, r.topic_name, r.source_ord, terms, *item))
        yield pd.DataFrame(rows, columns=[f.name for f in USITT_SCHEMA.fields])


def normalise_usitt(landed: DataFrame, as_of=AS_OF) -> DataFrame:
    items = (landed.select("payload_id", "run_id", "topic_name", "source_ord", "filters", "body")
             .mapInPandas(_extract_usitt, USITT_SCHEMA)
             .withColumn("href", absolute_url("href", USITT_ROOT)))
    rest = [c for c in items.columns if c not in ("payload_id", "href")]
    first = (items.groupBy("payload_id", "href")
             .agg(F.min_by(F.struct(*rest), F.col("tile_pos")).alias("t"))
             .select("payload_id", "href", "t.*"))
    title = F.coalesce(F.col("heading"), F.col("link_text"))
    first = first.withColumn("_title", title).where(F.col("_title") != "")
    kept = F.filter(F.col("parts"), lambda x: (x != "") & (x != F.col("_title")))
    first = first.withColumn("_snip", F.substring(F.array_join(F.slice(kept, 1, 3), " · "), 1, 280))
    terms = F.filter(F.split(F.coalesce(F.col("terms"), F.lit("")), ","), lambda t: t != "")
    from vigil.functions.text import term_filter
    first = first.where(term_filter(F.concat(F.col("_title"), F.lit(" "), F.col("_snip")), terms))
    df = first.withColumn("item_pos", F.col("tile_pos"))
    return _results(df, "usitt_jobs", url=F.col("href"), title=F.col("_title"),
                    snippet=F.col("_snip"), fetched_at=F.lit(as_of).cast("timestamp"))
