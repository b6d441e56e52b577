"""String helpers (F01–F05, F12, F14): all built-in Column expressions,
evaluated inside whole-stage codegen; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove leading/trailing whitespace: tabs, newlines, separators and the
    Unicode spaces (no-break and ideographic ones, too)."""
    space = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
    return F.regexp_replace(_c(c), f"^{space}|{space}$", "")


# F01
def strip_html(c: Column | str, replacement: str = "") -> Column:
    """Drop every ``<…>`` tag (replaced by ``replacement``), then strip."""
    return strip_ws(F.regexp_replace(_c(c), "<[^>]+>", replacement))


# F02
def truncate_ellipsis(c: Column | str, n: int) -> Column:
    """First ``n`` characters plus ``…`` when longer than ``n``."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


# F03
def truncate_hard(c: Column | str, n: int) -> Column:
    return F.substring(_c(c), 1, n)


# F04
def author_line(names: Column | str, n: int = 3) -> Column:
    """First ``n`` names joined by ``, `` plus `` et al.`` when more exist."""
    names = _c(names)
    head = F.array_join(F.slice(names, 1, n), ", ")
    return F.when(F.size(names) > n, F.concat(head, F.lit(" et al."))).otherwise(head)


def split_names(c: Column | str, sep: str = ";") -> Column:
    """``a; b;; c`` → ``[a, b, c]`` (blanks dropped, items stripped)."""
    parts = F.transform(F.split(_c(c), sep), lambda x: strip_ws(x))
    return F.filter(parts, lambda x: x != "")


# F05
def absolute_url(href: Column | str, base: str | Column) -> Column:
    """Keep absolute ``http…`` links; prefix relative ones with ``base``."""
    href = _c(href)
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(href.startswith("http"), href).otherwise(F.concat(base, href))


# F12
def term_filter(text: Column | str, terms: Column | str) -> Column:
    """Any term is a case-insensitive substring of ``text``; no terms → true."""
    text, terms = F.lower(_c(text)), _c(terms)
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(text, F.lower(t)))


# F14
def html_escape(c: Column | str) -> Column:
    """``& < > " '`` as HTML entities (ampersand first)."""
    c = _c(c)
    for raw, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                     ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(ent))
    return c
