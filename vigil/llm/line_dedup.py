"""Line dedup: repeated line runs by prefix doubling, built-in functions only.

The corpus is read as one sequence of line ids per document, and its suffixes
are ordered by distributed prefix doubling: the rank of a suffix to depth 2k
is the order of the pair of ranks to depth k at its start and k lines later.
Suffixes whose rank is unique leave the race, so a round handles only runs
that do repeat.  Suffixes with equal rank to depth k are one interval of the
suffix array whose longest common prefix is k lines or more; the first of
them in document order is the original, the others start later copies.

A run counts when it has ``min_lines`` lines (one of them not blank), or is a
single line of ``min_words`` words or more.  A longer run is the union of such
windows, so ranks to depth ``min_lines`` decide which lines go: every line in a
later copy of a counting run is deleted, and adjacent deleted lines form the
maximal repeated runs that are reported.

Lines are split at line feeds.  A null text stays null, a text of which
nothing is left becomes null; other texts keep their remaining lines in order.
Copies are later in (doc_id, hash of the text, line number); rows equal in
doc_id and text are one document and lose the same lines.

Ranks come from a range-partitioned sort of the distinct pairs, counted before
the shuffle, so a line that a third of all rows share is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import ID, UID, id_col, keyed, settled, uid_col, written

MIN_LINES = 3
MIN_WORDS = 5

_AT = [ID, UID, "line_no"]


def lines(docs: DataFrame) -> DataFrame:
    """One row per line: its place, two 64-bit hashes, words, blankness."""
    parts = keyed(docs, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return parts.select(
        *_AT, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words"))


def _ranked(keys: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """Order-preserving ids of the keys that occur twice or more.

    Equal keys are counted before the shuffle; the ids follow the sorted order
    of the range partitions, with gaps between partitions.
    """
    twice = keys.groupBy(*cols).count().where(F.col("count") > 1).select(*cols)
    order = twice.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return written(order.withColumn(name, F.monotonically_increasing_id()), f"lines-{name}")


def suffix_ranks(rows: DataFrame, depth: int) -> DataFrame:
    """Places with ``rank1`` (their line, if it repeats), ``rank`` (their
    window of ``depth`` lines, if that repeats) and ``solid`` (the window has
    a line that is not blank)."""
    first = _ranked(rows, "rank1", ["h1", "h2"])
    places = written(rows.join(first, ["h1", "h2"]).select(
        *_AT, "n_words", "rank1").dropDuplicates(_AT), "lines-places")
    at = places.select(*_AT, F.col("rank1").alias("rank"), (F.col("n_words") > 0).alias("solid"))
    k = 1
    while k < depth:
        step = min(k, depth - k)  # the last step may overlap
        later = at.select(ID, UID, (F.col("line_no") - step).alias("line_no"),
                          F.col("rank").alias("then"), F.col("solid").alias("then_solid"))
        pairs = written(at.join(later, _AT).select(
            *_AT, "rank", "then", (F.col("solid") | F.col("then_solid")).alias("solid")),
            f"lines-pairs{k}")
        ids = _ranked(pairs, "next", ["rank", "then"])
        at = pairs.join(ids, ["rank", "then"]).select(*_AT, F.col("next").alias("rank"), "solid")
        k += step
    return places.join(at, _AT, "left")


def _later(rows: DataFrame, rank: str) -> DataFrame:
    """Places that are not the first of their interval.

    The firsts are written before the join, which Spark can then split where
    an interval is large.
    """
    here = F.struct(*_AT)
    first = written(rows.groupBy(rank).agg(F.min(here).alias("first")), f"lines-first-{rank}")
    return rows.join(first, rank).where(here > F.col("first")).select(*_AT)


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES,
                   min_words: int = MIN_WORDS) -> DataFrame:
    """Places of the lines to delete, each once (repeated rows as one)."""
    rows = written(lines(docs), "lines")
    ranks = written(suffix_ranks(rows, min_lines), "lines-ranks")
    single = _later(ranks.where(F.col("n_words") >= min_words).select(*_AT, "rank1"), "rank1")
    windows = _later(ranks.where(F.col("solid")).select(*_AT, "rank"), "rank")
    covered = windows.select(ID, UID, F.explode(F.sequence(
        F.col("line_no"), F.col("line_no") + min_lines - 1)).alias("line_no"))
    return single.unionByName(covered).distinct()


def removals(docs: DataFrame, min_lines: int = MIN_LINES,
             min_words: int = MIN_WORDS) -> DataFrame:
    """Per document with deleted lines: ``gone``, one character per line up to
    the last deleted one ("1" for deleted), ``n_removed``, ``n_runs`` and
    ``longest_run`` (maximal runs of deleted lines)."""
    return settled(docs.sparkSession, "lines-gone",
                   lambda: _removals(docs, min_lines, min_words))


def _removals(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    per = repeated_lines(docs, min_lines, min_words).groupBy(ID, UID).agg(
        F.array_sort(F.collect_list("line_no")).alias("at"))
    gaps = F.transform("at", lambda g, i: F.concat(
        F.repeat(F.lit("0"), g - F.when(i > 0, F.get("at", i - 1)).otherwise(-1) - 1), F.lit("1")))
    per = per.select(ID, UID, F.size("at").alias("n_removed"),
                     F.array_join(gaps, "").alias("gone"))
    runs = F.filter(F.split("gone", "0+"), lambda r: r != "")
    return per.select(ID, UID, "n_removed", F.size(runs).alias("n_runs"),
                      F.array_max(F.transform(runs, lambda r: F.length(r))).alias("longest_run"),
                      F.col("gone").cast("binary").alias("gone"))


def _joined(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    gone = removals(docs, min_lines, min_words)
    gone = gone.select(*(F.col(c).alias(f"__g_{c}") for c in gone.columns))
    # hashed, not sorted: the documents' side is the whole corpus
    return docs.join(gone.hint("shuffle_hash"), (id_col() == F.col(f"__g_{ID}"))
                     & (uid_col() == F.col(f"__g_{UID}")), "left")


def _kept() -> Column:
    """The lines that stay, in order (the flags are read by position)."""
    return F.filter(F.split("text", "\n", -1), lambda _, i: F.substring(
        F.col("__g_gone"), i + 1, F.lit(1)) != F.lit(b"1"))


def _kept_text() -> Column:
    kept = _kept()
    return F.when(F.col("__g_gone").isNull(), F.col("text")).when(
        F.size(kept) > 0, F.array_join(kept, "\n"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later copies of repeated runs deleted; documents of
    which nothing is left go.  ``n_chars`` follows a text that changes."""
    full = _joined(docs, min_lines, min_words).withColumn("__g_text", _kept_text())
    out = full.where(F.col("__g_gone").isNull() | F.col("__g_text").isNotNull())
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__g_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("__g_gone").isNull(), F.col("n_chars")).otherwise(
                F.length("__g_text").cast(docs.schema["n_chars"].dataType)).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def report(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_runs, longest_run, kept_sha256``."""
    full = _joined(docs, min_lines, min_words)

    def count(c: str) -> Column:
        return F.coalesce(F.col(f"__g_{c}"), F.lit(0)).cast("long").alias(c)

    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return full.select(
        F.col("doc_id").cast("long").alias("doc_id"), n_lines.cast("long").alias("n_lines"),
        count("n_removed"), count("n_runs"), count("longest_run"),
        F.sha2(F.coalesce(_kept_text(), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same report in DuckDB SQL, for the default parameters.
ORACLE_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(a))) AS p, unnest(a) AS line FROM s),
n AS (SELECT *, len(regexp_extract_all(line, '[^ 	-
]+')) AS nw FROM l),
w AS (SELECT *, lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2,
             nw + lead(nw, 1) OVER d + lead(nw, 2) OVER d AS nw3
      FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS k1,
             row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, p) AS k3 FROM w),
g AS (SELECT doc_id, p FROM r WHERE nw >= 5 AND k1 > 1
      UNION
      SELECT doc_id, p + unnest([0, 1, 2]) FROM r WHERE nw3 > 0 AND k3 > 1),
f AS (SELECT n.doc_id, n.p, n.line, g.p IS NOT NULL AS gone
      FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.p = g.p),
i AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, gone ORDER BY p) AS island FROM f),
runs AS (SELECT doc_id, island, count(*) AS n FROM i WHERE gone GROUP BY 1, 2),
rr AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM runs GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS h
      FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines,
       coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(rr.n_runs, 0)::BIGINT AS n_runs,
       coalesce(rr.longest_run, 0)::BIGINT AS longest_run,
       coalesce(k.h, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN rr ON d.doc_id = rr.doc_id
"""
