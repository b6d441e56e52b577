r"""Spelling variants by permuterm rotations.

A word is marked with a terminator and rotated.  After the rotation that puts
the edited character last, words that differ by a replacement there are equal
but for that last character, and a word that lacks the character is the same
string without it: the rotation ``s$p`` of ``ps`` is the prefix of the
rotation ``s$pc`` of ``pcs``.  So all rotations are sorted by range, each word
once whole and once without its last character; equal keys are a prefix range
that skips the edited character, and a scan of the sorted range gives every
word its near words there.  A group holds at most one whole rotation and one
word per letter, so it is bounded by the alphabet, however common a word is.
A replacement pair meets in one group only.  A deletion inside a run of equal
letters would meet in several, so it counts at the run's first letter only.

The scan returns one row per word and group with near words: their number and
the best one (in the sort order: most frequent, then smallest), no pairs.

Rules.  Words are runs of ``[A-Za-zÀ-ÿ]`` of the whole texts, only
A-Z lower-cased.  With ``h`` the crc32 of ``<doc_id>:<run>``, a run whose ``h``
97 divides loses its letter ``h % length``.  Words have at least 5 letters and
3 occurrences.  A null text has no words, a null doc_id is written as nothing
before the colon; every row counts, a repeated one too.  An empty table gives
an empty result.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import schema_of, settled, written

MIN_LENGTH, MIN_COUNT = 5, 3
#: A word's form is at least so many times as frequent.
FACTOR = 2
DROP_EVERY = 97
#: Words that a task counts before they leave it.
HELD = 300_000
#: Sorted rows that a scan takes at once.
ROWS = 1 << 16

_RUN = re.compile("[a-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """Words of one text with their numbers."""
    # bytes.lower() changes A-Z only
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(_RUN.findall(low)).items():
        if len(word) < MIN_LENGTH:
            continue
        h = zlib.crc32(word.encode(), start)
        if h % DROP_EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < MIN_LENGTH:
                continue
        yield word, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all texts, pre-aggregated in the tasks."""
    schema = schema_of(docs.sparkSession, "word string, n long")

    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())},
                                          schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("text").to_pylist()):
                for word, n in words_of(doc_id, text or ""):
                    total[word] += n
                if len(total) > HELD:
                    yield out(total)
                    total = Counter()
        yield out(total)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """``key, word, n, skip, first``: whole rotations, and those that skip the
    last letter (``first``: it is not also the letter before it)."""
    return words.select("word", "n", F.explode(F.expr("""concat(
        transform(sequence(0, length(word)), i -> struct(
            concat(substr(word, i + 1), '$', substr(word, 1, i)) as key,
            false as skip, false as first)),
        transform(sequence(0, length(word) - 1), i -> struct(
            concat(substr(word, i + 2), '$', substr(word, 1, i)) as key,
            true as skip, i = 0 or substr(word, i + 1, 1) <> substr(word, i, 1) as first)))
        """)).alias("r")).select("r.key", "word", "n", "r.skip", "r.first")


_FOUND = "word string, n_near long, near_n long, near string"


def scan(rows: pa.Table) -> dict:
    """Near words inside each group of equal keys; rows are in sort order, so
    the earlier of two rows of a group is the better form."""
    size = rows.num_rows
    key = rows.column("key").combine_chunks()
    new = np.ones(size, bool)
    new[1:] = pc.not_equal(key.slice(1), key.slice(0, size - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    skip, first = (rows.column(c).to_numpy() for c in ("skip", "first"))
    at = np.arange(size)

    def earliest(which: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(which, at, size), starts)[group]

    whole, top = earliest(~skip), earliest(skip)
    second = earliest(skip & (at != top))
    replaced = np.where(at == top, second, top)
    best = np.where(skip, np.minimum(replaced, np.where(first, whole, size)),
                    earliest(skip & first))
    n_skip, n_first = (np.add.reduceat(x.astype(np.int64), starts)[group] for x in (skip, first))
    count = np.where(skip, n_skip - 1 + (first & (whole < size)), n_first)
    hit = np.flatnonzero(count)
    word, n = rows.column("word"), rows.column("n")
    return {"word": word.take(hit).combine_chunks(), "n_near": count[hit],
            "near_n": n.take(best[hit]).combine_chunks(),
            "near": word.take(best[hit]).combine_chunks()}


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``: number of near words and the best."""
    schema = schema_of(words.sparkSession, _FOUND)
    rows = rotations(words).repartitionByRange("key").sortWithinPartitions(
        "key", F.desc("n"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                yield pa.RecordBatch.from_pydict(scan(table), schema=schema)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").chunk(0)
                # the last group may go on in the next batch
                cut = pc.index(key, key[-1]).as_py()
                yield from found(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size -= cut
        if held:
            yield from found(pa.Table.from_batches(held))

    got = rows.mapInArrow(run, _FOUND)
    return got.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("b")
    ).select("word", "n_near", (-F.col("b.n")).alias("near_n"), "b.near")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``, by pointer doubling: a form is twice
    as frequent as its word, so chains end, after few steps."""
    chain = forms.select("word", F.col("form").alias("root"))
    while True:
        after = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = written(chain.select("word", "root").join(after, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")),
            "spelling-chain")
        if chain.where("more").isEmpty():
            return chain.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word."""
    return settled(docs.sparkSession, "spelling", lambda: _variants(docs))


def _variants(docs: DataFrame) -> DataFrame:
    words = written(vocabulary(docs), "spelling-words")
    near = written(neighbours(words), "spelling-near")
    common = F.col("near_n") >= FACTOR * F.col("n")
    rows = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(common, F.col("near")).alias("form"), F.when(common, F.col("near_n")).alias("form_n")),
        "spelling-forms")
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 from its rule: byte by byte, with the table of the reflected polynomial.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1
             THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, i) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
run AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\x{C0}-\x{FF}]+')) AS w
    FROM documents) GROUP BY doc_id, w),
hexed AS (
  SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x
  FROM run WHERE length(w) >= 5),
hashed AS (
  SELECT w, n, xor(list_reduce(list_transform(range(1, length(x), 2),
           lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT)),
         CAST(4294967295 AS BIGINT)) AS h
  FROM hexed, tab),
word AS (
  SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2)
                ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
gap AS (
  SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 2) AS s
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)),
pair AS (
  SELECT x.word AS a, y.word AS b, y.n AS bn FROM gap x JOIN gap y
    ON x.p = y.p AND x.s = y.s AND x.word <> y.word
  UNION
  SELECT x.word, y.word, y.n FROM gap x JOIN word y ON y.word = x.p || x.s
  UNION
  SELECT y.word, x.word, x.n FROM gap x JOIN word y ON y.word = x.p || x.s),
near AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-bn, encode(b))) AS best, max(bn) AS best_n
  FROM pair GROUP BY a),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN best_n >= 2 * w.n THEN best END AS form,
         CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM word w LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN walk k ON k.word = f.word
JOIN formed e ON e.word = k.at AND e.form IS NULL"""
