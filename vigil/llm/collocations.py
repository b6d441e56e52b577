r"""Phrase collocations from sorted count streams.

One pass counts the words of each language.  A second gives one window of
three words per word occurrence, cut at the end of its piece; only words that
are frequent enough for a candidate take part (a bitmap of fixed size tells,
words that share a bit by chance only cost time).  Words are numbers there:
64-bit hashes of (language, word), which the word table proves to be distinct,
or else they are drawn anew with another seed.

Windows are counted by sorting, without hash tables: partial counts go into
the order of their prefixes (first two words, third word), and one scan adds up equal
neighbours and at once the counts of the windows' first two words.  Equal first
words stay together, so sums under ``MIN_COUNT`` go at once; a first word with
more than a thousandth of all occurrences (there are at most a thousand) is
dealt out by its second word, too, and pairs of such words by the third, whose
parts are added up afterwards.

Left, right and extension counts are then lockstep merges of those streams
(sort-merge joins): in prefix order for a candidate's first part, in suffix
order for its last part, and both for the longer candidates around it.

Rules.  Only A-Z are lower-cased.  Texts are cut into pieces at
``.,;:!?`` and line breaks (0x0A-0x0D), pieces into words at spaces and tabs.
Everything is counted per language; a null language is ``und``.  Null and
empty texts have no words.  Every row counts, a repeated one too.  An empty
table gives an empty result.  Columns besides text and lang are not read.
Scores are exact integers (decimals of 38 digits: counts up to 10^15).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import schema_of, settled, written

MIN_COUNT = 10
TOP = 2000
#: Characters whose words or windows are counted together before they leave a task.
CHUNK = 6_000_000
#: Rows of an Arrow batch.
ROWS = 1 << 16
#: Bits of the map of frequent words.
BITS = 1 << 26
#: A first word with more than this share of all occurrences is dealt out.
HOT = 1000

_ENDS = ".,;:!?\n\x0b\x0c\r"
_TOKEN = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")


def tokens(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Word numbers of some texts one after the other (0: a piece ends) and
    the names of the numbers from 1 on."""
    # bytes.lower() changes A-Z only
    text = "\n".join(texts).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    coded = pa.array(_TOKEN.findall(text), pa.large_string()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    is_word = np.array([t[0] not in _ENDS for t in names], bool)
    number = np.where(is_word, np.cumsum(is_word), 0)
    ids = number[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    return ids, [t for t, w in zip(names, is_word) if w]


def hashes(lang: str, names: list[str], seed: int) -> np.ndarray:
    import xxhash

    start = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)
    got = (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), start) for w in names)
    return np.fromiter(got, np.uint64, len(names)).view(np.int64)


def count_windows(ids: np.ndarray, v: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct windows of two or three words numbered up to ``v`` (the
    third is 0 where there is none) and their counts."""
    ids = np.concatenate([ids, [0, 0]]).astype(np.int64)
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    at = (a > 0) & (b > 0)
    a, b, c = a[at], b[at], c[at]
    v += 1
    if v < 1 << 21:
        key, n = np.unique((a * v + b) * v + c, return_counts=True)
        return [key // (v * v), key // v % v, key % v], n
    key, n = np.unique(np.stack([a, b, c], axis=1), axis=0, return_counts=True)
    return list(key.T), n


def _by_chunk(docs: DataFrame, count: Callable[[str, list[str]], list], ddl: str) -> DataFrame:
    """``count(lang, texts)`` gives columns for up to ``CHUNK`` of text."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    schema = schema_of(docs.sparkSession, ddl)

    def counted(held: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(count(lang, texts), schema)], schema=schema)
            for i in range(0, batch.num_rows, ROWS):
                yield batch.slice(i, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                if size > CHUNK:
                    yield from counted(held)
                    held, size = {}, 0
        yield from counted(held)

    return rows.mapInArrow(run, ddl)


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """``h, lang, word, n`` for all words, and the seed of the hashes ``h``."""
    seed = 0
    while True:
        def count(lang: str, texts: list[str], seed: int = seed) -> list:
            ids, names = tokens(texts)
            n = np.bincount(ids, minlength=len(names) + 1)[1:]
            return [hashes(lang, names, seed), [lang] * len(names), names, n]

        rows = _by_chunk(docs, count, "h long, lang string, word string, n long")
        words = written(rows.groupBy("h", "lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
        clash = words.groupBy("h").agg(F.count("*").alias("k")).where("k > 1 or h = 0")
        if clash.isEmpty():
            return words, seed
        seed += 1


def frequent_bits(words: DataFrame) -> np.ndarray:
    """A bitmap of ``BITS`` bits, set for the hashes of the words."""
    slot = F.col("h").bitwiseAND(F.lit(BITS - 1))
    bits = words.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(
        "shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toPandas()  # BITS / 64 rows at most
    out = np.zeros(BITS // 64, np.int64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return out


_WINDOW = "h1 long, h2 long, h3 long, spread int, n long"


def windows(docs: DataFrame, words: DataFrame, seed: int) -> DataFrame:
    """``h1, h2, h3, spread, n``: windows of frequent words, counted per
    ``CHUNK`` of text.  ``spread``: 1 for a hot first word, 2 for a pair."""
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = words.where(F.col("n") * HOT > total).select("h").toPandas()["h"]  # under HOT rows
    held = docs.sparkSession.sparkContext.broadcast(
        (frequent_bits(words), np.sort(hot.to_numpy(np.int64))))

    def count(lang: str, texts: list[str]) -> list:
        bits, hot = held.value
        ids, names = tokens(texts)
        h = hashes(lang, names, seed)
        slot = h & (BITS - 1)
        known = (bits[slot >> 6] >> (slot & 63)) & 1
        number = np.concatenate([[0], np.where(known, np.arange(1, len(h) + 1), 0)])
        parts, n = count_windows(number[ids], len(h))
        h = np.concatenate([[0], h])
        h1, h2, h3 = (h[p] for p in parts)
        first, second = np.isin(h1, hot), np.isin(h2, hot)
        return [h1, h2, h3, first * (1 + second), n]

    return _by_chunk(docs, count, _WINDOW)


_STREAM = "k int, h1 long, h2 long, h3 long, n long"


class _Sums:
    """Sums over runs of equal keys of a sorted stream, batch by batch."""

    def __init__(self) -> None:
        self.open: tuple[list[int], int, bool] | None = None

    def add(self, keys: list[np.ndarray], new: np.ndarray, n: np.ndarray, part: np.ndarray
            ) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """Finished runs: keys, sums, whether other partitions hold parts."""
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(n, starts)
        if self.open is not None:
            if self.open[0] == [int(k[0]) for k in keys]:
                sums[0] += self.open[1]
            else:
                yield from self.close()
        done = starts[:-1]
        yield [k[done] for k in keys], sums[:-1], part[done]
        last = starts[-1]
        self.open = [int(k[last]) for k in keys], int(sums[-1]), bool(part[last])

    def close(self) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        if self.open is not None:
            keys, total, part = self.open
            yield [np.array([k]) for k in keys], np.array([total]), np.array([part])
        self.open = None


def count_streams(counts: DataFrame, least: int) -> DataFrame:
    """One scan of the windows in prefix order: trigrams (``k`` 3, whole) and
    bigrams (2, whole or in parts) that occur ``least`` times."""
    order = ["h1", "h2", "h3"]
    place = (F.when(F.col("spread") == 0, F.xxhash64("h1")).when(
        F.col("spread") == 1, F.xxhash64("h1", "h2")).otherwise(F.xxhash64(*order)))
    # the hash in front decides nearly every comparison of the sort
    stream = counts.repartition(place).withColumn("prefix", F.xxhash64("h1", "h2")
                                                  ).sortWithinPartitions("prefix", *order).drop("prefix")
    schema = schema_of(counts.sparkSession, _STREAM)

    def rows(keys: list, n: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        keep = n >= least
        if len(keys) == 3:  # those cut short by their piece's end are no trigrams
            keep &= keys[2] != 0
        else:
            keep |= part
        keys = [k[keep] for k in keys]
        none = [np.zeros(int(keep.sum()), np.int64)] * (3 - len(keys))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(int(keep.sum()), len(keys), np.int32)),
             *map(pa.array, [*keys, *none]), pa.array(n[keep])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, three = _Sums(), _Sums()

        def scan(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in order]
            n, part = table.column("n").to_numpy(), table.column("spread").to_numpy() == 2
            new = np.ones(len(n), bool)
            new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
            for got in two.add(keys[:2], new, n, part):
                yield rows(*got)
            new[1:] |= keys[2][1:] != keys[2][:-1]
            for got in three.add(keys, new, n, part):
                yield rows(*got)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= ROWS:
                yield from scan(held)
                held, size = [], 0
        if held:
            yield from scan(held)
        for sums in (two, three):
            for got in sums.close():
                yield rows(*got)

    return stream.mapInArrow(run, _STREAM)


def _score(a: str, left: str, right: str) -> Column:
    d = "decimal(15,0)"
    return F.expr(f"cast((cast({a} as {d}) * cast({a} as {d}) * cast(1000000 as decimal(7,0)))"
                  f" div (cast({left} as {d}) * cast({right} as {d})) as long)")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first
    ``top`` phrases of two or three words that occur ``least`` times."""
    return settled(docs.sparkSession, "phrases", lambda: _collocations(docs, least, top))


def _collocations(docs: DataFrame, least: int, top: int) -> DataFrame:
    words, seed = count_words(docs)
    one = written(words.where(F.col("n") >= least), "phrase-1")
    streams = written(count_streams(windows(docs, one, seed), least), "phrase-streams")
    two = streams.where("k = 2").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    two = written(two.where(F.col("n") >= least), "phrase-2")
    three = streams.where("k = 3").select("h1", "h2", "h3", F.col("n").alias("a"))

    def word(i: int) -> DataFrame:
        return one.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"),
                          F.col("n").alias(f"f{i}")).hint("merge")

    def pair(i: int) -> DataFrame:
        return two.select(F.col("h1").alias(f"h{i}"), F.col("h2").alias(f"h{i + 1}"),
                          F.col("n").alias(f"f{i}{i + 1}")).hint("merge")

    # prefix order, then suffix order
    three = (three.join(pair(1), ["h1", "h2"]).join(word(1), "h1")
             .join(pair(2), ["h2", "h3"]).join(word(3), "h3").join(word(2), "h2"))
    three = three.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    three = written(three.select(
        "h1", "h2", "h3", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score")), "phrase-3")
    longer = three.select("h1", "h2", "a").unionByName(three.select(
        F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    longer = written(longer.groupBy("h1", "h2").agg(F.max("a").alias("longer")), "phrase-longer")
    pairs = (two.withColumnRenamed("n", "a")
             .join(longer.hint("merge"), ["h1", "h2"], "left")
             .where(F.coalesce(F.col("longer") * 100 < F.col("a") * 50, F.lit(True)))
             .join(word(1), "h1").join(word(2), "h2")
             .select("h1", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"),
                     F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score")))
    every = pairs.unionByName(three.drop("h2", "h3")).join(
        one.select(F.col("h").alias("h1"), "lang").hint("merge"), "h1")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i:i])) AS ph FROM w
  UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) FROM w
  UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) FROM w),
f AS (SELECT lang, ph, len(ph) AS k, array_to_string(ph, ' ') AS s, count(*) AS f
      FROM g GROUP BY lang, ph),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, ph, k, f AS a FROM f WHERE k >= 2 AND f >= 10),
cut AS (
  SELECT lang, ph, k, a, 1 AS j, ph[1] AS s1, array_to_string(ph[2:], ' ') AS s2 FROM c
  UNION ALL
  SELECT lang, ph, k, a, 2, array_to_string(ph[1:2], ' '), ph[3] FROM c WHERE k = 3),
cuts AS (
  SELECT c.lang, c.ph, c.k, c.a, c.j, x.f AS l, y.f AS r,
         (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.s = c.s1 JOIN f y ON y.lang = c.lang AND y.s = c.s2),
best AS (SELECT * FROM cuts
         QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
inside AS (
  SELECT lang, ph[1:2] AS ph, a FROM c WHERE k = 3
  UNION ALL SELECT lang, ph[2:3], a FROM c WHERE k = 3),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.ph = b.ph AND 100 * i.a >= 50 * b.a)),
r AS (
  SELECT lang, row_number() OVER (PARTITION BY lang
           ORDER BY score DESC, a DESC, encode(array_to_string(ph, ' '))) AS rank,
         array_to_string(ph, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM r JOIN total USING (lang) WHERE rank <= 2000"""
