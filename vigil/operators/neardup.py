"""Near-duplicate detection (U03): exact Jaccard over whole-text shingles.

For each text, ``near_dup_of`` is the earliest earlier text of the same
group (topic) whose shingle set has Jaccard similarity >= ``num/den``; a
scorer caps later copies below the near-duplicate score.

Plan:

1. shingles = distinct word ``k``-grams of the whole text, as sorted 64-bit
   ids, built by numpy in Arrow batches.  Whole sets are larger than the texts,
   so they are not kept: they are built again where they are needed;
2. a **global order** of shingles: by the count of a shingle's slot in a table
   of fixed size (all texts counted), then by id.  Shingles that share a slot
   add up, which only moves them in the order; any order is exact;
3. **prefix filtering** (exact for Jaccard): under one global order two sets
   with ``J >= t`` share a shingle among their first ``|A| - ceil(t|A|) + 1``;
   only prefixes travel, once, and only shingles that two sets have are kept;
4. **exact copies collapse**: texts with the same shingle set (by a 128-bit
   digest) map to their smallest id, so a passage copied a thousand times is
   one representative, not a million pairs;
5. candidates come from an equi-join on prefix shingles plus the length filter
   ``t|A| <= |B| <= |A|/t`` and the positional filter: what two sets share
   is at most what lies before and after a common shingle in both.  All common
   prefix shingles of a pair are counted: they and what lies behind the last of
   them, or behind the prefix that ends first, must reach the overlap that ``t``
   asks for.  Never a cross join;
6. each text first meets the earliest text of its shingles, so that where many
   are alike their pairs are not formed; then only what is earlier than the one
   found is a candidate;
7. verification of the whole sets in integer arithmetic, of the earliest
   candidate first: a text that is similar to it needs no other.

Tables are dropped and shuffle files removed as soon as the next table is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.session import scratch_path

#: Slots of the table of shingle counts (fixed, whatever the texts), and of the
#: pieces in which tasks pass it on.
SLOTS, PIECE = 1 << 22, 1 << 13
#: Bytes of text that are cut into shingles at once, words remembered.
CHUNK, WORDS = 1 << 20, 1 << 20
#: Candidates of a text that are verified up to a round, times those before.
GROWTH = 8


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct word ``k``-grams of the whole text (fewer words: one shingle).

    Built from ``k`` shifted copies of the token array zipped together — linear
    in the text (a lambda indexing into the token expression would re-split
    the text once per position)."""
    toks = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    n = F.size(toks)
    shifted = [toks] + [F.slice(toks, j + 1, 1 << 30) for j in range(1, k)]
    zipped = F.slice(F.arrays_zip(*shifted), 1, F.greatest(n - k + 1, F.lit(1)))
    grams = F.transform(zipped, lambda z: F.concat_ws(" ", *[z[str(j)] for j in range(k)]))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def shingle_ids(text: Column, k: int = 3) -> Column:
    """Sorted distinct 64-bit ids of the word ``k``-grams of the whole text:
    ``xxhash64`` over the ``k`` tokens themselves (no joined strings)."""
    toks = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    n = F.size(toks)
    shifted = [toks] + [F.slice(toks, j + 1, 1 << 30) for j in range(1, k)]
    zipped = F.slice(F.arrays_zip(*shifted), 1, F.greatest(n - k + 1, F.lit(1)))
    ids = F.transform(zipped, lambda z: F.xxhash64(*[z[str(j)] for j in range(k)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.array_sort(F.array_distinct(ids)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread rows over the cluster when the input arrives in fewer
    partitions than there are cores (one large file); a well-split input is
    left alone (no extra shuffle)."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(texts: list[bytes], k: int, seen: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle ids of texts, one after the other, and offsets."""
    words = [t.split() for t in texts]  # bytes: cut at the white space of ``\\s``
    if len(seen) > WORDS:
        seen.clear()
    size = np.array([len(w) for w in words], np.int64)
    room = np.where(size > 0, np.maximum(size, k), 0)
    owner = np.repeat(np.arange(len(texts)), room)
    flat = np.zeros(len(owner), np.uint64)
    start = np.cumsum(room) - room
    real = np.arange(len(owner)) - start[owner] < size[owner]
    flat[real] = np.fromiter(map(seen.__getitem__, chain.from_iterable(words)), np.uint64,
                             int(size.sum()))
    if len(flat) < k:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    flat = _mix(flat)
    h = np.zeros(len(flat) - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[j:j + len(h)]
    whole = owner[:len(h)] == owner[k - 1:]
    h, owner = _mix(h[whole]).view(np.int64), owner[:len(h)][whole]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(ends, ends[1:]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))])


#: Removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Tables that an operator writes on its way, each as one query whose shuffle
    files go when it ends; they are dropped when nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.paths = spark, label, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        conf, path = self.spark.conf, scratch_path(self.spark, f"{self.label}-{name}-{uuid.uuid4().hex}")
        self.paths.setdefault(name, []).append(path)
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in chain.from_iterable(self.paths.pop(n, []) for n in names):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def result(self, df: DataFrame) -> DataFrame:
        """The last table; all others are dropped."""
        out = self.write(df, "result")
        self.drop(*[n for n in self.paths if n != "result"])
        return out

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.drop(*list(self.paths))


def _mapped(df: DataFrame, fn, fields: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` for a function from batches to lists of columns."""
    schema = T.StructType(fields)
    frame = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type)
                 for c, f in zip(columns, frame)], schema=frame)

    return df.mapInArrow(run, schema)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > CHUNK:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(batch, rows, offsets, shingles) of the texts with a word, chunk by chunk."""
    seen = _Words()
    for batch in batches:
        own = batch.column("text").to_pylist()
        for a, b in _chunks(own):
            h, offsets = shingles_of(own[a:b], k, seen)
            full = np.flatnonzero(np.diff(offsets))
            if len(full):
                yield batch, full + a, np.append(offsets[:-1][full], len(h)), h


def shingle_sets(rows: DataFrame, k: int) -> DataFrame:
    """``id, n, hs`` of each of ``rows(id, grp, text)`` with a word."""
    def run(batches):
        for batch, full, ends, h in _sets(batches, k):
            yield [batch.column("id").take(pa.array(full)), np.diff(ends), _lists(ends, h)]

    return _mapped(rows, run, [rows.schema["id"], T.StructField("n", T.IntegerType()),
                               T.StructField("hs", T.ArrayType(T.LongType()))])


def _slot_counts(rows: DataFrame, k: int) -> np.ndarray:
    """Shingles of all texts per slot."""
    schema = T.StructType([T.StructField("piece", T.IntegerType()),
                           T.StructField("counts", T.BinaryType())])
    frame = to_arrow_schema(schema)

    def count(batches):
        total = np.zeros(SLOTS, np.uint32)
        for _, _, _, h in _sets(batches, k):
            np.add.at(total, h & (SLOTS - 1), np.uint32(1))
        parts = total.reshape(-1, PIECE)
        used = np.flatnonzero(parts.any(axis=1))
        yield [used, pa.array([parts[i].tobytes() for i in used], pa.binary())]

    def add(table: pa.Table) -> pa.Table:
        both = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in table["counts"].to_pylist())
        both = np.minimum(both, 2 ** 32 - 1).astype(np.uint32)
        return pa.Table.from_pydict({"piece": table["piece"][:1], "counts": [both.tobytes()]},
                                    schema=frame)

    # a table for each core, not for each file
    few = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    with Tables(rows.sparkSession, "neardup") as held:
        got = held.write(_mapped(few, count, schema.fields).groupBy("piece").applyInArrow(add, schema),
                         "slots")
        out = np.zeros((SLOTS // PIECE, PIECE), np.uint32)
        for r in got.toLocalIterator():  # SLOTS counts
            out[r.piece] = np.frombuffer(r.counts, np.uint32)
        held.drop("slots")
    return out.ravel()


def prefixes(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``id, grp, n, s1, s2, ps`` of each text with a word: a 128-bit digest of its
    set and the first ``n - ceil(n * num / den) + 1`` shingles in the global order."""
    slots = rows.sparkSession.sparkContext.broadcast(_slot_counts(rows, k))  # SLOTS counts of 4 bytes
    long = T.LongType()

    def run(batches):
        for batch, full, ends, h in _sets(batches, k):
            n, u, pick = np.diff(ends), h.view(np.uint64), pa.array(full)
            s1 = np.add.reduceat(_mix(u), ends[:-1]).view(np.int64)
            s2 = np.add.reduceat(_mix(u ^ np.uint64(0xD6E8FEB86659FD93)), ends[:-1]).view(np.int64)
            length = n - -(-n * num // den) + 1
            count = slots.value[h & (SLOTS - 1)]
            first = [a + np.argsort(count[a:b], kind="stable")[:m]  # sorted by id before
                     for a, b, m in zip(ends[:-1].tolist(), ends[1:].tolist(), length.tolist())]
            yield [batch.column("id").take(pick), batch.column("grp").take(pick), n, s1, s2,
                   _lists(np.append(0, np.cumsum(length)), h[np.concatenate(first)])]

    return _mapped(rows, run, [rows.schema["id"], rows.schema["grp"], T.StructField("n", T.IntegerType()),
                               T.StructField("s1", long), T.StructField("s2", long),
                               T.StructField("ps", T.ArrayType(long))])


def _reachable(ma: Column, pa_: Column, mb: Column, pb: Column, num: int, den: int) -> Column:
    """Sets of ``ma`` and ``mb`` shingles with a common one at ``pa_`` and ``pb`` in
    the global order can be similar: by their lengths, and by what lies before and
    behind it in both."""
    most = F.least(pa_, pb) + F.least(ma - pa_, mb - pb)
    return ((ma * den >= mb * num) & (mb * den >= ma * num) & (most * (num + den) >= (ma + mb) * num))


def _counted(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """``id1, id2, c`` of the pairs whose ``c`` common prefix shingles let them be
    similar.  Others that both have lie behind the last common one in both sets,
    and behind the whole prefix in the set whose prefix ends first."""
    got = pairs.groupBy("id1", "id2").agg(
        F.count("*").alias("c"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.first("m1").alias("m1"), F.first("m2").alias("m2"))
    m1, m2 = F.col("m1").cast("long"), F.col("m2").cast("long")
    behind = F.least(m1 - F.col("p1"), m2 - F.col("p2")) - 1
    outside = F.floor((F.greatest(m1, m2) * num + (den - 1)) / den) - 1  # ceil(m * num / den) - 1
    most = F.col("c") + F.least(behind, outside)
    return got.where(most * (num + den) >= (m1 + m2) * num).select("id1", "id2", "c")


def _shared(docs: DataFrame, sig: list[str]) -> DataFrame:
    """``id, grp, m, p, h, first`` of every prefix shingle that two sets of a group
    have; ``first`` is its earliest ``(id, m, p)``."""
    reps = docs.where(F.col("grp").isNotNull()).groupBy(*sig).agg(
        F.min("id").alias("id"), F.first("n").alias("m"), F.first("ps").alias("ps"))
    prefix = reps.select("id", "grp", "m", F.posexplode("ps").alias("p", "h"))
    list_ = Window.partitionBy("grp", "h")
    return (prefix.withColumn("first", F.min(F.struct("id", "m", "p")).over(list_))
            .withColumn("last", F.max("id").over(list_))
            .where(F.col("first.id") < F.col("last")).drop("last"))


def _to_first(shared: DataFrame, num: int, den: int) -> DataFrame:
    """``id1, id2``: for a text the one that comes first at most of its shingles."""
    f = F.col("first")
    met = shared.where((f["id"] < F.col("id")) & _reachable(f["m"], f["p"], F.col("m"), F.col("p"), num, den))
    met = _counted(met.select(f["id"].alias("id1"), F.col("id").alias("id2"), f["m"].alias("m1"),
                              F.col("m").alias("m2"), f["p"].alias("p1"), F.col("p").alias("p2")), num, den)
    return met.groupBy("id2").agg(F.min(F.struct(-F.col("c"), "id1")).alias("m")).select(
        F.col("m.id1").alias("id1"), "id2")


def _to_others(shared: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """``id1, id2``: every candidate that is earlier than the one found."""
    upto = found.select(F.col("rep").alias("id"), F.col("rep_dup").alias("upto"))
    b = shared.join(upto, "id", "left").withColumn("upto", F.coalesce("upto", "id")).where(
        F.col("first.id") < F.col("upto")).alias("b")
    a = shared.alias("a")
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.grp") == F.col("b.grp"))
                 & (F.col("a.id") < F.col("b.upto"))
                 & _reachable(F.col("a.m"), F.col("a.p"), F.col("b.m"), F.col("b.p"), num, den))
    return _counted(met.select(*[F.col(f"{t}.{c}").alias(f"{c}{i}") for i, t in ((1, "a"), (2, "b"))
                                 for c in ("id", "m", "p")]), num, den).select("id1", "id2")


def _earliest(cands: DataFrame, rows: DataFrame, k: int, num: int, den: int, held: Tables) -> DataFrame:
    """The earliest candidate ``id1`` of each ``id2`` that is similar enough.
    Candidates are verified exactly from the earliest on, in rounds of one, then
    ``GROWTH`` times as many for the texts still without one."""
    order = Window.partitionBy("id2").orderBy("id1")
    sets = held.write(_wanted(cands, rows, k), "sets")
    rest = held.write(cands.withColumn("r", F.row_number().over(order)), "rest0")
    upto, found, round_ = 1, None, 0
    while found is None or not rest.isEmpty():
        now = rest.where(F.col("r") <= upto).drop("r")
        got = held.write(_verified(now, sets, num, den), "found")
        found = got if found is None else found.unionByName(got)
        rest = held.write(rest.where(F.col("r") > upto).join(
            got.select(F.col("rep").alias("id2")), "id2", "left_anti"), f"rest{round_ + 1}")
        held.drop(f"rest{round_}")
        upto, round_ = upto * GROWTH, round_ + 1
    held.drop("sets", f"rest{round_}")
    return found


def _wanted(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The whole sets of the texts in these pairs."""
    needed = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    return shingle_sets(rows.join(needed, "id", "left_semi"), k)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The earliest of each ``id2`` among these pairs; only their sets travel."""
    needed = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    wanted = sets.select("id", "hs", "n").join(needed, "id", "left_semi")
    s1 = wanted.select(F.col("id").alias("id1"), F.col("hs").alias("sh1"), F.col("n").alias("n1"))
    s2 = wanted.select(F.col("id").alias("id2"), F.col("hs").alias("sh2"), F.col("n").alias("n2"))
    # the set sides carry whole shingle arrays: never broadcast them
    both = (pairs.join(s1.hint("merge"), "id1").join(s2.hint("merge"), "id2")
            .withColumn("inter", F.size(F.array_intersect("sh1", "sh2")))
            .withColumn("union", F.col("n1") + F.col("n2") - F.col("inter"))
            .where(F.col("inter") * den >= F.col("union") * num))
    return both.groupBy("id2").agg(
        F.min_by(F.struct("id1", (F.col("inter") / F.col("union")).alias("j")), "id1").alias("m")).select(
        F.col("id2").alias("rep"), F.col("m.id1").alias("rep_dup"), F.col("m.j").alias("rep_j"))


def near_duplicates(texts: DataFrame, id_col: str = "doc_id", group: str = "topic",
                    text: str = "text", num: int = 4, den: int = 5, k: int = 3) -> DataFrame:
    """``(id, group, n_shingles, near_dup_of, jaccard)`` per non-empty text; one
    without a group is like no other."""
    # Two different shingles share an id with probability ~2^-64, so a pair's
    # overlap is exact except with probability ~|A||B|/2^64.
    rows = spread(texts, id_col).select(
        F.col(id_col).alias("id"), F.col(group).alias("grp"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    sig = ["grp", "s1", "s2"]
    with Tables(texts.sparkSession, "neardup") as held:
        docs = held.write(prefixes(rows, k, num, den), "docs")

        # exact copies → representative (smallest id of the identical set)
        own = docs.groupBy(*sig).agg(F.min("id").alias("rep")).select(
            *[F.col(c).alias(f"r_{c}") for c in sig], "rep")
        members = docs.select("id", "n", *sig).join(
            own, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in sig]).select("id", "grp", "n", "rep")
        shared = held.write(_shared(docs, sig), "shared")

        pairs = held.write(_to_first(shared, num, den), "pairs")
        sets = held.write(_wanted(pairs, rows, k), "sets")
        near = held.write(_verified(pairs, sets, num, den), "near")
        held.drop("pairs", "sets")

        cands = held.write(_to_others(shared, near, num, den), "candidates")
        held.drop("shared")
        both = near.unionByName(_earliest(cands, rows, k, num, den, held))
        best = both.groupBy("rep").agg(F.min("rep_dup").alias("rep_dup"),
                                       F.min_by("rep_j", "rep_dup").alias("rep_j"))

        out = members.join(best, "rep", "left")
        is_rep = (F.col("id") == F.col("rep")) | F.col("grp").isNull()  # no group: no copies
        of = F.when(is_rep, F.col("rep_dup")).otherwise(F.coalesce(F.col("rep_dup"), F.col("rep")))
        jac = F.when(is_rep, F.col("rep_j")).otherwise(F.coalesce(F.col("rep_j"), F.lit(1.0)))
        return held.result(out.select(F.col("id").alias(id_col), F.col("grp").alias(group), "n",
                                      of.alias("near_dup_of"), jac.alias("jaccard")))


def near_dup_cap(scored: DataFrame, dups: DataFrame, id_col: str = "doc_id",
                 score: str = "novelty_score", cap: float = 0.39) -> DataFrame:
    """Later copies of an earlier text score at most ``cap``."""
    d = dups.select(id_col, "near_dup_of")
    return (scored.join(d, id_col, "left")
            .withColumn(score, F.when(F.col("near_dup_of").isNotNull(),
                                      F.least(F.col(score), F.lit(cap))).otherwise(F.col(score))))
