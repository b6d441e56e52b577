"""Near duplicates of embeddings by spherical-cap filters.

Filters are directions on the sphere.  They come from ``CODES`` structured
random product codes: a random rotation, then two halves of the coordinates
with ``WORDS`` random unit vectors each; every pair of such vectors is a filter
direction.  A vector goes to every filter whose direction it exceeds, that is
whose cosine with it is at least ``cut``; list decoding finds these among the
WORDS^2 directions of a code from the 2 * WORDS half products, by the halves'
best possible sums.  Vectors of one filter are compared by exact cosines in
double precision.  Two vectors at cosine 0.9 share a filter in 99 % of all
cases, closer ones nearly always (measured, see the tests).

No bucket is gathered whole and no pairs are emitted:

* copies of one vector are one node with its number of copies;
* in crowded filters, nodes within half the link angle of the centre of those
  that chose the filter are linked to each other by the triangle inequality.
  Such a clique is counted, never compared inside;
* the other members of a filter are dealt into blocks of about ``BLOCK``, and
  pairs of blocks are compared as matrix products.  A pair of nodes counts in
  the first of the filters that they share.  The comparison returns one row per
  node with links: how many, and one node of its component there.

Classes are the connected components of these links and the cliques.

Rules.  A vector is a row.  Null, empty and zero vectors and those that hold
null or non-finite components link with nothing; neither do vectors of
different lengths.  Equal rows are two vectors that link with each other.  A
null vec_id sorts before all others.  An empty table gives an empty result.
Columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import NULL_ID, arrow_map, schema_of, settled, written
from vigil.llm.near_dup import components

THRESHOLD = 0.9
CODES, WORDS = 6, 2048
#: Share of the sphere that a filter's cap covers (cosine 0.53 in 64 dimensions).
CAP = 3.26e-6
#: Fewer dimensions are padded with zeros before the rotation.
LEAST_DIM = 16
#: Members of a filter from which on it may be the core of a clique.
CORE = 64
BLOCK = 512
#: Rows of whole comparisons that a task holds.
ROWS = 1 << 13
#: Larger groups are compared one by one, smaller ones all of a size at once.
SMALL = 32

_NODE = "struct<id:long,c1:long,c2:long>"


# --- filters --------------------------------------------------------------------

def cap_cosine(d: int) -> float:
    """The cosine whose cap covers the share ``CAP`` of the sphere in R^d."""
    t = np.linspace(1, 0, 200_001)
    area = np.cumsum((1 - t * t) ** ((d - 3) / 2))
    return float(t[np.searchsorted(area, CAP * 2 * area[-1])])


@lru_cache(maxsize=8)
def codes(d: int) -> tuple[list, float]:
    """Per code the rotation of padded vectors and the two halves' words."""
    wide = max(LEAST_DIM, d + d % 2)
    out = []
    for t in range(CODES):
        rng = np.random.default_rng([1607, d, t])
        turn, _ = np.linalg.qr(rng.standard_normal((wide, wide)))
        halves = rng.standard_normal((2, WORDS, wide // 2))
        halves /= np.linalg.norm(halves, axis=2, keepdims=True) * math.sqrt(2)
        out.append((turn[:d].astype(np.float32), halves.astype(np.float32)))
    return out, cap_cosine(wide)


def decode(unit: np.ndarray) -> list[np.ndarray]:
    """The filters that each unit vector exceeds, as sorted numbers."""
    d = unit.shape[1]
    every, cut = codes(d)
    out: list[list[np.ndarray]] = [[] for _ in unit]
    for t, (turn, halves) in enumerate(every):
        turned = unit.astype(np.float32) @ turn
        half = turned.shape[1] // 2
        left, right = turned[:, :half] @ halves[0].T, turned[:, half:] @ halves[1].T
        base = (d * CODES + t) * WORDS
        for i, (x, y) in enumerate(zip(left, right)):
            a, b = np.flatnonzero(x >= cut - y.max()), np.flatnonzero(y >= cut - x.max())
            u, v = np.nonzero(x[a][:, None] + y[b][None, :] >= cut)
            out[i].append((base + a[u]) * WORDS + b[v])
    return [np.concatenate(x) for x in out]


def units(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) per length of vector."""
    size = values.value_lengths().to_numpy()
    flat = values.flatten().to_numpy().astype(np.float64)
    start = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[start[rows][:, None] + np.arange(d)]
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


# --- nodes ------------------------------------------------------------------------

def _rows(vectors: DataFrame) -> DataFrame:
    """``id, c1, c2, v``: ``v`` is null for vectors that link with nothing."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = "array<float>" if kind == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    good = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one number
    v = F.when(good, F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x)))
    return vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID).cast("long"))
                          .alias("id"), v.alias("v")).select(
        "id", F.xxhash64("v").alias("c1"), F.xxhash64(F.lit(5), "v").alias("c2"), "v")


def nodes(rows: DataFrame) -> DataFrame:
    """``node, copies, v, filters``: one per distinct vector."""
    kind = dict(rows.dtypes)["v"]
    one = rows.where(F.col("v").isNotNull()).groupBy("c1", "c2").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    one = one.select(F.struct("id", "c1", "c2").alias("node"), "copies", "v")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found: list = [None] * batch.num_rows
        for at, x in units(batch.column("v")):
            for i, f in zip(at, decode(x)):
                found[i] = f
        yield {**{c: batch.column(c) for c in ("node", "copies", "v")}, "filters": found}

    return written(arrow_map(one, run, f"node {_NODE}, copies long, v {kind}, filters array<long>"),
                   "caps-nodes")


# --- cliques ------------------------------------------------------------------------

def cliques(members: DataFrame, found: DataFrame) -> DataFrame:
    """``node, core, copies``: nodes near the centre of a crowded filter, each
    in one clique.  Any two of a clique are linked."""
    core = members.where(F.col("n") >= CORE).groupBy("node").agg(
        F.max(F.struct("n", (-F.col("f")).alias("f"))).alias("m")).select(
        "node", (-F.col("m.f")).alias("core"))
    chosen = written(core.join(found.select("node", "copies", "v"), "node"), "caps-chosen")

    def sums(batch: pa.RecordBatch) -> Iterator[dict]:
        core = batch.column("core").to_numpy()
        for at, x in units(batch.column("v")):
            names, group = np.unique(core[at], return_inverse=True)
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, group, x)
            yield {"core": names, "s": list(total)}

    centre = arrow_map(chosen.select("core", "v"), sums, "core long, s array<double>")
    centre = centre.select("core", F.posexplode("s").alias("i", "x")).groupBy("core", "i").agg(
        F.sum("x").alias("x")).groupBy("core").agg(  # as many as there are dimensions
        F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    centre = written(centre.select("core", F.transform("s", lambda e: e["x"]).alias("centre")),
                     "caps-centres")

    def near(batch: pa.RecordBatch) -> Iterator[dict]:
        close = np.zeros(batch.num_rows, bool)
        whole = batch.column("centre")
        for at, x in units(batch.column("v")):
            c = whole.take(pa.array(at)).flatten().to_numpy().reshape(x.shape)
            long = np.linalg.norm(c, axis=1)
            # both within half the angle, with a margin for rounding
            half = math.sqrt((1 + THRESHOLD) / 2) + 1e-9
            close[at] = (x * c).sum(axis=1) >= half * np.maximum(long, 1e-12)
        yield {"node": batch.column("node"), "core": batch.column("core"),
               "copies": batch.column("copies"), "close": close}

    got = arrow_map(chosen.join(centre, "core"), near,
                    f"node {_NODE}, core long, copies long, close boolean")
    return written(got.where("close").drop("close"), "caps-cliques")


# --- comparisons ----------------------------------------------------------------------

def block_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with ``block``, pairs of blocks ``f, x, y``).  A block belongs
    to one filter and one clique (or none); pairs inside a clique are left out
    and so are filters that hold one clique only."""
    groups = members.groupBy("f", "core").agg(F.count("*").alias("n")).select(
        "f", "core", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n")
    need = groups.groupBy("f").agg(F.count("*").alias("k"), F.max(
        F.col("core").isNull() & (F.col("n") > 1)).alias("open"))
    need = written(need.where((F.col("k") > 1) | F.col("open")).select("f"), "caps-open")
    groups = written(groups.join(need, "f").drop("n"), "caps-groups")
    block = F.struct(F.coalesce("core", F.lit(-1).cast("long")).alias("core"), "b")
    dealt = members.join(groups, (members["f"] == groups["f"])
                         & members["core"].eqNullSafe(groups["core"])).select(
        members["f"], "node", members["core"],
        F.pmod(F.xxhash64("node", members["f"]), F.col("blocks")).cast("int").alias("b")).select(
        "f", "node", block.alias("block"))
    each = groups.select("f", "core", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    each = each.select("f", block.alias("block"))
    x, y = each.select("f", F.col("block").alias("x")), each.select("f", F.col("block").alias("y"))
    pairs = x.join(y, "f").where((F.col("x") <= F.col("y")) & (
        (F.col("x.core") != F.col("y.core")) | (F.col("x.core") == -1)))
    return dealt, written(pairs, "caps-pairs")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first common number of each row's sorted lists (padded with -1)."""
    out = np.full(len(a), -1, np.int64)
    for k in range(a.shape[1]):
        left = np.flatnonzero((out < 0) & (a[:, k] >= 0))
        if not len(left):
            break
        hit = left[(b[left] == a[left, k][:, None]).any(axis=1)]
        out[hit] = a[hit, k]
    return out


def links_of(x: np.ndarray, side: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Linked rows (i, j) of groups of ``size`` rows: of the same side 0, or of
    sides 0 and 1 where a group has both (sorted by side)."""
    ends = np.cumsum(size)
    starts = ends - size
    both = side[ends - 1] == 1
    for s in np.unique(size[size <= SMALL]):
        at = starts[size == s][:, None] + np.arange(s)
        near = np.einsum("gid,gjd->gij", x[at], x[at]) >= THRESHOLD
        near &= np.where(both[size == s][:, None, None],
                         side[at][:, :, None] < side[at][:, None, :], np.triu(np.ones((s, s), bool), 1))
        g, i, j = np.nonzero(near)
        yield at[g, i], at[g, j]
    for g in np.flatnonzero(size > SMALL):
        a, b = starts[g], ends[g]
        if both[g]:
            m = a + int(np.argmax(side[a:b]))
            i, j = np.nonzero(x[a:m] @ x[m:b].T >= THRESHOLD)
            yield a + i, m + j
        else:
            i, j = np.nonzero(np.triu(x[a:b] @ x[a:b].T >= THRESHOLD, 1))
            yield a + i, a + j


def compare(batch: pa.RecordBatch) -> Iterator[dict]:
    """Whole comparisons (runs of equal f, x, y) → ``node, n, label``."""
    f, copies = batch.column("f").to_numpy(), batch.column("copies").to_numpy()
    side = batch.column("side").to_numpy()
    run = batch.column("run").to_numpy()
    shared = batch.column("shared")
    for at, x in units(batch.column("v")):  # a filter has vectors of one length
        size = np.diff(np.concatenate([np.flatnonzero(np.diff(run[at], prepend=-1)), [len(at)]]))
        lists = shared.take(pa.array(at))
        lengths = lists.value_lengths().to_numpy()
        padded = np.full((len(at), int(lengths.max())), -1, np.int64)
        padded[np.arange(padded.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
        count, label = np.zeros(len(at), np.int64), np.arange(len(at))
        hit = np.zeros(len(at), bool)
        ends = []
        for i, j in links_of(x, side[at], size):
            hit[i] = hit[j] = True
            ends.append((i, j))
            for k in range(0, len(i), 1 << 14):
                u, v = i[k:k + (1 << 14)], j[k:k + (1 << 14)]
                mine = _first_common(padded[u], padded[v]) == f[at][u]
                np.add.at(count, u[mine], copies[at][v[mine]])
                np.add.at(count, v[mine], copies[at][u[mine]])
        while True:
            before = label.copy()
            for i, j in ends:
                least = np.minimum(label[i], label[j])
                np.minimum.at(label, i, least)
                np.minimum.at(label, j, least)
            label = label[label]
            if (label == before).all():
                break
        out = np.flatnonzero(hit)
        node = batch.column("node").take(pa.array(at))
        yield {"node": node.take(pa.array(out)), "n": count[out],
               "label": node.take(pa.array(label[out]))}


def found_links(members: DataFrame, found: DataFrame) -> DataFrame:
    """``node, n, label`` rows of all comparisons."""
    dealt, pairs = block_pairs(members)
    open_filters = pairs.select("f").distinct()
    dealt = written(dealt.join(open_filters, "f"), "caps-dealt")
    shared = dealt.groupBy("node").agg(F.array_sort(F.collect_list("f")).alias("shared"))
    held = written(found.select("node", "copies", "v").join(shared, "node"), "caps-held")
    left = dealt.withColumnRenamed("block", "x").join(pairs, ["f", "x"]).withColumn("side", F.lit(0))
    right = dealt.withColumnRenamed("block", "y").join(
        pairs.where(F.col("x") != F.col("y")), ["f", "y"]).withColumn("side", F.lit(1))
    rows = left.select("f", "x", "y", "side", "node").unionByName(
        right.select("f", "x", "y", "side", "node")).join(held, "node")
    order = ["f", "x", "y"]
    rows = rows.repartition(*order).sortWithinPartitions(*order, "side").select(
        "f", F.xxhash64("f", "x", "y").alias("key"), "side", "node", "copies", "v", "shared")
    out = f"node {_NODE}, n long, label {_NODE}"
    schema = schema_of(found.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                table = table.combine_chunks()
                key, f = table.column("key").to_numpy(), table.column("f").to_numpy()
                new = (np.diff(key, prepend=key[0]) != 0) | (np.diff(f, prepend=f[0]) != 0)
                table = table.append_column("run", pa.array(np.cumsum(new)))
                for columns in compare(table.to_batches()[0]):
                    yield pa.RecordBatch.from_pydict(columns, schema=schema)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= ROWS:
                table = pa.Table.from_batches(held)
                key, f = table.column("key").to_numpy(), table.column("f").to_numpy()
                # the last comparison may go on in the next batch
                other = np.flatnonzero((key != key[-1]) | (f != f[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                yield from done(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), size - cut
        if held:
            yield from done(pa.Table.from_batches(held))

    return written(rows.mapInArrow(run, out), "caps-links")


def dedup(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    return settled(vectors.sparkSession, "caps", lambda: _dedup(vectors))


def _id(c: str) -> Column:
    return F.when(F.col(c) != F.lit(NULL_ID).cast("long"), F.col(c))


def _dedup(vectors: DataFrame) -> DataFrame:
    rows = _rows(vectors)
    found = nodes(rows)
    deal = found.select("node", F.explode("filters").alias("f"))
    crowd = written(deal.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > 1), "caps-crowd")
    members = written(deal.join(crowd, "f"), "caps-members")
    clique = cliques(members, found)
    links = found_links(members.join(clique.select("node", "core"), "node", "left"), found)
    inside = written(clique.groupBy("core").agg(F.sum("copies").alias("all"), F.min("node").alias(
        "least")), "caps-inside")
    clique = clique.join(inside, "core")
    edges = links.where(F.col("node") != F.col("label")).select(
        F.col("node").alias("a"), F.col("label").alias("b")).unionByName(
        clique.where(F.col("node") != F.col("least")).select(
            F.col("node").alias("a"), F.col("least").alias("b")))
    per = links.select("node", "n").unionByName(
        clique.select("node", (F.col("all") - F.col("copies")).alias("n"))).groupBy("node").agg(
        F.sum("n").alias("n"))
    result = written(found.select("node", "copies").join(per, "node", "left").join(
        components(edges), "node", "left").select(
        "node.c1", "node.c2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("class.id", "node.id").alias("component")), "caps-result")
    linked = rows.where(F.col("v").isNotNull()).select("id", "c1", "c2").join(
        result, ["c1", "c2"]).select("id", "n_links", "component")
    alone = rows.where(F.col("v").isNull()).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        _id("id").alias("vec_id"), "n_links", _id("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"))


#: All pairs: for small tables.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
unit AS (SELECT i, vec_id, len(e) AS d, list_transform(e, lambda x:
           x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM good),
link AS (
  SELECT a.i AS i, b.i AS j FROM unit a JOIN unit b ON a.d = b.d AND a.i <> b.i
  WHERE list_inner_product(a.u, b.u) >= 0.9),
walk AS (
  SELECT i, i AS j FROM v
  UNION
  SELECT walk.i, link.j FROM walk JOIN link ON link.i = walk.j),
part AS (SELECT walk.i, min(v.vec_id) AS component_id FROM walk JOIN v ON v.i = walk.j GROUP BY walk.i),
n AS (SELECT i, count(*) AS n FROM link GROUP BY i)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, part.component_id,
       v.vec_id = part.component_id AS kept
FROM v JOIN part USING (i) LEFT JOIN n USING (i)"""
