"""Near duplicates by improved consistent weighted sampling (ICWS).

A document is a weighted set: its shingles of five words, weighted by how
often they occur in it times the mean inverse document frequency of their
words.  Word frequencies are counted over all documents in a table of fixed
size (words that share a slot add up), which every task can hold.  ICWS draws
64 samples such that two documents agree in one with the probability of their
weighted Jaccard similarity; 16 bands of four samples bring candidates
together, and every candidate pair is verified on the whole texts.  A pair is
linked if its weighted Jaccard similarity, or the plain one of its shingle
sets, is 0.8 or more.

Copies of one text are one node.  Candidates inside a bucket are verified
without forming all its pairs: first each member with the bucket's earliest
one and with its neighbour in a random order; then, for members that are still
in another class than some others of their bucket, the remaining pairs, except
those that two exact bounds rule out: the triangle inequality of the Jaccard
distance through the bucket's earliest member, and per group of shingles the
smaller number of those that a text shares with any other.  So no candidate link between two classes is lost, however
large a bucket is.

Words are cut at white space, lower case; a text of one to four words is one
shingle; a text without a word (null, empty) is in a class of its own.  Rows
equal in doc_id and text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.bpe import Remembered
from vigil.llm.common import (ID, UID, arrow_map, claim, id_col, keyed, mix64, parts_by_bytes,
                              public_id, remembers, schema_of, settled, uid_col, written)

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
#: Slots of the word frequency table (fixed, whatever the corpus).
SLOTS = 1 << 18
#: Groups of shingles (by hash) in which common parts are bounded.
GROUPS = 64
#: Members of a bucket's largest class that all others are compared with.
HUBS = 3
#: Shingles of parsed texts that a verifying task remembers.
HELD = 1_000_000
#: Text characters handled at once inside a task.
CHUNK = 1 << 20

_TABLE = 4096


def _gamma2() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) law at the middles of _TABLE equal parts."""
    x = np.concatenate([[0], np.geomspace(1e-5, 40, 200_000)])
    return np.interp((np.arange(_TABLE) + 0.5) / _TABLE, 1 - (1 + x) * np.exp(-x), x)


_R = _gamma2().astype(np.float32)
_LOG_C = np.log(_gamma2()).astype(np.float32)
_rng = np.random.default_rng(981)
_DRAW = [np.uint64(int(v) | 1) for v in _rng.integers(1 << 60, 1 << 62, BANDS * ROWS)]


# --- weighted sets ------------------------------------------------------------

_hashes: Remembered | None = None


def _forget() -> None:
    global _hashes
    _hashes = None


remembers("near_dup", _forget)


def word_hashes(text: str) -> np.ndarray:
    global _hashes
    if _hashes is None:
        import xxhash

        _hashes = Remembered(lambda w: xxhash.xxh3_64_intdigest(
            w.encode("utf-8", "surrogatepass")))
    words = text.lower().split()
    out = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    _hashes.trim()
    return out


def shingles(words: list[np.ndarray], idf: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The weighted sets of several texts, one after the other: (shingle hash,
    weight, count, offsets); inside a text the hashes are sorted and distinct."""
    padded = [w if len(w) >= SHINGLE or not len(w) else
              np.concatenate([w, np.zeros(SHINGLE - len(w), np.uint64)]) for w in words]
    flat = np.concatenate(padded) if padded else np.zeros(0, np.uint64)
    if not len(flat):
        z = np.zeros(0)
        return flat, z.astype(np.float32), z, np.zeros(len(words) + 1, np.int64)
    slot = idf[(flat & np.uint64(SLOTS - 1)).astype(np.int64)]
    h = np.zeros(len(flat) - SHINGLE + 1, np.uint64)
    w = np.zeros(len(h), np.float64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix64(flat[k:k + len(h)])
        w += slot[k:k + len(h)]
    h = mix64(h)
    owner = np.repeat(np.arange(len(words)), np.array([len(p) for p in padded]))
    whole = owner[:len(h)] == owner[SHINGLE - 1:]
    h, w, owner = h[whole], w[whole] / SHINGLE, owner[:len(whole)][whole]
    order = np.lexsort((h, owner))
    h, w, owner = h[order], w[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.concatenate([first, [len(h)]]))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(words)))])
    return h[first], (w[first] * tf).astype(np.float32), tf, offsets


def bands(h: np.ndarray, weight: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Band keys (texts x BANDS) of non-empty weighted sets."""
    starts = offsets[:-1]
    size = np.diff(offsets)
    log_w = np.log(weight)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for k, draw in enumerate(_DRAW):
        u = h * draw
        u ^= u >> np.uint64(29)
        u *= np.uint64(0xBF58476D1CE4E5B9)
        r = _R[(u >> np.uint64(52)).astype(np.int64)]
        beta = ((u >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(log_w / r + beta)
        score = _LOG_C[((u >> np.uint64(40)) & np.uint64(4095)).astype(np.int64)] \
            - r * (t - beta) - r
        least = np.repeat(np.minimum.reduceat(score, starts), size)
        hit = np.flatnonzero(score == least)
        # the first of equal scores, in the order of the sorted hashes
        at = hit[np.searchsorted(hit, starts)]
        sample = mix64(h[at] ^ mix64(t[at].astype(np.int64).view(np.uint64) + np.uint64(k)))
        b = k // ROWS
        keys[:, b] = mix64(keys[:, b] * np.uint64(0x9E3779B97F4A7C15) + sample + np.uint64(b))
    return keys


def word_idf(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency per slot, from all documents."""
    schema = schema_of(texts.sparkSession, "slot int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dup")
        count, docs = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                w = np.unique(word_hashes(t or "") & np.uint64(SLOTS - 1)).astype(np.int64)
                count[w] += 1
                docs += len(w) > 0
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {"slot": np.concatenate([used, [-1]]).astype(np.int32),
             "n": np.concatenate([count[used], [docs]])}, schema=schema)

    total = texts.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).toPandas()  # at most SLOTS + 1 rows
    df = np.zeros(SLOTS)
    at = total["slot"].to_numpy()
    df[at[at >= 0]] = total["n"].to_numpy()[at >= 0]
    docs = int(total["n"].to_numpy()[at < 0].sum())
    return np.log((1 + docs) / (1 + df)) + 1


_SKETCH = f"{ID} long, {UID} long, c1 long, c2 long, bands array<long>"


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Content hashes and band keys per document (no bands without words)."""
    held = docs.sparkSession.sparkContext.broadcast(idf)  # SLOTS floats
    texts = keyed(docs, F.col("text"), F.xxhash64("text").alias("c1"),
                  F.xxhash64(F.lit(5), "text").alias("c2"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        claim("near_dup")
        texts = [t or "" for t in batch.column("text").to_pylist()]
        out: list = [None] * len(texts)
        seen: dict[str, int] = {}
        work = [i for i, t in enumerate(texts) if seen.setdefault(t, i) == i]
        for a, b in parts_by_bytes([len(texts[i]) for i in work], CHUNK):
            words = [word_hashes(texts[i]) for i in work[a:b]]
            full = [k for k, w in enumerate(words) if len(w)]
            if full:
                h, weight, _, offsets = shingles([words[k] for k in full], held.value)
                for k, row in zip(full, bands(h, weight, offsets).view(np.int64)):
                    out[work[a + k]] = row
        yield {**{c: batch.column(c) for c in (ID, UID, "c1", "c2")},
               "bands": [out[seen[t]] for t in texts]}

    return written(arrow_map(texts, run, _SKETCH), "near-sketches")


# --- verification -------------------------------------------------------------

def similarities(pairs: list[tuple[str, str]], idf: np.ndarray) -> list[tuple[float, float]]:
    """(weighted, plain) Jaccard similarity of each pair of texts."""
    sets: dict[str, tuple] = {}
    held = 0

    def of(t: str):
        nonlocal held
        if t not in sets:
            if held > HELD:
                sets.clear()
                held = 0
            h, w, _, _ = shingles([word_hashes(t)], idf)
            sets[t] = (h, w.astype(np.float64), float(w.sum(dtype=np.float64)))
            held += len(h)
        return sets[t]

    out = []
    for a, b in pairs:
        (ha, wa, sa), (hb, wb, sb) = of(a), of(b)
        at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
        both = hb[at] == ha
        low = float(np.minimum(wa[both], wb[at[both]]).sum())
        n = int(both.sum())
        out.append((low / (sa + sb - low), n / (len(ha) + len(hb) - n)))
    return out


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """``a, b, sim_w, sim_p`` for pairs of nodes; texts are (node, text)."""
    held = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        claim("near_dup")
        got = similarities(list(zip(batch.column("text_b").to_pylist(),
                                    batch.column("text_a").to_pylist())), held.value)
        yield {"a": batch.column("a"), "b": batch.column("b"),
               "sim_w": [g[0] for g in got], "sim_p": [g[1] for g in got]}

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return written(arrow_map(both, run, f"a {_NODE}, b {_NODE}, sim_w double, sim_p double"),
                   "near-verified")


_NODE = f"struct<{ID}:long,{UID}:long>"


def linked() -> Column:
    return F.greatest("sim_w", "sim_p") >= THRESHOLD


# --- classes ------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """``node, class`` (the smallest node it is connected to) for all nodes of
    ``a, b`` links, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"),
                                 F.least("a", "b").alias("v")).distinct(), "near-stars")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")), "near-least")  # joined below, a node may be hot
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "near-stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    return member.unionByName(member.select(F.col("class").alias("node"), "class").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """``__doc, __uid, c_doc, c_uid``: each document and its class's first."""
    return settled(docs.sparkSession, "near-classes", lambda: _classes(docs))


def _classes(docs: DataFrame) -> DataFrame:
    idf = word_idf(docs)
    rows = sketches(docs, idf)
    node = F.struct(ID, UID)
    # one node per text: its first document
    nodes = written(rows.groupBy("c1", "c2").agg(
        F.min(node).alias("node"), F.min_by("bands", node).alias("bands")), "near-nodes")
    keys = nodes.where(F.col("bands").isNotNull()).select(
        "node", F.posexplode("bands").alias("band", "key"))
    # written first: a join of two tables can be split where a key is hot, one
    # of a table with its own aggregate cannot
    buckets = written(keys.groupBy("key").agg(F.min("node").alias("first"), F.count(
        "*").alias("n")).where(F.col("n") > 1).select("key", "first"), "near-buckets")
    members = written(keys.join(buckets, "key"), "near-members")
    needed = members.select("node").distinct()
    texts = written(keyed(docs, "text").select(node.alias("node"), "text").join(
        needed.hint("shuffle_hash"), "node").dropDuplicates(["node"]), "near-texts")
    # every member with its bucket's first and with a neighbour
    star = members.where(F.col("node") != F.col("first")).select(
        F.col("node").alias("a"), F.col("first").alias("b"))
    links = verified(star.unionByName(neighbours(members)).distinct(), texts, idf)
    found = components(links.where(linked()))
    # then what is still outside its bucket's largest class: with the members
    # of that class that have most links, and with all that this leaves open
    for pairs in (hub_pairs, lambda m, n, f: remaining(m, nodes, texts, n, f, idf)):
        more = verified(pairs(members, links, found), texts, idf)
        links = links.unionByName(more)
        more = more.where(linked()).select("a", "b")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("class").alias("b"))
                               .where(F.col("a") != F.col("b")).unionByName(more))
    per_text = nodes.join(found, "node", "left").select(
        "c1", "c2", "node", "bands", F.coalesce("class", "node").alias("class"))
    return rows.select(ID, UID, "c1", "c2", F.col("bands").isNull().alias("alone")).join(
        per_text.select("c1", "c2", "class"), ["c1", "c2"]).select(
        ID, UID, F.when(F.col("alone"), F.col(ID)).otherwise(F.col(f"class.{ID}")).alias("c_doc"),
        F.when(F.col("alone"), F.col(UID)).otherwise(F.col(f"class.{UID}")).alias("c_uid"))


def neighbours(members: DataFrame) -> DataFrame:
    """Each member with the next one of its bucket in a random order.

    The order is global (range partitions of (key, hash)), so a large bucket
    spans partitions; the pair across a partition border is left to the later
    step.
    """
    schema = schema_of(members.sparkSession, "a1 long, a2 long, b1 long, b2 long")
    rows = members.select("key", F.xxhash64("key", "node").alias("r"),
                          F.col(f"node.{ID}").alias("d"), F.col(f"node.{UID}").alias("u"))
    rows = rows.repartitionByRange("key", "r", "d", "u").sortWithinPartitions("key", "r", "d", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            x = np.stack([np.array(batch.column(c).to_pylist(), np.int64)
                          for c in ("key", "d", "u")], axis=1)
            if last is not None:
                x = np.concatenate([last, x])
            last = x[-1:]
            same = np.flatnonzero(x[1:, 0] == x[:-1, 0])
            yield pa.RecordBatch.from_pydict(
                {"a1": x[same, 1], "a2": x[same, 2], "b1": x[same + 1, 1], "b2": x[same + 1, 2]},
                schema=schema)

    got = rows.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")

    def as_node(c: str) -> Column:
        return F.struct(F.col(f"{c}1").alias(ID), F.col(f"{c}2").alias(UID))

    return got.select(F.greatest(as_node("a"), as_node("b")).alias("a"),
                      F.least(as_node("a"), as_node("b")).alias("b")).where("a != b")


def open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with several classes: ``class`` and ``largest``."""
    rows = members.join(found, "node", "left").withColumn(
        "class", F.coalesce("class", "node"))
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
    per = sizes.groupBy("key").agg(F.count("*").alias("classes"),
                                   F.max_by("class", F.struct("n", "class")).alias("largest"))
    per = written(per.where(F.col("classes") > 1).select("key", "largest"), "near-per")
    return rows.join(per, "key")


def hub_pairs(members: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """Members outside the largest class of their bucket with its ``HUBS``
    members that have most links (the middle of a cloud of near copies)."""
    rows = written(open_buckets(members, found), "near-open")
    ends = links.where(linked())
    degree = ends.select(F.col("a").alias("node")).unionByName(
        ends.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    order = Window.partitionBy("key").orderBy(F.desc("degree"), "hub")
    core = rows.where(F.col("class") == F.col("largest")).join(degree, "node", "left").select(
        "key", F.col("node").alias("hub"), F.coalesce("degree", F.lit(0)).alias("degree"))
    # the limit is applied before the shuffle, too
    core = written(core.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= HUBS).select("key", "hub"), "near-hubs")
    pairs = rows.where(F.col("class") != F.col("largest")).join(core, "key").select(
        "node", "hub")
    return pairs.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")
                        ).distinct().join(links.select("a", "b"), ["a", "b"], "left_anti")


def own_mass(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Per node the size of its shingle set, ``s_p`` counted and ``s_w`` by
    weight, and what of it some other of these texts has, too, by hash group:
    ``g_p, g_w``, arrays of ``GROUPS`` sums."""
    held = texts.sparkSession.sparkContext.broadcast(idf)
    schema = schema_of(texts.sparkSession, f"node {_NODE}, h long, w double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in parts_by_bytes([len(t) for t in texts], CHUNK):
                h, w, _, off = shingles([word_hashes(t) for t in texts[a:b]], held.value)
                owner = pa.array(np.repeat(np.arange(a, b), np.diff(off)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(owner), pa.array(h.view(np.int64)),
                     pa.array(w.astype(np.float64))], schema=schema)

    rows = texts.mapInArrow(run, f"node {_NODE}, h long, w double")
    group = F.pmod("h", F.lit(GROUPS)).cast("int").alias("g")
    own = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node"),
                                F.max("w").alias("w")).where(F.col("n") == 1)
    own = own.groupBy("node", group).agg(F.count("*").alias("own_p"), F.sum("w").alias("own_w"))
    sums = rows.groupBy("node", group).agg(F.count("*").alias("p"), F.sum("w").alias("w"))
    none = F.lit(0.0)
    sums = sums.join(own, ["node", "g"], "left").select(
        "node", "g", "p", "w", (F.col("p") - F.coalesce("own_p", none)).alias("shared_p"),
        (F.col("w") - F.coalesce("own_w", none)).alias("shared_w"))
    per = sums.groupBy("node").agg(
        F.sum("p").alias("s_p"), F.sum("w").alias("s_w"),
        F.map_from_entries(F.collect_list(F.struct("g", F.struct("shared_p", "shared_w")))).alias("m"))

    def array(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.coalesce(
            F.try_element_at("m", g)[f"shared_{c}"], none))

    return per.select("node", "s_p", "s_w", array("p").alias("g_p"), array("w").alias("g_w"))


def remaining(members: DataFrame, nodes: DataFrame, texts: DataFrame, links: DataFrame,
              found: DataFrame, idf: np.ndarray) -> DataFrame:
    """Pairs of one bucket in different classes that are neither verified nor
    ruled out.  A pair that shares several buckets is formed in the first of
    them only.  Two exact bounds rule pairs out: with the bucket's first at
    distances x and y, two members are at least |x - y| apart; and in each
    group of shingles the common part is at most the smaller of what the two
    texts have there and share with any other."""
    to_first = links.select(F.col("a").alias("node"), F.col("b").alias("first"),
                            "sim_w", "sim_p")
    rows = open_buckets(members, found).where(F.col("node") != F.col("first")).join(
        to_first, ["node", "first"], "left").select(
        "key", "band", "node", "class", "largest", F.col("sim_w").alias("w"),
        F.col("sim_p").alias("p")).join(nodes.select("node", "bands"), "node")
    rows = written(rows, "near-open")
    # what is rare among all texts of open buckets is so for each of them
    open_texts = texts.join(rows.select("node").distinct(), "node")
    mass = written(own_mass(open_texts, idf), "near-own")
    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    least = THRESHOLD - 1e-6
    can = F.greatest(total(F.col("g_p")) / F.col("s_p"), total(F.col("g_w")) / F.col("s_w")) >= least
    rows = written(rows.join(mass.where(can), "node"), "near-open")
    near = 1 - THRESHOLD + 1e-6
    x, y = rows.alias("x"), rows.alias("y")

    def possible(s: str, g: str) -> Column:
        most = total(F.zip_with(f"x.{g}", f"y.{g}", lambda a, b: F.least(a, b)))
        return most >= least * (F.col(f"x.{s}") + F.col(f"y.{s}") - most)

    # left: members outside the bucket's largest class; right: all of it
    pairs = x.where(F.col("class") != F.col("largest")).join(
        y, (F.col("x.key") == F.col("y.key")) & (F.col("x.class") != F.col("y.class"))
        & ((F.col("y.class") == F.col("y.largest")) | (F.col("x.node") > F.col("y.node")))
        & (((F.abs(F.col("x.w") - F.col("y.w")) <= near) & possible("s_w", "g_w"))
           | ((F.abs(F.col("x.p") - F.col("y.p")) <= near) & possible("s_p", "g_p")))
        & (F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True)
           == F.col("x.band") + 1))
    pairs = pairs.select(
        F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
    return pairs.distinct().join(links.select("a", "b"), ["a", "b"], "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id, kept`` (the class's first)."""
    return classes(docs).select(
        public_id(), public_id("c_doc").alias("class_id"),
        ((F.col(ID) == F.col("c_doc")) & (F.col(UID) == F.col("c_uid"))).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """The first document of each class, all columns kept; of rows equal in
    doc_id and text one stays."""
    keep = classes(docs).where((F.col(ID) == F.col("c_doc")) & (F.col(UID) == F.col("c_uid")))
    repeated = not keep.groupBy(ID, UID).count().where("count > 1").isEmpty()
    keep = keep.select(F.col(ID).alias("__k_doc"), F.col(UID).alias("__k_uid")).distinct()
    out = docs.join(keep.hint("shuffle_hash"), (id_col() == F.col("__k_doc"))
                    & (uid_col() == F.col("__k_uid")))
    if repeated:
        out = out.dropDuplicates(["__k_doc", "__k_uid"])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
