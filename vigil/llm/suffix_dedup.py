"""Suffix-array dedup of byte strings of a fixed length (100).

A suffix of a document, cut to 100 bytes, goes if the same 100 bytes start
earlier (a smaller document, or the same one before).  All suffixes at 100
bytes each would be a hundred times the corpus, so they travel in groups:

1. Every suffix is led by one token, the 32-byte string inside it that a hash
   orders first (leftmost on ties).  Equal suffixes have equal leading tokens
   at equal places, and neighbouring suffixes mostly share theirs, so a
   stretch of suffixes is one string of up to 168 bytes.
2. Tokens that occur once in the corpus cannot lead a repeated suffix.  Their
   hashes are counted in hash buckets, each task sending a hash once; the
   documents learn which of their tokens repeat.
3. The remaining stretches are range-partitioned by splitters that Spark
   samples from their keys: the token's first bytes, its hash, and the place,
   so that one token with any number of copies spreads over partitions.
4. Each partition is read in blocks of bounded size, which end between two
   tokens unless one token alone passes the bound.  A block sorts its
   suffixes by multikey quicksort, eight bytes per step and only among those
   still equal, and marks all but the earliest of equal ones.
5. A token whose stretches may go on elsewhere (the first and the last of a
   partition, and one that a block's end cuts) sends its distinct suffixes'
   128-bit hashes to a comparison across the boundaries, a grouped minimum.

Documents are ordered by (doc_id, hash of the text); null and empty texts have
no bytes; rows equal in doc_id and text are one document and get equal rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import (ID, UID, arrow_map, keyed, mix64, parts_by_bytes, public_id,
                              schema_of, settled, written)

LENGTH = 100
TOKEN = 32
#: Text bytes per block of the numpy passes, and stretch bytes per sorted block.
BLOCK, SORT_BLOCK = 1 << 20, 2 << 20
#: Text bytes per hash bucket of the token count.
BUCKET_BYTES = 16 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_STEP = [np.uint64(int(v) | 1) for v in _rng.integers(0, 1 << 62, 8)]
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def token_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes (a power of two) at every place."""
    h, k, i = _BYTE[data], 1, 0
    while k < length:
        h = h[:-k] * _STEP[i] + h[k:]
        k, i = 2 * k, i + 1
    return mix64(h)


def leading_tokens(data: np.ndarray, starts: np.ndarray, length: int = LENGTH,
                   token: int = TOKEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix places, place of each one's leading token, hash per place).

    ``data`` holds documents one after the other, ``starts`` their first
    places and the end; only suffixes inside one document are returned.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = token_hashes(data, token)
    value, place = h.copy(), np.arange(len(h), dtype=np.int32)
    span, width = 1, length - token + 1
    while span < width:  # leftmost minimum over ``span`` places, doubled
        step = min(span, width - span)
        less = value[step:] < value[:-step]
        value = np.where(less, value[step:], value[:-step])
        place = np.where(less, place[step:], place[:-step])
        span += step
    whole = np.zeros(len(data) + 1, bool)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= length:
            whole[a:b - length + 1] = True
    at = np.flatnonzero(whole[:len(place)])
    return at, place[at].astype(np.int64), h


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(row numbers, bytes, starts) for runs of rows of a bounded size."""
    texts = [(t or "").encode("utf-8", "surrogatepass")
             for t in batch.column("text").to_pylist()]
    for a, b in parts_by_bytes([len(t) for t in texts], BLOCK):
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])]).astype(np.int64)
        yield list(range(a, b)), np.frombuffer(b"".join(texts[a:b]), np.uint8), starts


# --- which tokens repeat ------------------------------------------------------

def repeated_tokens(texts: DataFrame, buckets: int) -> DataFrame:
    """``__doc, repeats``: hashes of each document's leading tokens that occur
    again somewhere (in any document of the same doc_id)."""
    def send(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = np.array(batch.column(ID).to_pylist(), np.int64)
        for rows, data, starts in _blocks(batch):
            _, lead, h = leading_tokens(data, starts)
            lead = np.unique(lead)
            if not len(lead):
                continue
            doc = ids[rows][np.searchsorted(starts, lead, "right") - 1]
            hashes = h[lead]
            order = np.lexsort((doc, hashes))
            hashes, doc = hashes[order], doc[order]
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            once = new.copy()
            once[:-1] &= new[1:]
            # repeated in this block: known without asking, and sent once
            again = np.flatnonzero(~once)
            keep = np.ones(len(again), bool)
            keep[1:] = (hashes[again][1:] != hashes[again][:-1]) | (
                doc[again][1:] != doc[again][:-1])
            again = again[keep]
            yield {"bucket": [-1], "hashes": [hashes[again].tobytes()],
                   "docs": [doc[again].tobytes()]}
            first = np.flatnonzero(new)
            bucket = (hashes[first] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = np.split(first[order], cut)
            yield {"bucket": bucket[order][np.concatenate([[0], cut])],
                   "hashes": [hashes[g].tobytes() for g in groups],
                   "docs": [doc[g].tobytes() for g in groups]}

    sent = written(arrow_map(texts, send, "bucket long, hashes binary, docs binary"),
                   "suffix-tokens")
    schema = schema_of(texts.sparkSession, f"{ID} long, h long")

    def answer(hashes: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(docs), 1 << 16):
            yield pa.RecordBatch.from_pydict(
                {ID: docs[a:a + (1 << 16)], "h": hashes[a:a + (1 << 16)].view(np.int64)},
                schema=schema)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, d in zip(batch.column("hashes").to_pylist(), batch.column("docs").to_pylist()):
                yield from answer(np.frombuffer(h, np.uint64), np.frombuffer(d, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> Iterator[pa.RecordBatch]:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[:-1] |= same[1:].copy()
            yield from answer(h[same], d[same])

        now, hashes, docs = None, [], []
        for batch in batches:  # sorted by bucket
            for b, h, d in zip(*(batch.column(c).to_pylist()
                                 for c in ("bucket", "hashes", "docs"))):
                if b != now and hashes:
                    yield from settle()
                    hashes, docs = [], []
                now = b
                hashes.append(np.frombuffer(h, np.uint64))
                docs.append(np.frombuffer(d, np.int64))
        if hashes:
            yield from settle()

    asked = sent.where(F.col("bucket") >= 0).repartition("bucket").sortWithinPartitions("bucket")
    rows = asked.mapInArrow(count, f"{ID} long, h long").unionByName(
        sent.where(F.col("bucket") < 0).mapInArrow(known, f"{ID} long, h long"))
    return rows.groupBy(ID).agg(F.collect_set("h").alias("repeats"))


# --- stretches ---------------------------------------------------------------

_STRETCH = f"lead long, h long, {ID} long, {UID} long, start int, token int, data binary"


def stretches(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """Runs of suffixes that share a repeated leading token, as one string
    each: ``start`` its place in the document, ``token`` the token's place in
    the string, ``lead`` the token's first eight bytes."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, uids = (np.array(batch.column(c).to_pylist(), np.int64) for c in (ID, UID))
        wanted = batch.column("repeats")
        for rows, data, starts in _blocks(batch):
            at, lead, h = leading_tokens(data, starts)
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (lead[1:] != lead[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(at)]]) - 1
            row = np.searchsorted(starts, at[first], "right") - 1
            use = np.zeros(len(first), bool)
            cut = np.searchsorted(row, np.arange(len(rows) + 1))
            for k, r in enumerate(rows):
                a, b = cut[k], cut[k + 1]
                if b > a:
                    mine = np.sort(wanted[r].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                    use[a:b] = np.isin(h[lead[first[a:b]]], mine)
            first, last, row = first[use], last[use], row[use]
            if not len(first):
                continue
            raw = data.tobytes()
            begin, end = at[first], at[last] + LENGTH
            where = lead[first]
            words = _big_endian(data)
            owner = np.array(rows)[row]
            yield {"lead": words[where].view(np.int64) ^ np.int64(-2 ** 63),
                   "h": h[where].view(np.int64), ID: ids[owner], UID: uids[owner],
                   "start": (begin - starts[row]).astype(np.int32),
                   "token": (where - begin).astype(np.int32),
                   "data": [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]}

    return arrow_map(texts.join(repeats.hint("shuffle_hash"), ID), run, _STRETCH)


def _big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number (zeros past the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + len(data)]
    return out


# --- sorting -----------------------------------------------------------------

def equal_suffixes(data: np.ndarray, at: np.ndarray, kind: np.ndarray,
                   length: int = LENGTH) -> np.ndarray:
    """Class numbers of the ``length``-byte strings at ``at``: two get the same
    number exactly if their ``kind`` and their bytes agree.

    Multikey quicksort over eight-byte characters: each step sorts by one
    character inside the classes that still have several members.
    """
    words = _big_endian(data)
    out = np.arange(len(at))
    order = np.argsort(kind, kind="stable")
    cls = np.cumsum(np.concatenate([[0], np.diff(kind[order]) != 0])) if len(at) else order
    depth = 0
    while len(order):
        size = np.bincount(cls)
        order, cls = order[size[cls] > 1], cls[size[cls] > 1]
        if depth >= length or not len(order):
            break
        w = words[at[order] + min(depth, length - 8)]
        inner = np.lexsort((order, w, cls))
        order, cls, w = order[inner], cls[inner], w[inner]
        cls = np.cumsum(np.concatenate([[0], (np.diff(cls) != 0) | (w[1:] != w[:-1])]))
        depth += 8
    if len(order):
        new = np.concatenate([[True], np.diff(cls) != 0])
        out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


_MARKS = f"kind int, {ID} long, {UID} long, s int, e int, w1 long, w2 long"


def sort_block(rows: list[tuple], edges: set[tuple[int, int]]) -> dict:
    """Marks of one block of stretches in key order: kind 0, a byte range to
    remove; kind 1, a suffix that must be compared with other blocks."""
    docs = np.array([(r[2], r[3], r[4]) for r in rows], np.int64).reshape(-1, 3)
    first: dict[tuple[int, bytes], int] = {}
    work: list[int] = []
    out: dict[str, list] = {c.split()[0]: [] for c in _MARKS.split(", ")}

    def mark(kind: int, r: int, s: int, e: int, w1: int = 0, w2: int = 0) -> None:
        for c, v in zip(out, (kind, docs[r, 0], docs[r, 1], s, e, w1, w2)):
            out[c].append(int(v))

    for i, r in enumerate(rows):  # equal strings: the first stands for all
        j = first.setdefault((r[1], r[6]), i)
        if j == i:
            work.append(i)
        elif tuple(docs[j]) != tuple(docs[i]):
            mark(0, i, r[4], r[4] + len(r[6]))
    sizes = np.array([len(rows[i][6]) for i in work])
    data = np.frombuffer(b"".join(rows[i][6] for i in work), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(work)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[row] + within
    group = np.cumsum([0] + [rows[a][1] != rows[b][1] or rows[a][0] != rows[b][0]
                             for a, b in zip(work, work[1:])])
    token = np.array([rows[i][5] for i in work])
    cls = equal_suffixes(data, at, group[row] * (2 * LENGTH) + token[row] - within + LENGTH)
    # the earliest place of a class: rows come in order of place
    place = docs[np.array(work)][row]
    later = cls != np.arange(len(row))
    same = (place == place[cls]).all(axis=1) & (within == within[cls])
    later &= ~same
    hit = np.flatnonzero(later)
    if len(hit):
        new = np.ones(len(hit), bool)
        new[1:] = (row[hit][1:] != row[hit][:-1]) | (hit[1:] != hit[:-1] + 1)
        a = hit[new]
        b = hit[np.concatenate([np.flatnonzero(new)[1:], [len(hit)]]) - 1]
        for x, y in zip(a.tolist(), b.tolist()):
            r = work[row[x]]
            mark(0, r, rows[r][4] + within[x], rows[r][4] + within[y] + LENGTH)
    raw = data.tobytes()
    for k, i in enumerate(work):
        if (rows[i][0], rows[i][1]) in edges:
            lo = int(np.searchsorted(row, k))
            for x in range(lo, lo + int(counts[k])):
                if cls[x] == x:
                    d = hashlib.blake2b(raw[at[x]:at[x] + LENGTH], digest_size=16).digest()
                    s = rows[i][4] + int(within[x])
                    mark(1, i, s, s + LENGTH, int.from_bytes(d[:8], "little", signed=True),
                         int.from_bytes(d[8:], "little", signed=True))
    return out


def token_blocks(stretches: Iterator[tuple], bound: int
                 ) -> Iterator[tuple[list[tuple], set[tuple[int, int]]]]:
    """Blocks of a partition's sorted stretches (under twice ``bound`` bytes and
    one stretch), each with its edges: the tokens that may go on in another block
    or partition.  A block ends between two tokens; a token alone is cut only
    where it passes the bound by itself."""
    rows, size, since = [], 0, 0  # ``since``: where the last token begins in ``rows``
    first: tuple[int, int] | None = None
    cut: set[tuple[int, int]] = set()
    for r in stretches:
        token = r[:2]
        first = first or token
        if rows and rows[-1][:2] != token:
            if size >= bound:
                yield rows, {first} | cut
                rows, size, cut = [], 0, set()
            since = len(rows)
        elif size >= 2 * bound:
            if since:  # the tokens before this one are whole
                yield rows[:since], {first} | cut
                rows, cut, since = rows[since:], set(), 0
                size = sum(len(a[6]) for a in rows)
            if size >= bound:
                cut.add(token)
                yield rows, {first} | cut
                rows, size = [], 0
        rows.append(r)
        size += len(r[6])
    if rows:
        yield rows, {first, rows[-1][:2]} | cut


def marks(runs: DataFrame) -> DataFrame:
    """Byte ranges to remove and suffixes to compare across blocks."""
    names = [c.split()[0] for c in _STRETCH.split(", ")]
    schema = schema_of(runs.sparkSession, _MARKS)
    key = ["lead", "h", ID, UID, "start"]
    parts = runs.repartitionByRange(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches
                for r in zip(*(batch.column(c).to_pylist() for c in names)))
        for block, edges in token_blocks(rows, SORT_BLOCK):
            yield pa.RecordBatch.from_pydict(sort_block(block, edges), schema=schema)

    return parts.mapInArrow(run, _MARKS)


def across_boundaries(found: DataFrame) -> DataFrame:
    """Ranges of the suffixes of kind 1 that start earlier in another block."""
    rows = found.where(F.col("kind") == 1)
    here = F.struct(ID, UID, "s")
    first = rows.groupBy("w1", "w2").agg(F.min(here).alias("first"), F.count("*").alias("n"))
    shared = written(first.where(F.col("n") > 1), "suffix-firsts")  # Spark then knows its size
    return rows.join(shared, ["w1", "w2"]).where(
        here > F.col("first")).select(ID, UID, "s", "e")


# --- the operator --------------------------------------------------------------

def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``__doc, __uid, ranges``: byte ranges to remove (they may overlap)."""
    return settled(docs.sparkSession, "suffix-ranges", lambda: _repeated_ranges(docs))


def _repeated_ranges(docs: DataFrame) -> DataFrame:
    texts = keyed(docs, "text").where(F.octet_length("text") >= LENGTH)
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    spark = docs.sparkSession

    def runs() -> DataFrame:
        return stretches(texts, repeated_tokens(texts, max(1, total // BUCKET_BYTES)))

    # each table goes as soon as the next one is written
    found = settled(spark, "suffix-marks", lambda: marks(settled(spark, "suffix-runs", runs)))
    ranges = found.where(F.col("kind") == 0).select(ID, UID, "s", "e").unionByName(
        across_boundaries(found))
    return ranges.groupBy(ID, UID).agg(F.collect_set(F.struct("s", "e")).alias("ranges"))


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def removed(docs: DataFrame) -> DataFrame:
    """Documents with repeated bytes: ``__doc, __uid, n_removed, n_spans, kept``
    (the remaining bytes)."""
    texts = keyed(docs, "text")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        spans, kept = [], []
        for t, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            data, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
            spans.append(_merged(r))
            for s, e in spans[-1]:
                parts.append(data[at:s])
                at = e
            kept.append(b"".join([*parts, data[at:]]))
        yield {ID: batch.column(ID), UID: batch.column(UID),
               "n_removed": [sum(e - s for s, e in x) for x in spans],
               "n_spans": [len(x) for x in spans], "kept": kept}

    joined = texts.join(repeated_ranges(docs).hint("shuffle_hash"), [ID, UID])
    return arrow_map(joined, run,
                     f"{ID} long, {UID} long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    touched = removed(docs).select(ID, UID, "n_removed", "n_spans", F.sha2("kept", 256).alias(
        "kept_sha256")).dropDuplicates([ID, UID])
    text = F.coalesce(F.col("text"), F.lit(""))
    every = keyed(docs, F.octet_length(text).cast("long").alias("n_bytes"),
                  F.sha2(text.cast("binary"), 256).alias("whole"))
    none = F.lit(0).cast("long")
    return every.join(touched, [ID, UID], "left").select(
        public_id(), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
