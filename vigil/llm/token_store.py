"""Token ids in binary shards with a minimal perfect hash index.

A shard is one byte string::

    magic 8 bytes | number of documents n, buckets m, ids, bytes per id (4 x uint64)
    seeds     m x uint32   second-level seed per bucket of the hash
    prints    n x uint32   fingerprint of the key in each slot
    entries   n x uint64   document number of the key in each slot
    offsets   (n + 1) x uint64   first id of each document, in document order
    ids       little-endian unsigned, 2 bytes if the vocabulary allows, else 4

The index is hash-and-displace: a key's first hash picks a bucket, the
bucket's seed sends its keys to free slots, and all n slots are used.  A
lookup is two hashes and one fingerprint comparison; a foreign key gets a
wrong answer only if its 32-bit fingerprint happens to agree.

Documents are range-partitioned by doc_id, encoded and cut into shards of a
bounded size.  The shard table is Parquet, so
shards live wherever Spark can write; each row is one shard and its place in
the global order.  A null ``doc_id`` sorts first.  A key is (doc_id, hash of
the text, copy number), so repeated rows are stored and found one by one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.bpe import REMEMBERED, regular
from vigil.llm.common import (ID, UID, arrow_map, claim, keyed, mix64, parts_by_bytes, public_id,
                              remembers, schema_of, written)

MAGIC = b"IDSHARD1"
#: Id appended to every document.
END_ID = 2
#: Ids per shard (a longer document has a shard of its own).
SHARD_IDS = 4 << 20
#: Characters of text that are encoded at once (a longer document is alone).
TEXT_BLOCK = 1 << 22
#: Ids of pieces remembered per worker, if the pieces are long (two generations).
REMEMBERED_IDS = 1 << 23
#: Keys per bucket of the hash, on average.
BUCKET = 4


# --- encoding ---------------------------------------------------------------

# Kinds of bytes.  Letters are those of ASCII and both bytes of U+00C0 to
# U+023F without the two signs among them; OTHER is not told apart.
BLANK, LINE, LETTER, DIGIT, SIGN, QUOTE, OTHER = range(7)


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[c for c in range(128) if not 9 <= c <= 13 and not 28 <= c <= 31]] = SIGN
    kinds[[c for c in range(128) if chr(c).isalpha()]] = LETTER
    kinds[48:58] = DIGIT
    kinds[[ord(c) for c in " \n'"]] = BLANK, LINE, QUOTE
    return kinds


def _cuts() -> np.ndarray:
    cuts = np.zeros((7, 7), bool)
    cuts[LETTER:, :LETTER] = True  # a blank or line feed after something else
    cuts[LINE, LETTER:] = True
    cuts[LETTER, [DIGIT, SIGN, QUOTE]] = True
    cuts[DIGIT, [LETTER, SIGN, QUOTE]] = True
    cuts[SIGN, [LETTER, DIGIT]] = True
    cuts[QUOTE, DIGIT] = True  # a letter may belong to the quote: 's
    return cuts.ravel()


KINDS, CUTS = _kinds(), _cuts()


def pieces_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(pieces of all texts, number of pieces before each text and the end).

    Cuts regular texts where the split pattern does for certain: it ends a
    run of letters, digits or signs at a known byte of another kind and before
    white space, and takes the last of several line feeds alone if a text goes
    on.  Places beside a byte of kind OTHER are left to the library.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    bounds = offsets - offsets[0]
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    kinds = KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] & 0xDF) != 0x97)]  # not \u00d7, \u00f7
    kinds[lead] = kinds[lead + 1] = LETTER
    cut = np.zeros(len(data), bool)
    cut[1:] = CUTS[kinds[:-1] * 7 + kinds[1:]]
    line = kinds == LINE
    goes_on = ~np.append(line[1:], True)
    goes_on[starts[1:] - 1] = False
    cut[1:] |= line[:-1] & line[1:] & goes_on[1:]
    cut[starts] = True
    at = np.flatnonzero(cut)
    return (pa.StringArray.from_buffers(
        len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)),
        np.searchsorted(at, bounds))


def gathered(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``first``, one after the other."""
    return ids[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class Numbered(dict):
    """Numbers pieces in order of first sight; ids of all pieces in one array."""

    def __init__(self, dtype: np.dtype) -> None:
        super().__init__()
        self.new: list[str] = []  # numbered, their ids still to be added
        self.ids, self.at = np.zeros(0, dtype), np.zeros(1, np.int64)
        self.old: Numbered | None = None  # the generation before, to learn from

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number

    def trim(self) -> None:
        """Call between blocks."""
        if len(self) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            old = Numbered(self.ids.dtype)
            old.update(self)
            old.ids, old.at = self.ids, self.at
            self.clear()
            self.ids, self.at, self.old = self.ids[:0].copy(), self.at[:1].copy(), old

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def runs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of pieces."""
        return self.at[numbers], self.at[numbers + 1] - self.at[numbers]

    def find(self, pieces: list[str], learn: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The runs of pieces; those that are new are learned."""
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        new, self.new = self.new, []
        if self.old is None:
            self.add(*learn(new))
            return self.runs(numbers)
        again = np.fromiter((self.old.get(p, -1) for p in new), np.int64, len(new))
        fresh = again < 0
        ids, more = learn([p for p, f in zip(new, fresh.tolist()) if f])
        first, sizes = self.old.runs(np.maximum(again, 0))
        first[fresh], sizes[fresh] = len(self.old.ids) + np.cumsum(more) - more, more
        self.add(gathered(np.concatenate([self.old.ids, ids]), first, sizes), sizes)
        return self.runs(numbers)


class PieceEncoder:
    """The library's ids of a text, remembered by piece."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # texts with the string of an added token go to the library whole
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        blank = [i for t, i in self.tok.get_vocab().items() if t.startswith("Ġ")]
        self.starts = np.zeros(size, bool)
        self.starts[blank] = True  # tokens that begin with a blank
        self.known = Numbered(self.dtype)  # pieces that begin with a blank
        self.loose = Numbered(self.dtype)  # other pieces

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype)
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, todo: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of pieces with a blank.  Many per call: they
        make a regular text, in which each starts at a token with a blank."""
        found, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(todo), 20000):
            ids = self.library(["".join(todo[at:at + 20000])])[0]
            found.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.starts[ids]), append=len(ids)))
        sizes = np.concatenate(sizes)
        if len(sizes) != len(todo):
            raise ValueError("pieces do not start at tokens with a blank")
        return np.concatenate(found), sizes

    def learn_loose(self, todo: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library(todo)
        return (np.concatenate([np.zeros(0, self.dtype), *found]),
                np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for a, b in parts_by_bytes([len(t) for t in texts], TEXT_BLOCK)
                for ids in self.encode_block(texts[a:b])]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        self.known.trim()
        self.loose.trim()
        plain = [regular(t) and not any(a in t for a in self.added) for t in texts]
        cut, bounds = pieces_of(pa.array([t for t, p in zip(texts, plain) if p], pa.string()))
        # pieces are told apart by Arrow; only different ones become strings
        cut = cut.dictionary_encode()
        different = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        blank = np.fromiter((p[0] == " " for p in different), bool, len(different))
        first, sizes = np.zeros((2, len(different)), np.int64)
        first[~blank], sizes[~blank] = self.loose.find(
            [p for p in different if p[0] != " "], self.learn_loose)
        first[blank], sizes[blank] = self.known.find(
            [p for p in different if p[0] == " "], self.learn)
        first[~blank] += len(self.known.ids)
        at = cut.indices.to_numpy()
        ids = gathered(np.concatenate([self.known.ids, self.loose.ids]), first[at], sizes[at])
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[bounds].tolist()
        ready = (ids[a:b].tobytes() for a, b in zip(ends, ends[1:]))
        whole = (i.tobytes() for i in self.library([t for t, p in zip(texts, plain) if not p]))
        return [next(ready if p else whole) for p in plain]


@lru_cache(maxsize=2)
def piece_encoder(path: str | None) -> PieceEncoder:
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path or public_tokenizers.path("byte_bpe_50k.json"))


remembers("pieces", piece_encoder.cache_clear)


# --- minimal perfect hash ---------------------------------------------------

def key_hash(ids: np.ndarray, uids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    x = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    x = mix64(x ^ uids.astype(np.int64).view(np.uint64))
    return mix64(x + copies.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return mix64(h + (seed.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                 ) % np.uint64(max(n, 1))


def build_index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds per bucket, slot of each key) for distinct 64-bit key hashes."""
    n = len(h)
    m = max(1, -(-n // BUCKET))
    bucket = h % np.uint64(m)
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=m))[:-1])
    seeds, place = np.zeros(m, np.uint32), np.zeros(n, np.int64)
    taken = np.zeros(n, bool)
    for b in sorted(range(m), key=lambda b: -len(groups[b])):
        keys = h[groups[b]]
        if not len(keys):
            continue
        first = 0
        while True:  # try a block of seeds at once
            tries = np.arange(first, first + 64, dtype=np.uint64)
            at = slots(keys[None, :], tries[:, None], n).astype(np.int64)
            ok = ~taken[at].any(axis=1)
            if len(keys) > 1:
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                k = int(np.argmax(ok))
                break
            first += 64
        seeds[b] = first + k
        place[groups[b]] = at[k]
        taken[at[k]] = True
    return seeds, place


def build_shard(ids: np.ndarray, uids: np.ndarray, copies: np.ndarray,
                payload: list[bytes], width: int) -> bytes:
    h = key_hash(ids, uids, copies)
    seeds, place = build_index(h)
    prints, entries = np.zeros(len(h), "<u4"), np.zeros(len(h), "<u8")
    prints[place] = fingerprint(h)
    entries[place] = np.arange(len(h))
    offsets = np.concatenate([[0], np.cumsum([len(p) // width for p in payload])]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<4Q", len(h), len(seeds), int(offsets[-1]), width),
                     seeds.astype("<u4").tobytes(), prints.tobytes(), entries.tobytes(),
                     offsets.tobytes(), *payload])


class Shard:
    """Reads one shard."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not an id shard")
        self.n, m, self.total, self.width = struct.unpack_from("<4Q", data, 8)
        at = 40
        self.seeds = np.frombuffer(data, "<u4", m, at)
        self.prints = np.frombuffer(data, "<u4", self.n, at := at + 4 * m)
        self.entries = np.frombuffer(data, "<u8", self.n, at := at + 4 * self.n)
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, at := at + 8 * self.n)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.total, at + 8 * (self.n + 1))

    def find(self, ids: np.ndarray, uids: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Document numbers of the keys, -1 where a key is not there."""
        if not self.n:
            return np.full(len(ids), -1)
        h = key_hash(ids, uids, copies)
        at = slots(h, self.seeds[(h % np.uint64(len(self.seeds))).astype(np.int64)], self.n)
        at = at.astype(np.int64)
        return np.where(self.prints[at] == fingerprint(h), self.entries[at].astype(np.int64), -1)

    def payload(self, number: int) -> np.ndarray:
        return self.ids[int(self.offsets[number]):int(self.offsets[number + 1])]


# --- tables -----------------------------------------------------------------

_SHARDS = ("part int, seq int, n_docs long, n_ids long, docs binary, uids binary, "
           "copies binary, shard binary")


def write_shards(docs: DataFrame, path: str | None = None,
                 shard_ids: int = SHARD_IDS) -> DataFrame:
    """Order, encode and write; returns the written shard table.

    The texts are ordered before they are encoded: sampling the splitters
    reads the input of the range partitioning a second time.  Copy numbers
    restart at a partition border.  That is safe: a key is looked up in the
    shard that holds it.
    """
    parts = keyed(docs, "text").repartitionByRange(ID, UID).sortWithinPartitions(ID, UID)
    schema = schema_of(docs.sparkSession, _SHARDS)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("pieces")
        enc = piece_encoder(path)
        width, end = enc.dtype.itemsize, np.array([END_ID], enc.dtype).tobytes()
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        keys: list[tuple[int, int, int]] = []
        payload: list[bytes] = []
        last, copy = None, 0

        def flush() -> pa.RecordBatch:
            k = np.array(keys, np.int64).reshape(-1, 3)
            shard = build_shard(k[:, 0], k[:, 1], k[:, 2], payload, width)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "n_docs": [len(keys)], "n_ids": [size],
                 "docs": [k[:, 0].tobytes()], "uids": [k[:, 1].tobytes()],
                 "copies": [k[:, 2].tobytes()], "shard": [shard]}, schema=schema)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            encoded = [i + end for i in enc.encode(texts)]
            for d, u, ids in zip(*(batch.column(c).to_pylist() for c in (ID, UID)), encoded):
                n = len(ids) // width
                if keys and size + n > shard_ids:
                    yield flush()
                    keys.clear()
                    payload.clear()
                    seq, size = seq + 1, 0
                copy = copy + 1 if (d, u) == last else 0
                last = (d, u)
                keys.append((d, u, copy))
                payload.append(ids)
                size += n
        if keys:
            yield flush()

    return written(parts.mapInArrow(shards, _SHARDS), "id-shards")


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds ``first``, the ids before each shard.  The running sum is over one
    row per shard, without their contents."""
    places = shards.select("part", "seq", "n_ids")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    first = written(places.select("part", "seq", F.coalesce(
        F.sum("n_ids").over(order), F.lit(0)).cast("long").alias("first")), "id-starts")
    return shards.join(first, ["part", "seq"])  # Spark broadcasts it while it is small


def read_documents(shards: DataFrame) -> DataFrame:
    """Look every stored document up in its shard and read its ids back:
    ``doc_id, start, n_tokens, ids_crc32``."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            ids, uids, copies = (np.frombuffer(row[c], np.int64)
                                 for c in ("docs", "uids", "copies"))
            shard = Shard(row["shard"])
            found = shard.find(ids, uids, copies)
            if (found < 0).any():
                raise ValueError("a stored key is missing from its index")
            out = [shard.payload(k) for k in found]
            yield {ID: ids, "start": [row["first"] + int(shard.offsets[k]) for k in found],
                   "n_tokens": [len(o) for o in out],
                   "ids_crc32": [zlib.crc32(o.astype("<u4").tobytes()) for o in out]}

    got = arrow_map(with_starts(shards), run,
                    f"{ID} long, start long, n_tokens long, ids_crc32 long")
    return got.select(public_id(), "start", "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of the documents in ``wanted`` (``doc_id``, ``text``), one row per
    stored copy: each shard is asked for the keys in its own range.

    The directory has one row per shard with its first and last doc_id; the
    join on it is by range of ids, so ``wanted`` is matched through the ids
    that the shard lists, not against every shard.
    """
    keys = keyed(wanted).distinct()
    listed = arrow_map(
        shards.select("part", "seq", "docs", "uids", "copies"),
        lambda b: ({"part": [b.column("part")[i].as_py()] * (len(b.column("docs")[i].as_py()) // 8),
                    "seq": [b.column("seq")[i].as_py()] * (len(b.column("docs")[i].as_py()) // 8),
                    ID: np.frombuffer(b.column("docs")[i].as_py(), np.int64),
                    UID: np.frombuffer(b.column("uids")[i].as_py(), np.int64),
                    "copy": np.frombuffer(b.column("copies")[i].as_py(), np.int64)}
                   for i in range(b.num_rows)),
        f"part int, seq int, {ID} long, {UID} long, copy long")
    asked = listed.join(keys, [ID, UID]).groupBy("part", "seq").agg(
        F.collect_list(F.struct(ID, UID, "copy")).alias("asked"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            k = np.array([(a[ID], a[UID], a["copy"]) for a in batch.column("asked")[i].as_py()],
                         np.int64).reshape(-1, 3)
            shard = Shard(batch.column("shard")[i].as_py())
            found = shard.find(k[:, 0], k[:, 1], k[:, 2])
            yield {ID: k[:, 0], "ids": [shard.payload(n).astype("<u4").tobytes() for n in found]}

    got = arrow_map(asked.join(shards.select("part", "seq", "shard"), ["part", "seq"]), run,
                    f"{ID} long, ids binary")
    return got.select(public_id(), "ids")
