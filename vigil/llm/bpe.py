"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

A byte-pair encoding is valid exactly when each adjacent pair of its tokens
re-merges to itself, so every byte prefix has one valid last token.  The
encoder stores that token per prefix: the next prefix needs only the tokens
that end there, each checked against the stored last token before it.  Adding
bytes therefore extends the table (``append``), and an edit recomputes it from
the edit to the place where it agrees with the old table again (``replace``).

Null and empty texts encode to no ids.  Each document is handled on its own,
so repeated rows get equal rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import arrow_map, claim, remembers

#: Unicode White_Space, which is what the split pattern means by \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space other than blank and line feed, and the separators that some
#: engines count as white space.
_OTHER_SPACE = re.compile(
    r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Pieces and words remembered per worker (two generations of each).
REMEMBERED = 300_000


def split_pattern(pattern: str) -> regex.Pattern:
    r"""Compile the public pattern with \s and \S spelled out."""
    out = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")
    return regex.compile(out.replace(r"\s", f"[{SPACE}]"))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Remembered(dict):
    """A dict that computes what is missing and forgets the older half."""

    def __init__(self, compute: Callable, limit: int = REMEMBERED) -> None:
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def trim(self) -> None:
        """Call between documents."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class PrefixBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.width = max(ranks.values()) + 1
        self._pairs = Remembered(self._check_pair, 1_000_000)
        self._singles: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Textbook merging, lowest rank first; used to judge token pairs."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, self.width), i)
                           for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == self.width:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _check_pair(self, key: int) -> bool:
        a, b = divmod(key, self.width)
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _single(self, token: int) -> bool:
        got = self._singles.get(token)
        if got is None:
            got = self._singles[token] = self.merged(self.bytes_of[token]) == [token]
        return got

    def _extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Grow ``last`` (last[i] is the last token of data[:i]) to ``upto``."""
        ranks, pairs, width = self.ranks.get, self._pairs, self.width
        for end in range(len(last), upto + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks(data[start:end])
                if token is not None and (
                        pairs[last[start] * width + token] if start else self._single(token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")

    def table(self, data: bytes) -> list[int]:
        last = [-1]
        self._extend(data, last, len(data))
        return last

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The table of data + more from that of data."""
        data, last = data + more, last[:]
        self._extend(data, last, len(data))
        return data, last

    def replace(self, data: bytes, last: list[int], start: int, end: int,
                new: bytes) -> tuple[bytes, list[int]]:
        """The table after data[start:end] becomes ``new``.

        Entries up to ``start`` stay.  Beyond the edit an entry depends on the
        ``longest`` bytes and entries before it only, so once that many agree
        with the old table the rest is copied.
        """
        out = data[:start] + new + data[end:]
        table, shift, agree = last[:start + 1], len(new) - (end - start), 0
        for at in range(start + 1, len(out) + 1):
            self._extend(out, table, at)
            if at > start + len(new):
                agree = agree + 1 if table[at] == last[at - shift] else 0
                if agree >= self.longest:
                    return out, table + last[at - shift + 1:]
        return out, table

    def ids(self, last: list[int]) -> list[int]:
        """Token ids of the whole string whose table this is."""
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and self._single(whole):
            return [whole]
        return self.ids(self.table(data))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextEncoder:
    """Encodes texts piece by piece and remembers what it has seen.

    A blank between two non-blank characters always begins a piece, so a text
    whose only blanks are such is cut at them and each part is looked up.
    """

    def __init__(self, bpe: PrefixBPE, pattern: str) -> None:
        self.bpe, self.pattern = bpe, split_pattern(pattern)
        self._pieces = Remembered(lambda p: np.array(
            bpe.encode_piece(p.encode("utf-8", "surrogatepass")), "<u4").tobytes())
        self._parts = Remembered(lambda p: self._cut(" " + p))

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if regular(text):
            first, *rest = text.split(" ")
            out = self._cut(first) + b"".join(map(self._parts.__getitem__, rest))
        else:
            out = self._cut(text)
        self._pieces.trim()
        self._parts.trim()
        return out


def regular(text: str) -> bool:
    """True if every blank stands alone between two non-space characters."""
    return not ("  " in text or "\n " in text or " \n" in text or text[:1] == " "
                or text[-1:] == " " or _OTHER_SPACE.search(text))


def public_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str | None = None, pattern: str | None = None) -> TextEncoder:
    """One encoder per worker; null means the public rank file and pattern."""
    import public_tokenizers

    return TextEncoder(PrefixBPE(load_ranks(path or public_ranks())),
                       pattern or public_tokenizers.PATTERN)


remembers("bpe", encoder.cache_clear)


def encode_documents(docs: DataFrame, path: str | None = None,
                     pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: the ids (binary, little-endian
    unsigned 32-bit) of each text and the bytes they decode to."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        claim("bpe")
        enc = encoder(path, pattern)
        ids = [enc.encode(t or "") for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids],
               "ids": ids,
               "decoded": [enc.bpe.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     "doc_id long, n_tokens long, ids binary, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
