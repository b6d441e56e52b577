"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed letter n-grams; a linear
softmax reads the language off it.  Embeddings and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample; a
temperature fitted on rows kept out of the training calibrates the score, and
a text whose score falls below the threshold found there can be rejected.

Embedding and softmax are both linear, so for prediction their product, one
row of class scores per hash bucket, is all that a task needs.

Null texts and texts without a letter are ``und`` with score 0.  Without any
labelled row every text is ``und``.  Each text is judged by itself, so
repeated rows get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import arrow_map, claim, mix64, parts_by_bytes

UNKNOWN = "und"
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
DIM = 16
EPOCHS = 6
RATE = 0.5
#: Bound of the labelled sample, over all languages together.
SAMPLE = 4000
#: One row in five of the sample calibrates.
CALIBRATE = 5
#: Share of calibration rows that the threshold may reject, and its ceiling.
REJECT, CEILING = 0.002, 0.5
#: Characters of text handled at once (some 100 bytes of arrays each).
CHUNK = 1 << 18
#: Temperatures that the calibration tries.
TEMPERATURES = np.geomspace(0.002, 20, 90)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for i in range(0x110000):
        if chr(i).isalpha():
            table[i] = True
    return table


def gram_sets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash bucket, text number) of each n-gram, one length after the other:
    1 to 4 letters within a word, its edges marked by a blank."""
    lower = [t.lower() for t in texts]
    data = " " + " ".join(lower) + " "
    codes = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    # each text owns its characters and the blank before them
    owner = np.repeat(np.arange(len(lower), dtype=np.int32), [len(t) + 1 for t in lower])
    for n in GRAMS:
        m = len(codes) - n + 1
        if not lower or m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h *= np.uint64(0x100000001B3)
            h += codes[k:k + m]
        ok = letter[:m] | letter[n - 1:]
        for k in range(1, n - 1):  # only the first and last place may be an edge
            ok = (ok if k > 1 else True) & letter[k:k + m]
        ok[len(owner):] = False
        yield ((mix64(h[ok]) & np.uint64(BUCKETS - 1)).astype(np.int32),
               owner[:m][ok[:len(owner)]])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of some texts: (hash bucket, text number)."""
    parts = list(gram_sets(texts))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*parts))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, best
        z, has = self.logits(texts)
        p = softmax(z / self.temperature)
        top = p.argmax(axis=1)
        for i in np.flatnonzero(has):
            names[i] = self.langs[top[i]]
            best[i] = p[i, top[i]]
        return names, best

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class scores of each text, and whether it has a letter."""
        z = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        for a, b in parts_by_bytes([len(t) for t in texts], CHUNK):
            for bucket, owner in gram_sets(texts[a:b]):
                count[a:b] += np.bincount(owner, minlength=b - a)
                for k in range(len(self.langs)):
                    z[a:b, k] += np.bincount(owner, self.scores[bucket, k], minlength=b - a)
        return z / np.maximum(count, 1)[:, None] + self.bias, count > 0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[int, str, str]], seed: int = 7) -> Model:
    """Fit on (key, text, lang) rows; the order of the rows does not matter."""
    rows = sorted(rows)
    langs = sorted({r[2] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    place = {v: i for i, v in enumerate(langs)}
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (BUCKETS, DIM))
    W = rng.normal(0, 0.1, (DIM, len(langs)))
    bias = np.zeros(len(langs))
    fit = [r for i, r in enumerate(rows) if i % CALIBRATE or len(rows) < 2 * CALIBRATE]
    held = [r for i, r in enumerate(rows) if i % CALIBRATE == 0]
    data = []
    for _, text, lang in fit:
        bucket, _ = grams([text])
        if len(bucket):
            at, n = np.unique(bucket, return_counts=True)
            data.append((at, n / n.sum(), place[lang]))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(data)):
            at, w, y = data[i]
            x = w @ E[at]
            g = softmax((x @ W + bias)[None, :])[0]
            g[y] -= 1
            back = W @ g
            W -= rate * np.outer(x, g)
            bias -= rate * 0.1 * g
            # rare buckets get a full step each, weighted by their share
            E[at] -= rate * 20 * w[:, None] * back[None, :]
    model = Model(langs, (E @ W).astype(np.float32), bias, 1.0, 0.0)
    z, has = model.logits([r[1] for r in held])
    y = np.array([place[r[2]] for r in held])
    z, y = z[has], y[has]
    if len(y):
        # as many right answers promise one wrong one in n + 2 (Platt's targets),
        # so that a faultless sample does not ask for endless certainty
        target = np.full(z.shape, 1 / (len(y) + 2) / max(len(langs) - 1, 1))
        target[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)

        def loss(t: float) -> float:
            return -(target * np.log(softmax(z / t) + 1e-12)).sum(axis=1).mean()

        model.temperature = min(TEMPERATURES, key=loss)
        top = np.sort(softmax(z / model.temperature).max(axis=1))
        model.threshold = float(min(top[int(REJECT * len(top))], CEILING))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")),
                             F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out
    fold, spread evenly over the languages, in the order of a hash."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                      & F.col("text").isNotNull() & ~held_out())
    rows = rows.select(F.xxhash64("doc_id").alias("k"), F.col("lang").cast("string"), "text")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return train([])
    each = max(1, sample // len(counts))
    # the hash is uniform, so a share of its range is that share of the rows
    cut = F.create_map(*(F.lit(v) for r in counts for v in (
        r.lang, int(-2 ** 63 + min(1.0, each / r["count"]) * (2 ** 64 - 1)) if each < r["count"]
        else 2 ** 63 - 1)))
    got = rows.where(F.col("k") <= F.try_element_at(cut, F.col("lang"))).select("k", "text", "lang")
    return train([(r.k, r.text, r.lang) for r in got.limit(2 * sample).collect()])


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        claim("language")
        texts = [t or "" for t in batch.column("text").to_pylist()]
        names, score = held.value.predict(texts)
        yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
               "lang_pred": names, "score": score,
               "rejected": [n == UNKNOWN or s < held.value.threshold
                            for n, s in zip(names, score)]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"),
                                 "text"), run,
                     "doc_id long, held_out boolean, lang_pred string, score double, "
                     "rejected boolean")


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is recognised, all columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        m = held.value
        for batch in batches:
            names, score = m.predict([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([n != UNKNOWN and s >= m.threshold
                                         for n, s in zip(names, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
