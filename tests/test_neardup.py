"""Near duplicates: equal to brute force; sets verified grow with the texts."""

import glob
import os
import random

from vigil.operators import neardup as ND
from vigil.session import checkpoint_dir


def grams(t):
    w = t.encode().split()  # white space of ASCII
    return {tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def brute(rows):
    sets = [(i, g, grams(t or "")) for i, g, t in sorted(rows)]
    out = {}
    for i, g, s in sets:
        if s:
            near = [(j, len(s & o) / len(s | o)) for j, h, o in sets
                    if j < i and h == g and o and len(s & o) * 5 >= 4 * len(s | o)]
            out[i] = (len(s), *(near[0] if near else (None, None)))
    return out


def corpus(rng, n):
    words = [f"w{i}" for i in range(300)]
    passage = [f"p{i}" for i in range(20)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            t = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.randint(1, 50))]
            t += passage if rng.random() < 0.4 else []
        texts.append("\t".join(t) if rng.random() < 0.1 else " ".join(t))
    return texts


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"g{rng.randrange(2)}", t) for i, t in enumerate(corpus(rng, 500))]
    rows += [(600, "g0", ""), (601, "g0", None), (602, "g0", "one two"), (603, "g0", "one \n two"),
             (604, "g1", "one two"), (605, "g0", "\u00a0"), (606, "g0", "a\u00a0b c d")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, topic string, text string")
    got = {r.doc_id: (r.n, r.near_dup_of, r.jaccard) for r in ND.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_pairs_of_a_large_group_are_not_formed(spark, monkeypatch):
    """Texts alike in one group: about one verified pair a text, not all pairs."""
    pairs = []
    verified = ND._verified

    def count(now, *rest):
        pairs.append(now.count())
        return verified(now, *rest)

    monkeypatch.setattr(ND, "_verified", count)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, "g", " ".join(base[:i % 190] + [f"x{i}"] + base[i % 190 + 1:])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, topic string, text string")
    got = {r.doc_id: r.near_dup_of for r in ND.near_duplicates(df).collect()}
    assert got == {i: None if i == 0 else 0 for i in range(200)}
    assert sum(pairs) < 400


def test_nothing_and_no_group(spark):
    schema = "doc_id long, topic string, text string"
    assert ND.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, None, "a b c d"), (2, None, "a b c d"), (3, "g", "a b c d")], schema)
    assert sorted((r.doc_id, r.near_dup_of) for r in ND.near_duplicates(df).collect()) == [
        (1, None), (2, None), (3, None)]


def test_too_few_common_prefix_shingles_are_no_candidate(spark, monkeypatch):
    """Texts with one frequent passage, which ends each prefix: what they have in
    common there and what lies behind it cannot make them similar."""
    pairs = []
    verified = ND._verified

    def count(now, *rest):
        pairs.append(now.count())
        return verified(now, *rest)

    monkeypatch.setattr(ND, "_verified", count)
    rows = [(i, "g", " ".join([f"x{i}y{j}" for j in range(16)] + [f"w{j}" for j in range(100)]))
            for i in range(40)]
    rows += [(40, "g", rows[7][2] + " end")]
    df = spark.createDataFrame(rows, "doc_id long, topic string, text string")
    got = {r.doc_id: (r.n, r.near_dup_of, r.jaccard) for r in ND.near_duplicates(df).collect()}
    assert got == brute(rows) and got[40][1] == 7
    assert sum(pairs) < 5


def test_tables_and_shuffles_go(spark):
    """Only the result stays in the shared folder, and no shuffle files of what was
    written on the way."""
    rng = random.Random(5)
    rows = [(i, "g", t) for i, t in enumerate(corpus(rng, 60))]
    df = spark.createDataFrame(rows, "doc_id long, topic string, text string")
    folder = checkpoint_dir(spark).removeprefix("file:")
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
            .diskBlockManager().localDirs()]

    def shuffled():
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before, files = set(os.listdir(folder)), shuffled()
    got = ND.near_duplicates(df)
    assert [n.split("-")[1] for n in set(os.listdir(folder)) - before] == ["result"]
    assert not shuffled() - files
    assert {r.doc_id: r.near_dup_of for r in got.collect()} == {
        i: v[1] for i, v in brute(rows).items()}
