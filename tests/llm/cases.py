"""Small tables that hold the awkward cases."""

import random

WORDS = ("the of and to in is that for it as was with be by on not he his but at are this have "
         "from or had an they which one you were her all she there would their we him been has "
         "when who will more no if out so said what up its about into than them can only").split()

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words string, "
          "score string, kept string, node string, class string, start string, ids string")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(rng):
    long_text = "\n".join(sentence(rng, 60) for _ in range(80))
    base = sentence(rng, 120)
    near = base.split()
    near[50] = "different"
    return [
        (None, None), (None, "a text without an id " + sentence(rng, 20)),
        (1, ""), (2, " \n\t "), (3, long_text), (4, base), (4, base),  # a repeated row
        (4, "the same id, another text\n" + sentence(rng, 10)), (5, base),  # a copy
        (6, " ".join(near)), (7, "x" * 30_000), (8, "ab" * 400), (9, "one two three"),
        (10, "one two three"), (11, None), (12, "éß日本 \U0001f642\x1c  token=abcdefghijkl12"),
        (13, "line one is here now\nline one is here now\n\n\n\nline one is here now"),
        (14, "\n\n\n\n\n"), (15, base[:300]), (16, "12 34 %%% ||| ###"), (2 ** 62, sentence(rng, 60)),
        (-5, sentence(rng, 60)), (17, long_text + "\n" + sentence(rng, 40)),
    ]


def documents(spark, rows=None, seed=5):
    """Documents with awkward texts and extra columns whose names clash."""
    rng = random.Random(seed)
    rows = texts(rng) if rows is None else rows
    langs, sources = [None, "en", "fr"], [None, "a", "b"]
    return spark.createDataFrame(
        [(d, t, langs[i % 3], sources[i % 2], len(t or ""), "x", "y", "z", "n", "c", "s", "i")
         for i, (d, t) in enumerate(rows)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
