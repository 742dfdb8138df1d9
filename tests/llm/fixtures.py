"""A small corpus with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import random

DOCS = "doc_id long, text string, kept_id string, n_words int, bad_key string"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.randint(5, 80)), "en", 1, "x") for i in range(60)]
    base = say(60)
    rows += [(100 + i, base, "fr", 2, "y") for i in range(4)]  # copies
    rows += [(110 + i, base + f" tail{i}", None, None, None) for i in range(4)]  # near copies
    rows += [(200, say(6000) + "\n\n  " + say(50), "de", 3, "z")]  # long
    rows += [(300, None, "en", 1, "x"), (301, "", "en", 1, "x"), (302, " \n\t ", None, 1, "x"), (303, "!!! ???", "en", 1, "x")]
    rows += [(304, "Eins  zwei\tdrei", "de", 1, "x"), (305, "one", "en", 1, "x")]
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(None, say(20), "en", 1, "x"), (None, base, "en", 1, "x")]
    return rows


def frame(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(corpus() if rows is None else rows, schema).repartition(3)


def closure(n: int, links) -> list[int]:
    """Smallest index reachable from each of n items."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
