"""Rows that every operator must take."""

import random

CLASHING = ("key", "id", "fp", "length", "line", "lost", "doc", "x", "n", "score", "copy", "task", "k_id", "rank")


def words(seed, n, stock=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def awkward_rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeats."""
    long = words(1, 20_000)
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (None, "no id here at all", "en", "b"),
        (None, "no id here at all", "en", "b"), (3, long, "en", "a"), (4, long, None, "c"),
        (5, "one", "fr", "a"), (5, "one", "fr", "a"), (6, "  \n\t ", "de", "b"),
        (7, "ünï çödé \U0001f600 <|endoftext|> 日本語 ßtraße İ", "de", "c"), (8, "\n\n", "es", "d"),
    ]
    return rows + [(20 + i, words(i, 30 + i) + "\n" + words(i + 7, 12), "en", f"s{i % 9}") for i in range(40)]
