"""Texts and tables that the tests of this folder share."""

import random

ODD = [
    None, "", " \t\n", "one", "two words", "a b c", "A B C", "a  b\tc", "ünïcode wörter größer", "🤦 漢字 x", "x" * 5000,
    "word " * 3000, "same line here\nsame line here\n", "a b c", "[INST] <|x|> </s> \\ \\| <<SYS>>",
]


def documents(spark, texts, ids=None, **extra):
    """A table with the columns of documents and some with names that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src", len(t or ""), "x", 1, None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, id string, key int, gone string"
    )


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w%d" % int(vocabulary * r.random() ** 2) for _ in range(words))


def edited(text, seed, changes):
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = "edit%d" % r.randrange(10**6)
    return " ".join(words)
