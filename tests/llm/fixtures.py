"""Small made-up documents for the text operators."""

import random

SYLLABLES = {"en": "the and tion ing er re on at en st".split(), "fr": "le que eau ment oi ré tre ou ai ille".split(), "de": "sch ein ung keit der ich zu ge ö ver".split()}


def words(rnd, n, lang="en"):
    return ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def prose(rnd, n, lang="en"):
    out = []
    while n > 0:
        k = min(n, rnd.randint(3, 14))
        out.append(" ".join(words(rnd, k, lang)).capitalize() + ".")
        n -= k
    return " ".join(out)


#: Texts that every operator must take: null, empty, white space, one word, no letters, very long, odd characters.
ODD = [None, "", "   ", "\n\n", "one", "two words", "12 345 !!", "Straße ΣΑΣ İ é é 中文 🙂", "a\x00b\x1fc\x85d\xa0e", "<|endoftext|> <|startoftext|>x", "the " * 30000, "x" * 20000, "one", "one"]


def odd_documents(spark):
    """Rows with nulls in every column, ties and repeated rows, and further columns with telling names."""
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, None, i) for i, t in enumerate(ODD)]
    rows += [(5, "two words", "en", "s", 1), (5, "two words", "en", "s", 1), (6, "another text with an id that is taken", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key long").selectExpr("*", "length(text) as n_chars", "'x' as component_id", "0.5 as score", "1 as at")


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
