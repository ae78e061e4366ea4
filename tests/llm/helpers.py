"""Fixtures shared by the operator tests: awkward rows and brute-force text rules."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, count long, row string"


def words(text):
    return WORD.findall(text or "")


def frame(spark, texts, ids=None, langs=None):
    """A documents table with extra columns whose names clash with the operators' own."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "s", len(t or ""), 0.5, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng):
    """NULLs, empty and blank texts, ties, repeated rows, runs, odd characters and one long text."""
    base = sentence(rng, 120)
    return [None, "", " \n\t ", "one", "a b c", base, base, base.upper(), "x " * 300, "é ß 日本 語   😀\x00z", "a\x0bb\x1cc",
            sentence(rng, 20000), base + " tail", "Ünïcode " + base[:300], "\n".join(["same line here"] * 30), "==::password=", "'re 're  's"]


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)
