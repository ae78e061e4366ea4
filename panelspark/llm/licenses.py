"""License scans with an exact set-similarity join, in DataFrame and SQL functions only.

Fixed phrases are found as runs of words.  Besides, a text block that contains at least ``THRESHOLD`` of the distinct
words of a license template gets the template's label.  A block is a window of ``2 * step`` consecutive
words, ``step`` being the word count of the longest template; one starts every ``step`` words (a shorter text
is one block), so a passage as long as a template lies whole in a block.

Only words of some template can add to an overlap, so a block is joined as the set of its template
words.  The join works on tokens in one global order, the rarest in the corpus first (frequencies are counted
over all texts):

- prefix: an overlap of ``need = ceil(threshold * |T|)`` tokens must touch the first ``|T| - need + 1`` tokens of T, so
  only these, the rarest, are join keys, and only texts that hold one of them are cut into blocks;
- length: a block with fewer than ``need`` template words is left out;
- position: with the pair's first common token at place i of T and j of the block, at most
  ``1 + min(|T| - i - 1, |B| - j - 1)`` tokens can be common;
- what is left is verified on the whole sets.

Templates are a parameter of bounded size (``MAX_WORDS`` words), so the prefix table is a broadcast; blocks never
leave their task, and only matches are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.scratch import stored

THRESHOLD = 0.8
MAX_WORDS = 20000      # words of all templates together

# fixed values: the phrases of the contract and their labels
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# fixed values: the notices that public licenses ask for, lower case, without punctuation
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
               "you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
               "basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
            "from this software without specific prior written permission"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
            "that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
             "license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"          # word characters of a text before A-Z are lower-cased
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pattern(phrase: str) -> str:
    """The phrase as whole words with anything but word characters between them, A-Z in either case."""
    words = f"{_GAP}+".join(phrase.split())
    return rf"(?i)(?<!{_WORD}){words}(?!{_WORD})"


def _any_word(words: list[str]) -> str:
    """Any of the words as a whole word, A-Z in either case; words share their first letter's branch."""
    first: dict[str, list[str]] = {}
    for w in sorted(words):
        first.setdefault(w[0], []).append(w[1:])
    branches = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items())
    return f"(?i)(?:^|{_GAP})(?:{branches})(?:{_GAP}|$)"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _words() -> Column:
    return F.regexp_extract_all(F.translate(_text(), _UPPER, _LOWER), F.lit(f"{_WORD}+"), 0)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, uid, n_words, n_base, first_word, last_word, base_list: the fixed phrases of each row."""
    text, count = _text(), lambda t: F.regexp_count(t, F.lit(f"{_WORD}+")).cast("long")
    any_ = "(?i)" + "|".join(_pattern(p).removeprefix("(?i)") for p, _ in PHRASES)
    some = text.rlike(any_)
    first = F.regexp_extract(text, rf"(?s)^(.*?)(?:{any_})", 1)
    last = F.regexp_extract(text, rf"(?s)^(.*)(?:{any_})", 1)
    labels = F.array_compact(F.array(*[F.when(text.rlike(_pattern(p)), F.lit(label)) for p, label in PHRASES]))
    none = F.array().cast("array<string>")
    return docs.select("doc_id", F.xxhash64("text").alias("uid"), count(text).alias("n_words"),
                       F.when(some, F.regexp_count(text, F.lit(any_))).otherwise(0).cast("long").alias("n_base"),
                       F.when(some, count(first)).alias("first_word"), F.when(some, count(last)).alias("last_word"),
                       F.when(some, labels).otherwise(none).alias("base_list"))


def matches(docs: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, uid, label, block, score): blocks whose containment of a template reaches the threshold.

    One row for each block and label, with the largest containment; exact for every block."""
    spark = docs.sparkSession
    words = [(label, text.split()) for label, text in templates if text.split()]
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a share of the template's words, above 0")
    if sum(len(w) for _, w in words) > MAX_WORDS:
        raise ValueError(f"the templates hold more than {MAX_WORDS} words")
    vocabulary = sorted({t for _, w in words for t in w})
    # counts of the template words over all texts; they order the tokens, and any order gives the same result
    token = F.lower(F.col("token")).alias("token")
    counted = (docs.select(F.explode(F.split(_text(), f"{_GAP}+")).alias("token")).where(token.isin(vocabulary))
               .groupBy(token).agg(F.count("*").alias("n")))
    seen = {r.token: r.n for r in counted.collect()}                     # one row for each template word at most
    order = sorted(vocabulary, key=lambda t: (seen.get(t, 0), t))
    place = {t: i for i, t in enumerate(order)}
    prefix, least = [], 1 << 30
    for k, (label, w) in enumerate(words):
        tokens = sorted(set(w), key=place.get)
        need = max(math.ceil(threshold * len(tokens) - 1e-9), 1)
        least = min(least, need)
        prefix += [(t, k, label, i, len(tokens), need, tokens) for i, t in enumerate(tokens[:len(tokens) - need + 1])]
    schema = "token string, template int, label string, i int, size int, need int, tokens array<string>"
    table = F.broadcast(spark.createDataFrame(prefix, schema))           # at most MAX_WORDS rows
    step = max((len(w) for _, w in words), default=1)
    keys = sorted({p[0] for p in prefix})
    ordered = F.array(*[F.lit(t) for t in order]).cast("array<string>")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / step).cast("int") - 2, F.lit(0)))
    some = docs.where(F.col("text").rlike(_any_word(keys))) if keys else docs.where("false")
    blocks = (some.select("doc_id", F.xxhash64("text").alias("uid"), _words().alias("words"))
              .select("doc_id", "uid", F.posexplode(F.transform(starts, lambda b: F.array_intersect(ordered, F.slice("words", b * step + 1, 2 * step)))))
              .select("doc_id", "uid", F.col("pos").alias("block"), F.col("col").alias("b")).where(F.size("b") >= least))
    keyed = F.array_intersect("b", F.array(*[F.lit(t) for t in keys]).cast("array<string>"))
    pairs = blocks.withColumn("token", F.explode(keyed)).join(table, "token")
    j = F.array_position("b", F.col("token")) - 1
    first = F.element_at(F.array_intersect("b", "tokens"), 1) == F.col("token")        # each pair once, at its first common token
    able = (F.size("b") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("b") - j - 1) >= F.col("need"))
    share = F.size(F.array_intersect("b", "tokens")) / F.col("size")
    return (pairs.where(able & first).where(F.size(F.array_intersect("b", "tokens")) >= F.col("need"))
            .groupBy("doc_id", "uid", "label", "block").agg(F.max(share).alias("score")))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    ``score`` is 1 where a fixed phrase stands, else the largest containment of a matching template, else 0.
    Defined results: a NULL text is empty; a text without words has no block; repeated rows each
    give their row; ids given twice or NULL keep their texts apart; no templates or an
    empty table give no matches and no rows.  Other columns are ignored."""
    found = matches(docs, TEMPLATES if templates is None else templates, threshold)
    per_row = stored(found.groupBy("doc_id", "uid").agg(F.collect_set("label").alias("more"), F.max("score").alias("best")), "license-matches")
    rows = base(docs)
    key = [rows["doc_id"].eqNullSafe(per_row["doc_id"]) & (rows["uid"] == per_row["uid"])]
    joined = rows.join(per_row, key, "left").select(rows["*"], "more", "best")
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    both = F.concat("base_list", F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", names(F.col("base_list")).alias("base_labels"),
                         names(both).alias("labels"), score.alias("score"))
