import hashlib
import random

import numpy as np
import pytest

from panelspark.llm import arrays as A, recompress as R
from tests.conftest import SMALL
from tests.llm.helpers import awkward, frame, rows_of, sentence, words


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for x in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[x:x + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for x in range(len(w) - window + 1):
            if i is not None and first[tuple(w[x:x + window])] < i:
                gone.update(range(x, x + window))
        kept = " ".join(y for j, y in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, window):
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows]).repartition(3)
    got = rows_of(R.remove_repeats(docs, window), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute(rows, window)


def test_equal_windows_share_their_anchor():
    """The guarantee the search rests on, over many contexts and small alphabets."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        size = rng.integers(2, 30)
        core = rng.integers(0, size, 50)
        texts = [np.concatenate([rng.integers(0, size, rng.integers(0, 40)), core, rng.integers(0, size, rng.integers(0, 40))]) for _ in range(3)]
        at = [len(t) for t in texts]
        places = []
        for t in texts:
            h = A.mix(t.astype(np.uint64) + np.uint64(1))
            starts, anchor = R.anchors(h, np.array([0, len(t)]), 50)
            own = [i for i in range(len(t) - 49) if (t[i:i + 50] == core).all()]
            places.append({int(anchor[np.searchsorted(starts, i)]) - i for i in own})
        assert places[0] == places[1] == places[2] and len(places[0]) == 1, (trial, at)


@pytest.mark.parametrize("window", [30, 50])
def test_planted_repeats(spark, window):
    rng = random.Random(window)
    passage, short = sentence(rng, 90), sentence(rng, window - 1)
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(5, 120))]
        if i % 3 == 0:
            lo = rng.randrange(0, 30)
            parts.append(" ".join(passage.split()[lo:lo + rng.randrange(window, 90)]))
        if i % 4 == 0:
            parts.append(short)
        parts.append(sentence(rng, rng.randrange(5, 60)))
        rows.append((1000 - i if i % 2 else i, "\n".join(parts)))
    rows += [(2000, passage), (2001, passage), (2002, passage + " " + passage), (5, "the " * 200), (6, "the " * 55 + "end"), (7, "x " + "the " * 50)]
    check(spark, rows, window)


def test_awkward_rows(spark):
    texts = awkward(random.Random(8))
    rows = list(enumerate(texts))
    rows += [(5, texts[5]), (5, texts[12]), (None, texts[5]), (None, sentence(random.Random(9), 70)), (99, texts[11]), (98, texts[11] + " more")]
    check(spark, rows, 50)
    assert R.remove_repeats(frame(spark, ["a"]).where("false")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = rows_of(R.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute(rows, 50)
