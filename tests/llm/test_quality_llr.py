import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import arrays as A, quality_llr as Q
from tests.conftest import SMALL
from tests.llm.helpers import awkward, frame, words


def base_columns(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n, covered = Counter(wins), set()
    for i, x in enumerate(wins):
        if n[x] >= 2:
            covered.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def grams(text):
    raw = " ".join(words(text)).encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, wo = A.word_spans(data, np.array([0, len(data)]))
    h = [int(x) for x in A.word_hashes(data, s, e)]
    two = [int(x) for x in A.window_prints(np.array(h, np.uint64), 2)]
    return [x % Q.BUCKETS for x in h + two]


def brute(texts, good):
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        g = grams(t)
        raw.update(g)
        if i in good:
            target.update(g)
    n, m = sum(raw.values()) + Q.BUCKETS, sum(target.values()) + Q.BUCKETS
    out = []
    for t in texts:
        g = grams(t)
        s = sum(math.log((target[x] + 1) / m) - math.log((raw[x] + 1) / n) for x in g) / len(g) if g and target else 0.0
        out.append(s)
    return out


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(spark, texts, labels):
    docs = frame(spark, texts).repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(texts, {d for d, q, t in labels if q == 1 and not t})
    got = Q.judge(docs, table).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLS) == base_columns(texts[r.doc_id]), texts[r.doc_id]
        assert r.llr == pytest.approx(want[r.doc_id], abs=2e-6)
        if abs(r.llr - Q.THRESHOLD) > 1e-4:
            assert r.kept == (not r.base_failed and want[r.doc_id] >= Q.THRESHOLD)


def test_equal_brute_force(spark):
    rng = random.Random(2)
    texts = awkward(rng) + ["a b c d e f g h " * 2 + "x", "l1 a\nl1 a\n \n \nl1 a", "# * & | <> a", "w " * 19, "q r s t u v w x y z " * 3]
    check(spark, texts, [(5, 1, 0), (5, 1, 0), (13, 1, None), (12, 1, 1), (11, 0, 0), (None, 1, 0), (999, 1, 0)])
    check(spark, texts, [])


def test_whole_table_and_empty(spark):
    rows = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert [r.doc_id for r in rows] == list(range(len(rows)))
    check(spark, [r.text for r in rows], labels)
    docs = frame(spark, ["a"])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert Q.judge(docs.where("false"), table).count() == 0


def backed_off(texts, good, i):
    """Score of text i under the target of the other good texts, half backed off to all texts."""
    raw, target = Counter({b: 1 for b in range(Q.BUCKETS)}), Counter()
    for j, t in enumerate(texts):
        raw.update(grams(t))
        if j in good and j != i:
            target.update(grams(t))
    n, m = sum(raw.values()), max(sum(target.values()), 1)
    g = grams(texts[i])
    return sum(math.log(0.5 * target[x] / m / (raw[x] / n) + 0.5) for x in g) / len(g) if g and good else 0.0


def test_target_documents_are_scored_without_themselves(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(40)) for _ in range(12)] + ["", None]
    labels = [(0, 1, 0), (1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 0, 0), (12, 1, 0), (77, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {0, 1, 2, 12}
    once = frame(spark, texts)
    for docs, ids in ((once, list(range(14))), (once.union(once.where("doc_id = 1")), [*range(14), 1])):
        got = Q.judge(docs, table, threshold=None).collect()
        assert sorted(r.doc_id for r in got) == sorted(ids)
        if docs is once:
            assert all(r.llr == pytest.approx(backed_off(texts, good, r.doc_id), abs=2e-6) for r in got)
        assert len({(r.llr, r.kept) for r in got if r.doc_id == 1}) == 1
    none = Q.judge(once, table.where("false"), threshold=None).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in none)
    carried = Q.judge(once, table, threshold=None, carry=True)
    assert carried.select("row.*").columns == once.columns and carried.count() == len(texts)
    assert Q.held_out_cut(np.array([1.0, 2.0, 3.0]), np.array([-1.0, 0.0])) == 0.5


def test_few_labels_keep_the_same_good_documents(spark):
    from panelspark.llm.queries import op10_llr
    from tests.conftest import MEDIUM
    import tempfile
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    ids = [r.doc_id for r in labels.where("quality = 1 and toxic = 0").orderBy("doc_id").collect()]
    few = set(ids[::6])
    at = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    docs.write.parquet(f"{at}/documents.parquet")
    labels.where(F.col("doc_id").isin(list(few)) | (F.col("quality") == 0)).write.parquet(f"{at}/labels.parquet")
    got = op10_llr(spark, at).collect()
    rest = [r for r in got if r.doc_id in set(ids) - few and not r.base_failed]
    assert sum(r.kept for r in rest) >= 0.9 * len(rest)
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    bad = [r for r in got if r.doc_id in junk and not r.base_failed]
    assert sum(r.kept for r in bad) <= 0.5 * len(bad)


def test_every_labelled_row_counts(spark):
    """No cap on the labelled rows: 5,000 good ones are the target, and brute force over all of them gives the scores."""
    assert Q.trusted_ids(spark.range(5000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")).count() == 5000
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(3)) for _ in range(4500)]
    want = brute(texts, set(range(4400)))
    table = spark.createDataFrame([(i, int(i < 4400), 0) for i in range(4500)], "doc_id long, quality int, toxic int")
    assert all(r.llr == pytest.approx(want[r.doc_id], abs=2e-6) for r in Q.judge(frame(spark, texts), table).collect())


def test_the_cut_in_spark_equals_the_cut_of_arrays(spark):
    rng = np.random.default_rng(6)
    cases = [(rng.normal(0.2, 0.2, 300), rng.normal(-0.1, 0.2, 200)), (np.array([1.0, 2.0, 3.0]), np.array([-1.0, 0.0])),
             (rng.integers(0, 6, 60) / 4, rng.integers(-3, 4, 50) / 4), (np.array([0.5]), np.array([])), (np.array([]), np.array([0.5])),
             (np.array([0.1001, 0.1002, 0.1003]), np.array([0.1004, 0.1005]))]
    for good, junk in cases:
        good, junk = np.round(good, 6), np.round(junk, 6)
        rows = [(True, float(x)) for x in good] + [(False, float(x)) for x in junk]
        assert Q.cut_of(spark.createDataFrame(rows, "good boolean, llr double").repartition(3)) == Q.held_out_cut(good, junk)
