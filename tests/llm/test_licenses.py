import math
import random
import re

from panelspark.llm import licenses as L
from tests.conftest import SMALL
from tests.llm.helpers import awkward, frame, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(L._UPPER, L._LOWER)


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    w = words(text)
    starts, labels = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    step = max((len(t.split()) for _, t in templates), default=1)
    more, best = set(), 0.0
    for x in range(max(math.ceil(len(w) / step) - 2, 0) + 1):
        block = set(w[x * step:x * step + 2 * step])
        for label, t in templates:
            tokens = set(t.split())
            if tokens and len(block & tokens) >= math.ceil(threshold * len(tokens) - 1e-9):
                more.add(label)
                best = max(best, len(block & tokens) / len(tokens))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | more)), 1.0 if starts else best)


def same(spark, texts, ids=None, **options):
    docs = frame(spark, texts, ids=ids).repartition(3)
    got = sorted((tuple(r) for r in L.scan(docs, **options).collect()), key=repr)
    want = sorted(((ids[i] if ids else i, *brute(t, options.get("templates") or L.TEMPLATES, options.get("threshold", L.THRESHOLD))) for i, t in enumerate(texts)), key=repr)
    assert got == want
    return got


def test_phrases_and_templates(spark):
    rng = random.Random(1)
    texts = []
    for label, t in L.TEMPLATES:
        w = t.split()
        for lost in (0, len(w) // 10, len(w) // 5, len(w) // 3):              # below and above the threshold
            kept = [x for i, x in enumerate(w) if i not in set(rng.sample(range(len(w)), lost))]
            texts.append(f"{sentence(rng, rng.randrange(200))}\n// {' '.join(kept).title()}.\n{sentence(rng, rng.randrange(200))}")
    texts += ["GNU  General-Public\nLicense, v3; the MIT license", "xgnu general public license", "gnu general public licenses", "CC BY-NC 4.0",
              "cc by cc by mit license apache license", "mit licenseé", "émit license", "MIT\x00LICENSE", "mit licenſe", "apache " * 50 + "license"]
    got = same(spark, texts)
    found = {r[0]: r[6].split(",") for r in got}
    assert all(label in found[4 * k] for k, (label, _) in enumerate(L.TEMPLATES))


def test_awkward_rows(spark):
    rng = random.Random(2)
    rows = awkward(rng) + ["mit license", "mit license", None]
    same(spark, rows)
    same(spark, ["mit license", "mit license", "cc by", None, "plain", " ".join(t for _, t in L.TEMPLATES)], ids=[None, None, 7, 7, 7, 7])
    docs = frame(spark, ["a"])
    assert L.scan(docs.where("false")).count() == 0 and L.scan(docs, templates=[]).count() == 1


def test_filters_lose_no_match(spark):
    """Small vocabularies: many overlaps near the threshold, tokens of equal frequency, hot tokens."""
    rng = random.Random(3)
    word = lambda k: f"w{rng.randrange(k)}"
    templates = [(f"t{i}", " ".join(word(14) for _ in range(rng.randrange(1, 12)))) for i in range(12)]
    texts = [" ".join(word(rng.choice([8, 14, 40])) for _ in range(rng.randrange(60))) for _ in range(150)]
    for threshold in (0.5, 0.8, 1.0):
        same(spark, texts, templates=templates, threshold=threshold)


def test_whole_table_has_no_template_in_clean_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: tuple(r)[1:] for r in L.scan(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = L.scan(docs)._jdf.queryExecution().executedPlan().toString() + L.matches(docs, L.TEMPLATES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
