import math
import random
import zlib

import numpy as np
import pyarrow as pa

from panelspark.llm import arrays as A, lang_ppm as L
from panelspark.llm.queries import op1_language_ppm
from tests.conftest import MEDIUM
from tests.llm.helpers import awkward, frame


def brute_bits(train: list[bytes], text: bytes) -> float:
    """Code length by dictionaries, byte by byte."""
    ctx = [{} for _ in range(L.ORDER + 1)]
    low = lambda b: b.translate(bytes(A.LOWER.tolist()))
    for t in map(low, train):
        for i in range(len(t)):
            for k in range(min(L.ORDER, i) + 1):
                d = ctx[k].setdefault(t[i - k:i], {})
                d[t[i]] = d.get(t[i], 0) + 1
    t, bits = low(text), 0.0
    for i in range(len(t)):
        for k in range(min(L.ORDER, i), -1, -1):
            d = ctx[k].get(t[i - k:i])
            if d is None:
                continue
            n = sum(d.values()) + len(d)
            if t[i] in d:
                bits -= math.log2(d[t[i]] / n)
                break
            bits -= math.log2(len(d) / n)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force(spark):
    train = {"aa": ["the cat sat on the mat", "a hat, a Cat"], "bb": ["zwei hüte und drei mäntel", "und"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, x) for k, v in train.items() for x in v)]
    m = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == ["aa", "bb"]
    texts = ["", "t", "the", "The hat und 日本", "zzz###", "hüte " * 50]
    data, off = A.text_buffers(pa.array(texts))
    got = m.bits(data, off)
    want = [[brute_bits([x.encode() for x in train[lang]], t.encode()) for lang in m.langs] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_long_rows_go_through_in_parts(monkeypatch, spark):
    m = L.fit(spark.createDataFrame([(1, "abc abd abe " * 20, "aa")], "doc_id long, text string, lang string"))
    text = "abd abx " * 4000
    data, off = A.text_buffers(pa.array([text, "", "a"]))
    assert np.allclose(m.bits(data, off)[0, 0], brute_bits([b"abc abd abe " * 20], text.encode()), rtol=1e-5)


def test_awkward_rows(spark):
    texts = awkward(random.Random(1)) + ["123 456", "!!!"]
    docs = frame(spark, texts, langs=[None if i % 3 else "en" for i in range(len(texts))])
    docs = docs.union(docs)
    got = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.identify(docs, L.fit(L.training_rows(docs))).collect()}
    assert len(got) == len(texts)
    for i, pred, score in got:
        letter = any(c.isalpha() for c in texts[i] or "")
        assert pred == ("en" if letter else "und") and 0 <= score <= 1
    kept = L.accept(docs, L.fit(L.training_rows(docs)))
    assert kept.columns == docs.columns
    none = L.identify(docs, None)
    assert {r.lang_pred for r in none.collect()} == {"und"} and L.accept(docs, None).count() == docs.count()
    assert L.fit(docs.where("false")) is None
    assert L.identify(docs.where("false"), L.fit(L.training_rows(docs))).count() == 0


def test_query_contract_and_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = op1_language_ppm(spark, MEDIUM).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
