"""Words that a polynomial hash modulo 2**64 cannot tell apart, in every operator that hashes words."""

import numpy as np

from panelspark.llm import arrays as A, bagminhash, decontam, quality_llr, recompress
from tests.llm.helpers import frame

FLIP = str.maketrans("ab", "ba")
X = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))          # a Thue-Morse word and its complement
Y = X.translate(FLIP)


def hashes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = A.word_spans(data, np.array([0, len(data)]))
    return A.word_hashes(data, s, e, both=True)


def test_both_families_tell_them_apart():
    for n in (64, 512, 1024, 4096):
        x = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        h, g = hashes(f"{x} {x.translate(FLIP)} {x}")
        assert h[0] != h[1] and g[0] != g[1] and h[0] == h[2] and g[0] == g[2]


def test_hash_does_not_depend_on_the_place():
    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 40)))) for _ in range(40000)] + [X, Y, "z" * 300000]
    text = " ".join(words)                                                  # several pieces, one word longer than a piece
    h, g = hashes(text)
    at = rng.integers(0, len(words), 300).tolist() + [40000, 40001, 40002]
    for i in at:
        one, two = hashes(words[i])
        assert one[0] == h[i] and two[0] == g[i]
    assert len(np.unique(h)) == len(np.unique(g)) == len(set(words))


def test_substring_dedup(spark):
    rest = " ".join(f"w{i}" for i in range(60))
    texts = [f"{rest[:100]} {X} {rest[100:]}", f"{rest[:100]} {Y} {rest[100:]}", f"{rest[:100]} {X} {rest[100:]}"]
    got = {r.doc_id: r.n_removed for r in recompress.remove_repeats(frame(spark, texts)).collect()}
    assert got[1] == 0 and got[2] > 50


def test_decontamination(spark):
    bench = spark.createDataFrame([("q1", X), ("q2", f"some words before {X} and after it too")], "item_id string, text string")
    got = {r.doc_id: r.n_hit for r in decontam.find_leaks(frame(spark, [Y, X, f"some words before {Y} and after it too"]), bench).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_near_duplicates(spark):
    texts = [" ".join([f"{w}"] * 6) for w in (X, Y, X)]
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_repeated_windows():
    def repeated(a, b):
        data = np.frombuffer(f"{a} 1 2 3 4 5 6 7 {b} 1 2 3 4 5 6 7".encode(), np.uint8)
        s, e, wo = A.word_spans(data, np.array([0, len(data)]))
        return int(quality_llr._repeats(*A.word_hashes(data, s, e, both=True), wo, 8).sum())
    assert repeated(X, X) == 16 and repeated(X, Y) == 0
