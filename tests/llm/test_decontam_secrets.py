import hashlib
import random
import re

import pytest

from panelspark.llm import decontam as D, secrets as X
from tests.conftest import MEDIUM, SMALL
from tests.llm.helpers import awkward, frame, rows_of, sentence

FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return FOLDED.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(docs, items, window=10):
    wins = {}
    for item, t in items:
        w = folded(t)
        if item is None or not w:
            continue
        k = min(len(w), window)
        for i in range(len(w) - k + 1):
            wins.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w, hit, found = folded(t), set(), set()
        for k in sizes:
            for x in range(len(w) - k + 1):
                got = wins.get(tuple(w[x:x + k]))
                if got:
                    found |= got
                    hit.update(range(x, x + k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")




def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(8, 40), 60)) for i in range(30)]
    items += [(30, "Only Three words"), (31, "x"), (32, None), (None, "a b c d e f g h i j k"), (33, ""), (34, "..."), (5, "another text of item five, which is longer than ten words are")]
    items += [(35, items[3][1]), (36, "la " * 30), (10, "é ß 日本 語 1 2 3 4 5 6 7 8 9")]
    texts = awkward(rng)
    for i in range(60):
        t = items[rng.randrange(30)][1].split()
        lo = rng.randrange(0, max(1, len(t) - 8))
        texts.append(sentence(rng, rng.randrange(0, 40), 60) + " " + ", ".join(t[lo:lo + rng.randrange(8, 30)]).upper() + ". " + sentence(rng, 5))
    texts += ["only THREE-words", "only three", "la la " * 12, "a-x-b", "é ß 日本 語 1 2 3 4 5 6 7 8 9"]
    docs = frame(spark, texts).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(D.find_leaks(docs, bench), *COLS) == brute_leaks(list(enumerate(texts)), items)


def test_leaks_on_the_whole_table_and_empty_inputs(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert rows_of(D.find_leaks(docs, bench), *COLS) == brute_leaks(rows, items)
    assert D.find_leaks(docs, bench.where("false")).where("contaminated").count() == 0
    assert D.find_leaks(docs.where("false"), bench).count() == 0
    kept = D.remove_leaks(docs, bench)
    dirty = {r[0] for r in brute_leaks(rows, items) if r[5]}
    assert dirty and kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in dirty)


def test_leaks_of_crowded_bitmaps_null_ids_and_repeated_rows(spark):
    """A vocabulary of twelve words: many candidates that are none, the same rows."""
    rng = random.Random(9)
    items = [(str(i), sentence(rng, rng.randrange(1, 30), 12)) for i in range(40)]
    texts = [sentence(rng, rng.randrange(0, 60), 12) for _ in range(80)]
    want = brute_leaks(list(enumerate(texts)), items)
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert rows_of(D.find_leaks(frame(spark, texts).repartition(2), bench), *COLS) == want
    docs = frame(spark, [items[3][1], items[3][1], items[3][1], "clean", None], ids=[None, 7, 7, 7, None])
    got = [(r.doc_id, r.contaminated) for r in D.find_leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(None, True), (7, True), (7, True), (7, False), (None, False)], key=str)
    assert sorted((r.doc_id is None, r.text is None) for r in D.remove_leaks(docs, bench).collect()) == [(False, False), (True, True)]


def test_the_benchmark_does_not_pass_through_the_driver():
    import inspect
    source = inspect.getsource(D)
    assert "toLocalIterator" not in source and ".collect()" not in source and "F.broadcast" not in source


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    t, out = text or "", []
    # letters of the key words in either case: A-Z and a-z only
    for m in re.compile(ASSIGN.pattern, re.ASCII).finditer(t):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(out)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["password=", "PassWd : ", "api_key=\"", "apikey='", "secret:", "token = ", "AKIA", "AKIAAKIA", "é日😀", " ", "\n", "ſecret=abcdefgh1",
            "abcdefgh12", "0123456789abcdef" * 2, "0123456789abcdef", "ABCDEFGHIJKLMNOP", "....----====", "x"]
    texts = awkward(rng) + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("text").limit(300).collect()]
    docs = frame(spark, texts).repartition(2)
    for r in X.find_secrets(docs).collect():
        base = brute_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        names = [f"{X.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r.spans.split(",")) | {""}
        assert r.spans == ",".join(f"{f.kind}:{f.start}:{f.end}" for f in r.found)
        assert all(f.kind != "random" or f.end - f.start >= X.MIN_RUN for f in r.found)
    assert X.find_secrets(docs.where("false")).count() == 0


def test_battery_finds_random_strings_and_leaves_words(spark):
    rng = random.Random(7)
    alpha = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alpha) for _ in range(40)) for _ in range(60)]
    wordy = ["internationalisationandlocalisation", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the_quick_brown_fox_jumps_over_the_lazy_dog",
             "ABABABABABABABABABABABABABABAB", "A1b2" * 20, "CamelCaseClassNameFactoryBuilderImpl"]
    texts = [f"here {k} there" for k in keys] + [f"see {w} there" for w in wordy * 60]
    got = {r.doc_id: r.spans for r in X.find_secrets(frame(spark, texts)).collect()}
    hit = sum("random:5:45" in got[i] for i in range(len(keys)))
    assert hit >= 0.9 * len(keys)
    assert all(got[i] == "" for i in range(len(keys), len(texts)))
    assert X.battery(b"0123456789abcdef" * 4)[1] < X.REJECT and X.battery(b"a!")[0] is None


def test_redaction_keeps_rows_and_columns(spark):
    rng = random.Random(8)
    texts = awkward(rng) + ["é token=abcdef123456 end", "AKIA" + "A1" * 8, "x " + "0123456789abcdef" * 2 + " y"]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in X.redact(docs).collect()}
    n = len(texts)
    assert len(got) == n and X.redact(docs).columns == docs.columns and X.redact(docs).dtypes == docs.dtypes
    assert [got[n - 3].text, got[n - 2].text, got[n - 1].text] == ["é [SECRET] end", "[SECRET]", "x [SECRET] y"]
    assert got[n - 3].n_chars == len("é [SECRET] end")
    assert all(got[i].text == texts[i] for i in range(n - 3) if not brute_base(texts[i]))


def test_battery_discovers_keys_of_one_class_and_in_parts(spark):
    rng = random.Random(9)
    low, dec = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def key(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    texts = [f"here {key(low, 60)} there" for _ in range(30)] + [f"here {key(low.upper(), 60)} there" for _ in range(30)]
    texts += [f"here the_session_of_the_user_and_the_house_{key(low + dec, 40)} there" for _ in range(30)]
    spans = ["random:5:65"] * 60 + ["random:43:83"] * 30
    words = ["donaudampfschifffahrtsgesellschaft", "counterrevolutionaries", "0000001000000200000030000004", "2024011510300020240115103000", "INTERNATIONALISATION"]
    got = {r.doc_id: r.spans for r in X.find_secrets(frame(spark, texts + [f"see {w} there" for w in words * 20])).collect()}
    for lo in range(0, 90, 30):
        assert sum(spans[i] == got[i] for i in range(lo, lo + 30)) >= 27, (lo, [got[i] for i in range(lo, lo + 30)])
    assert all(got[i] == "" for i in range(90, len(got)))
    assert X.battery(b"31415926535897932384")[0] == "decimal" and X.battery(b"qwertzuiopasdfghjklyx")[0] == "lower"
