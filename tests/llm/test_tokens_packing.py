import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelspark.llm import bpe, packing, token_prefix as T
from panelspark.llm.queries import TOKENIZER
from tests.conftest import SMALL
from tests.llm.helpers import awkward, frame

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def fuzz(rng, n):
    alphabet = list("ab  '\n\t1.,éßñ sretl") + ["<|endoftext|>", " ", " ", "\U0001e6c0", "日本", "😀", "  ", "'re", "\x1c", "́", "꟎"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_split_rule_agrees_with_the_library_below_its_bound(library):
    f = bpe.load(PATH)
    for c in range(ord(bpe._PLAIN)):
        s = f"a{chr(c)}a1{chr(c)}1 {chr(c)}  {chr(c)}."
        assert f.findall(s) == [s[x:y] for _, (x, y) in library.pre_tokenizer.pre_tokenize_str(s)], hex(c)


def test_counts_and_ids_equal_the_library(spark, library):
    texts = awkward(random.Random(2)) + fuzz(random.Random(3), 1500)
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    docs = frame(spark, texts).repartition(3)
    want = {i: len(ids_of(library, t)) for i, t in enumerate(texts)}
    got = T.count_tokens(docs, PATH, limit=30).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (want[r.doc_id] > 30) for r in got)
    ids = packing.Ids(PATH)
    for t in texts:
        assert np.frombuffer(ids.whole(t or ""), ids.type).tolist() == ids_of(library, t)


def test_prefix_counts_inside_pieces(library):
    p, rng = T.prefixes(PATH), random.Random(4)
    for text in ["a" * 700, "é" * 300, "=-" * 200, "ThhaStanD" * 40, " internationalisation", "\n" * 90]:
        for piece in p.bpe.pieces(text)[:3]:
            counts = p.counter.counts(piece.encode())
            assert counts[-1] == p.counter.total(piece.encode())
            for j in rng.sample(range(1, len(piece) + 1), min(len(piece), 10)):
                assert counts[len(piece[:j].encode())] == len(ids_of(library, piece[:j])), (piece[:9], j)


def test_budget_cut(spark, library):
    texts = [t for t in awkward(random.Random(5)) if t and "<|" not in t and len(t) < 3000]
    rows = T.prefix_table(frame(spark, texts), PATH, budget=17).collect()
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.piece_end or [0])[-1] == len(raw) and r.tokens_to[-1] == len(ids_of(library, texts[r.doc_id]))
        assert r.cut_tokens <= 17
        raw[:r.cut_bytes].decode()
        if r.cut_bytes < len(raw):
            assert r.cut_tokens >= 14                       # the next character would pass the budget
    empty = T.prefix_table(frame(spark, [None, ""]), PATH).collect()
    assert all(r.piece_end == [] and r.cut_bytes == 0 for r in empty)


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_is_an_exact_round_trip(spark, library, parts):
    texts = awkward(random.Random(6)) + fuzz(random.Random(7), 40)
    docs = frame(spark, texts).repartition(parts)
    got = packing.pack(docs, PATH, length=64).collect()
    want = {i: ids_of(library, t) + [packing.END_ID] for i, t in enumerate(texts)}
    at, seqs = defaultdict(int), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length >= 1 and r.doc_tokens == len(want[r.doc_id])
        piece = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        at[r.doc_id] += r.length
        assert r.continues == (at[r.doc_id] < r.doc_tokens)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert dict(at) == {i: len(x) for i, x in want.items()}
    assert sorted(seqs) == list(range(len(seqs)))
    for s, pieces in seqs.items():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end == 64 or s == len(seqs) - 1
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_repeated_and_null_ids(spark):
    docs = frame(spark, ["a b", "a b", None], ids=[1, 1, None])
    got = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got) and len(got) == 3
    assert T.count_tokens(docs, PATH).count() == 3


def test_stored_prefix_counts(spark, library):
    """Every stored count against the library's encoding of the piece's prefix, and the answers read from the table."""
    rng = random.Random(12)
    texts = ["", None, "a" * 300, "don't stop  now", "é日本 語 <|endoftext|> x<|endoftext|>", "internationalisation of " * 5] + fuzz(rng, 150)
    work = T.Prefixes(PATH)
    for t in texts:
        if not t:
            continue
        want, n = [], 0
        parts = t.split(work.bpe.special[0])
        for i, part in enumerate(parts):
            if i:
                s = work.bpe.special[0]
                want += [n + sum(len(ids_of(library, p)) for p in work.bpe.pieces(s[:j])) for j in range(1, len(s))] + [n + 1]
                n += 1
            for piece in work.bpe.pieces(part) if part else []:
                want += [n + len(ids_of(library, piece[:j])) for j in range(1, len(piece) + 1)]
                n = want[-1]
        assert T.counts_of(work.row(t)).tolist() == want, t
        assert len(want) == len(t) and want[-1] == len(ids_of(library, t))
    docs = frame(spark, texts)
    table = T.prefix_counts(docs, PATH)
    for limit in (0, 3, 10 ** 6):
        for r in T.budgets(table, limit).collect():
            t = texts[r.doc_id] or ""
            c = T.counts_of(work.row(t)).tolist() if t else []
            assert r.n_tokens == len(ids_of(library, t)) and r.over_limit == (r.n_tokens > limit)
            assert r.fits_chars == max([i + 1 for i, x in enumerate(c) if x <= limit], default=0)


def test_wide_differences(monkeypatch):
    work = T.Prefixes(PATH)
    text = "some words <|endoftext|> and " + "x" * 90
    narrow = T.counts_of(work.row(text)).tolist()
    monkeypatch.setattr(work._rows, "whole", lambda t: (_ for _ in ()).throw(T._Wide()))
    wide = work.row(text)
    assert wide[0] == 4 and T.counts_of(wide).tolist() == narrow
    with pytest.raises(T._Wide):
        T._steps([0, 200])


def test_prefix_counts_look_only_at_tokens_that_end_there():
    """The automaton lists just the vocabulary's tokens at a place, longest first, and a long piece takes linear work."""
    tokenizer = bpe.load(PATH)
    counter = bpe.PrefixCounter(tokenizer)
    for piece in (b" therewithal", "é日本".encode(), b"=" * 300, b" x"):
        assert counter.counts(piece) == [0] + [counter._last(piece, i, {})[1] for i in range(1, len(piece) + 1)]
        node = 0
        for i, byte in enumerate(piece, 1):
            node = counter._suffixes.move(node, byte)
            want = [tokenizer.ids[piece[j:i]] for j in range(i) if piece[j:i] in tokenizer.ids]
            assert [t for t, _ in counter._suffixes.ends[node]] == want


def test_packing_keeps_a_small_cache(library):
    """A worker holds the cache while other stages run, so packing's is smaller than the counters'; ids do not depend on it."""
    work = packing.Ids(PATH)
    text = " ".join(f"w{i}q" for i in range(3 * packing.CACHE))
    got = np.frombuffer(work.whole("x " + text), work.type)
    assert len(work._work.cache) + len(work._work.cache.older) <= 2 * packing.CACHE < bpe.SEGMENT_CACHE
    assert got.tolist() == library.encode("x " + text, add_special_tokens=False).ids
