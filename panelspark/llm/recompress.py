"""Substring dedup by recompression.

A document is a sequence of whitespace words.  Every word covered by a window of ``window`` (50)
consecutive words whose sequence also starts in a document with a smaller id is removed; windows
are judged on the input.

Method.  Words are renamed in rounds: each round splits the alphabet into left and right symbols
by a coin drawn from the symbol's global name, and every adjacent (left, right) pair becomes one
new symbol named by the fingerprint of its two parts.  Names and coins depend on content only, so
no dictionary has to be exchanged: every task names equal pairs alike.  A round can treat at most
one symbol at either border of a repeat differently, so after three rounds (symbols of up to 8
words) the parse of two equal 50-word windows agrees from word 7 to word 43.  (Runs of one symbol
stay unit symbols: a repeat can lie inside a longer run, and naming whole runs would break this
bound.)  Among the high-level symbols that begin in words 7 to 34 of a window, the one of least
hash is the window's anchor; equal windows have the same anchor at the same place, so

1. one row per anchor, with the fingerprint of the 16 words there, shows which anchors occur in
   two documents (a count per key, partial on the map side);
2. only windows of shared anchors are written, with two fingerprints on word hashes of two families, and the least document
   id of each fingerprint is found;
3. windows with a smaller document are joined back per document, and the words they cover go.

No step gathers a group: hot passages meet in partial aggregates and in joins of stored tables
that adaptive execution can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm import arrays as A
from panelspark.llm.scratch import ready, stored

WINDOW = 50
ROUNDS = 3
_BORDER = 2 ** ROUNDS - 1                 # words at either end whose parse may depend on the outside
_LONGEST = 2 ** ROUNDS                    # words in a symbol
_NONE = np.uint64(2 ** 64 - 1)
_POS_BITS = np.uint64(31)
_COINS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1342543DE82EF95)


def parse(h: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High-level symbols of word hashes: (word index where each begins, its name)."""
    pos = np.arange(len(h))
    row = np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))
    sym = h
    for r in range(ROUNDS):
        if len(sym) < 2:
            break
        right = (A.mix(sym ^ np.uint64(_COINS[r])) >> np.uint64(63)).astype(bool)
        pair = ~right[:-1] & right[1:] & (row[pos[:-1]] == row[pos[1:]])
        at = np.flatnonzero(pair)
        sym = sym.copy()
        sym[at] = A.mix(sym[at] * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(r + 1)) + sym[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, pos = sym[keep], pos[keep]
    return pos, sym


def _sliding_min(v: np.ndarray, size: int) -> np.ndarray:
    width, m = 1, v
    while width * 2 <= size:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(v) - size + 1], m[size - width:][: len(v) - size + 1])


def anchors(h: np.ndarray, word_off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, word index of each window's anchor) over one block."""
    ok = A.window_mask(word_off, window)
    if not ok.any():
        z = np.zeros(0, np.int64)
        return z, z
    pos, sym = parse(h, word_off)
    rank = np.full(len(h), _NONE, np.uint64)
    rank[pos] = (A.mix(sym) >> _POS_BITS << _POS_BITS) | pos.astype(np.uint64)
    span = window - 2 * _BORDER - _LONGEST
    least = _sliding_min(rank, span)
    starts = np.flatnonzero(ok)
    at = (least[starts + _BORDER] & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
    return starts, at


#: Words in an anchor's key: from any anchor they still lie inside the window.
KEY_WORDS = _BORDER + _LONGEST + 1


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.concatenate([first[1:], [len(at)]])


def _text(batch: pa.RecordBatch):
    return A.text_buffers(batch.column(batch.schema.get_field_index("text")))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


_ANCHOR = "key long, doc_id long, uid long, first int, last int"


def _find_anchors(window: int):
    def run(batches):
        for batch in batches:
            data, off = _text(batch)
            ids, uid = _column(batch, "doc_id"), _column(batch, "uid")
            for a, b in A.blocks(off):
                s, e, wo = A.word_spans(data[off[a]:off[b]], off[a:b + 1] - off[a])
                h = A.word_hashes(data[off[a]:off[b]], s, e)
                starts, at = anchors(h, wo, window)
                if not len(at):
                    continue
                first, stop = _runs(at)
                row = np.searchsorted(wo, starts[first], side="right") - 1
                key = A.window_prints(h, KEY_WORDS)[at[first]]
                yield pa.RecordBatch.from_arrays(
                    [A.as_long(key), pa.array(ids[a:b][row]), pa.array(uid[a:b][row]),
                     pa.array((starts[first] - wo[row]).astype(np.int32)),
                     pa.array((starts[stop - 1] - wo[row]).astype(np.int32))],
                    ["key", "doc_id", "uid", "first", "last"])
    return run


def _windows_of(window: int):
    def run(batches):
        for batch in batches:
            data, off = _text(batch)
            ids, uid = _column(batch, "doc_id"), _column(batch, "uid")
            spans = batch.column(batch.schema.get_field_index("spans"))
            for i in range(batch.num_rows):
                s, e, _ = A.word_spans(data[off[i]:off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                h, g = A.word_hashes(data[off[i]:off[i + 1]], s, e, both=True)
                span = spans[i].values
                lo, hi = span.field(0).to_numpy(), span.field(1).to_numpy()
                starts = np.flatnonzero(A.covered(lo, hi - lo + 1, max(len(h) - window + 1, 0)))
                p, q = A.window_prints(h, window)[starts], A.window_prints(g, window, True)[starts]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [A.as_long(p), A.as_long(q), pa.array(np.full(n, ids[i])), pa.array(np.full(n, uid[i])),
                     pa.array(starts.astype(np.int32))], ["p", "q", "doc_id", "uid", "start"])
    return run


def _digest(batches):
    """Word count and hash of all words joined by one space, for every row."""
    for batch in batches:
        data, off = _text(batch)
        n_words, shas = np.zeros(batch.num_rows, np.int64), []
        for a, b in A.blocks(off):
            d, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
            _, _, wo = A.word_spans(d, o)
            n_words[a:b] = np.diff(wo)
            raw = d.tobytes()
            shas += [hashlib.sha256(b" ".join(raw[x:y].split())).hexdigest() for x, y in zip(o[:-1], o[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("uid")),
             batch.column(batch.schema.get_field_index("print")), pa.array(n_words), pa.array(shas, pa.string())],
            ["doc_id", "uid", "print", "n_words", "sha"])


def _cut(window: int):
    def run(batches):
        for batch in batches:
            data, off = _text(batch)
            raw, removed, shas, kept = data.tobytes(), [], [], []
            found = batch.column(batch.schema.get_field_index("starts"))
            for i in range(batch.num_rows):
                words = raw[off[i]:off[i + 1]].split()
                gone = A.covered(found[i].values.to_numpy().astype(np.int64), window, len(words))
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("uid")),
                 pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "uid", "n_removed", "sha", "kept_text"])
    return run


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of the row's content: equal (doc_id, text) rows share it and get one answer.

    Rows with a NULL doc_id share the key space through the text alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64("doc_id", text).alias("uid"))


_ROW = ["doc_id", "uid"]


def _repeats(rows: DataFrame, base: DataFrame, window: int) -> DataFrame:
    """(doc_id, uid, text, starts): texts with windows that start in a smaller document.

    Only the smallest document of equal texts is searched; its copies are settled by the caller."""
    text = rows.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * window - 1))
    found = stored(text.select("doc_id", "uid", "text").mapInArrow(_find_anchors(window), _ANCHOR), "anchors")
    both = stored(found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                  .where("lo < hi").select("key"), "shared-anchors")
    spans = (found.join(both, "key", "left_semi")
             .groupBy(_ROW).agg(F.collect_set(F.struct("first", "last")).alias("spans")))    # bounded by the text's own words
    first_of = base.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    near = stored(text.join(spans.join(first_of, "doc_id", "left_semi"), _ROW), "near")
    wins = stored(near.select("doc_id", "uid", "text", "spans").mapInArrow(
        _windows_of(window), "p long, q long, doc_id long, uid long, start int"), "windows")
    least = stored(wins.groupBy("p", "q").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                   .where("lo < hi").select("p", "q", "lo"), "least")
    hits = (wins.join(least, ["p", "q"]).where("lo < doc_id")
            .groupBy(_ROW).agg(F.collect_set("start").alias("starts")))       # bounded by the text's own words
    return near.select("doc_id", "uid", "text").join(hits, _ROW)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    ``kept_text`` is the text left (words joined by one space); it is NULL where nothing was
    removed, because the text is then unchanged, and for a removed copy of a whole text.

    Defined results: a NULL or empty text has no words (0, 0, hash of the empty string).  Texts
    shorter than the window lose nothing.  Repeated rows with one doc_id do not remove each
    other (no id is smaller).  A NULL doc_id is neither smaller nor larger: such rows lose
    nothing and remove nothing.  Other columns are ignored."""
    if window < 2 * _BORDER + _LONGEST + _LONGEST:
        raise ValueError(f"window must be at least {2 * _BORDER + 2 * _LONGEST} words")
    spark = docs.sparkSession
    ready(spark)
    rows = _identified(docs)
    base = stored(rows.withColumn("print", F.sha2("text", 256)).select("doc_id", "uid", "print", "text")
                  .mapInArrow(_digest, "doc_id long, uid long, print string, n_words long, sha string"), "words")
    cut = stored(_repeats(rows, base, window).select("doc_id", "uid", "text", "starts").mapInArrow(
        _cut(window), "doc_id long, uid long, n_removed long, sha string, kept_text string")
        .dropDuplicates(_ROW), "cut")                                         # repeated rows have one answer
    least = base.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    copies = stored(least.where("n > 1").select("print", "first_doc"), "copies")
    copy = F.col("first_doc").isNotNull() & (F.col("first_doc") < F.col("doc_id")) & (F.col("n_words") >= window)
    empty = hashlib.sha256(b"").hexdigest()
    return (base.join(copies, "print", "left").join(cut.withColumnRenamed("sha", "cut_sha"), _ROW, "left")
            .select("doc_id", "n_words",
                    F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
                    F.when(copy, F.lit(empty)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
                    F.when(~copy, F.col("kept_text")).alias("kept_text")))
