"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` (10) consecutive words; a shorter item is
one window.  A window is contained in a document only if all its words are, so one prefix token is
necessary: the window's rarest word, where rarity is the count of the word's hash slot over all documents.  The
windows are a Spark table keyed by their prefix token, and the documents' words are joined to it:

- a document word is a candidate if its slot in a bitmap of fixed size is set: a prefix token together with its neighbour in
  the window.  Only candidates leave a task, each with the hashes of the ``window - 1`` words on either side;
- the join on the token fixes where the window would have to lie; the length bound drops windows that do not fit into the
  document there, the positional bound compares their first and last words at their places;
- what is left is verified word by word, over two hashes of different families.

Documents are never shuffled by this, no group is gathered, and neither the benchmark nor its windows pass through
the driver; what does is bounded: ``SLOTS`` counts and the set bits of the bitmap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm import arrays as A
from panelspark.llm.scratch import ready, stored

WINDOW = 10
SLOTS = 1 << 16                  # counters of hashed words: the order of rarity
BITS = 1 << 22                   # of the bitmap; more set bits mean more candidates, not other results

#: Word bytes after folding A-Z: digits, a-z, and all bytes of characters above U+007F.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x30:0x3A] = False
_SEPARATOR[0x61:0x7B] = False
_SEPARATOR[0x80:] = False


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word hashes of the second family, word offsets of the rows)."""
    low = A.LOWER[data]
    s, e, wo = A.word_spans(low, off, _SEPARATOR)
    return *A.word_hashes(low, s, e, both=True), wo


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _pair(first: np.ndarray, second: np.ndarray, kind: int) -> np.ndarray:
    """Bitmap place of a token and its neighbour (kind 1: the next word, 2: the one before, 0: none)."""
    return (A.mix(first * np.uint64(0x9E3779B97F4A7C15) + second + np.uint64(kind)) & np.uint64(BITS - 1)).astype(np.int64)


def _lists(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs [start, start + size) of x as lists of longs."""
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), A.as_long(x[at]))


def _windows(window: int):
    """Rows (item, size, h, g): every window of an item."""
    def run(batches):
        for batch in batches:
            data, off = A.text_buffers(batch.column(1))
            for a, b in A.blocks(off):
                h, g, wo = words_of(data[off[a]:off[b]], off[a:b + 1] - off[a])
                n = np.diff(wo)
                count = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
                item = np.repeat(np.arange(len(n)), count)
                start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + wo[:-1][item]
                size = np.minimum(n[item], window)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + item)), pa.array(size.astype(np.int32)), _lists(h, start, size), _lists(g, start, size)],
                                                 ["item", "size", "h", "g"])
    return run


def _rarity(batches):
    """Words on each slot over the rows of a task."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        data, off = A.text_buffers(batch.column(0))
        for a, b in A.blocks(off):
            total += np.bincount(_slot(words_of(data[off[a]:off[b]], off[a:b + 1] - off[a])[0]), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])


def _prefix(counts):
    """Rows (token, at, size, bit, h, g): each window under its rarest word (ties: the first)."""
    def run(batches):
        n = counts.value
        for batch in batches:
            size = batch.column(0).to_numpy()
            off = np.concatenate([[0], np.cumsum(size)])
            h = batch.column(1).flatten().to_numpy().view(np.uint64)
            if not len(size):
                continue
            rank = n[_slot(h)]
            least = np.repeat(np.minimum.reduceat(rank, off[:-1]), size)
            place = np.arange(len(h)) - np.repeat(off[:-1], size)
            at = np.minimum.reduceat(np.where(rank == least, place, 1 << 30), off[:-1])
            token = h[off[:-1] + at]
            after, before = at + 1 < size, at + 1 == size
            bit = np.where(size == 1, _pair(token, np.zeros(len(token), np.uint64), 0),
                           np.where(after, _pair(token, h[np.minimum(off[:-1] + at + 1, len(h) - 1)], 1), _pair(token, h[np.maximum(off[:-1] + at - before, 0)], 2)))
            yield pa.RecordBatch.from_arrays([A.as_long(token), pa.array(at.astype(np.int32)), batch.column(0), pa.array(bit.astype(np.int32)), batch.column(1), batch.column(2)],
                                             ["token", "at", "size", "bit", "h", "g"])
    return run


_CANDIDATE = "array<struct<token: bigint, pos: bigint, left: int, h: array<bigint>, g: array<bigint>>>"


def _scan(bitmap, window: int):
    """Per row: word count and its candidate words with their surroundings."""
    def run(batches):
        marks = bitmap.value
        for batch in batches:
            data, off = A.text_buffers(batch.column(2))
            for a, b in A.blocks(off):
                h, g, wo = words_of(data[off[a]:off[b]], off[a:b + 1] - off[a])
                n = len(h)
                row = np.repeat(np.arange(b - a), np.diff(wo))
                hit = np.zeros(n, bool)
                if n:
                    none = np.zeros(n, np.uint64)
                    hit = marks[_pair(h, none, 0)]
                    same = row[1:] == row[:-1]
                    hit[:-1] |= marks[_pair(h[:-1], h[1:], 1)] & same
                    hit[1:] |= marks[_pair(h[1:], h[:-1], 2)] & same
                at = np.flatnonzero(hit)
                lo = np.maximum(at - window + 1, wo[row[at]])
                size = np.minimum(at + window, wo[row[at] + 1]) - lo
                found = pa.StructArray.from_arrays([A.as_long(h[at]), pa.array(at - wo[row[at]]), pa.array((at - lo).astype(np.int32)), _lists(h, lo, size), _lists(g, lo, size)],
                                                   ["token", "pos", "left", "h", "g"])
                ends = np.searchsorted(row[at], np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(wo)),
                                                  pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found)], ["doc_id", "uid", "n_words", "found"])
    return run


def _key(doc_id: str = "doc_id", uid: str = "uid"):
    return F.struct(F.col(doc_id).alias("d"), F.col(uid).alias("u"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, uid of every row.

    Defined results: a NULL or empty text has no words and is clean, and so is every document when
    the benchmark is empty; items with NULL text, NULL id or no word are no queries; items with one
    id count once; repeated rows get equal answers.  ``uid`` names the row's id and text.  Other columns are ignored."""
    spark = docs.sparkSession
    ready(spark)
    items = benchmark.where("item_id is not null and text is not null and text <> ''").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    windows = stored(items.mapInArrow(_windows(window), "item string, size int, h array<long>, g array<long>"), "windows")
    text = F.coalesce("text", F.lit("")).alias("__text")
    seen = docs.select(text).mapInArrow(_rarity, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()      # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    counts[seen.column(0).to_numpy()] = seen.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    prefix = stored(windows.dropDuplicates(["size", "h", "g"]).select("size", "h", "g")
                    .mapInArrow(_prefix(shared), "token long, at int, size int, bit int, h array<long>, g array<long>"), "prefix-tokens")
    bits = prefix.select("bit").distinct().toArrow()                                       # BITS rows at most
    marks = np.zeros(BITS, bool)
    marks[bits.column(0).to_numpy()] = True
    bitmap = spark.sparkContext.broadcast(marks)                                           # BITS bytes
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), text)
    did = docs.schema["doc_id"].dataType.simpleString()
    scanned = stored(rows.mapInArrow(_scan(bitmap, window), f"doc_id {did}, uid long, n_words long, found {_CANDIDATE}"), "candidates")

    c = scanned.select("doc_id", "uid", F.inline("found")).withColumnsRenamed({"h": "ch", "g": "cg"})
    j = c.join(prefix.drop("bit"), "token")
    start = F.col("left") - F.col("at")                                                    # of the window in the candidate's surroundings
    fits = (start >= 0) & (start + F.col("size") <= F.size("ch"))                          # length bound: clipped at the text's ends
    ends = (F.get("ch", start) == F.get("h", F.lit(0))) & (F.get("ch", start + F.col("size") - 1) == F.get("h", F.col("size") - 1))   # positional bound
    near = j.where(fits).where(ends)
    whole = (F.slice("ch", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("h")) & (F.slice("cg", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("g"))
    hits = stored(near.where(whole).select("doc_id", "uid", (F.col("pos") - F.col("at")).alias("begin"), "size", "h", "g").distinct(), "hits")

    spans = F.array_sort(F.collect_set(F.struct("begin", "size")))                          # bounded by the text's own words
    add = lambda acc, s: F.struct((acc["n"] + F.greatest(s["begin"] + s["size"] - F.greatest(acc["end"], s["begin"]), F.lit(0))).alias("n"),
                                  F.greatest(acc["end"], s["begin"] + s["size"]).alias("end"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = hits.groupBy("doc_id", "uid").agg(spans.alias("s")).select(_key().alias("key"), F.aggregate("s", zero, add)["n"].alias("n_hit"))
    named = hits.select("doc_id", "uid", "size", "h", "g").distinct().join(windows, ["size", "h", "g"])
    listed = named.select("doc_id", "uid", "item").distinct().groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    leaks = stored(covered.join(listed.select(_key().alias("key"), "items"), "key"), "leaks")
    none = F.array().cast("array<string>")
    out = scanned.select("doc_id", "uid", "n_words", _key().alias("key")).join(leaks, "key", "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", none)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
                      F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), found.alias("items"), "uid")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a window of an item, with all their columns."""
    bad = stored(find_leaks(docs, benchmark, window).where("contaminated").select(_key().alias("__key")).distinct(), "contaminated")
    return (docs.withColumn("__key", F.struct(F.col("doc_id").alias("d"), F.xxhash64("doc_id", "text").alias("u")))
            .join(bad, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]))
