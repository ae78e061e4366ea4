"""Language identification by prediction by partial matching (PPM).

For every language a variable-order byte context tree (orders 0 to 3) is counted on a bounded
sample of labelled texts and then frozen.  A byte seen c times in a context that was followed by n
bytes of d kinds costs ``-log2(c / (n + d))`` bits; a byte not seen there costs the escape
``-log2(d / (n + d))`` and is coded in the next shorter context, down to the uniform order -1
(8 bits).  A context never seen costs nothing and passes on.  The code length of a text is the
sum over all its bytes (no exclusion, context reset at the text's start), and the language of the
shortest code wins.  ASCII capitals are folded; nothing else of a row but its text is read.

The counts of all languages are merged into one table per order, so a text is scored for all
languages with one lookup per byte; only bytes whose four-byte string no language has seen go to
the lower orders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm import arrays as A
from panelspark.llm.scratch import ready, task_input, task_output, task_rest, task_text

ORDER = 3
SAMPLE_ROWS = 4096               # labelled rows in the sample, shared evenly by the languages
SAMPLE_BYTES = 1 << 18           # text of each language in the sample, in whole rows
UNKNOWN = "und"
MAX_BITS = 8.0                   # bits a byte from which no learned language explains a text better than its raw bytes
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"


def _grams(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the k-byte strings that end at each byte, and where they lie in one row."""
    low = A.LOWER[data]
    key = np.zeros(len(low), np.uint32)
    for i in range(k):
        part = low[: len(low) - i].astype(np.uint32)
        part <<= np.uint32(8 * i)
        key[i:] |= part
    place = np.arange(len(low)) - np.repeat(off[:-1], np.diff(off))
    return key, place >= k - 1


class _Table:
    """Open-addressing map from 32-bit keys to row numbers, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        size = 1 << self.bits
        self.key, self.row = np.zeros(size, np.uint32), np.full(size, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.row[slot] < 0
            place, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self.row[place], self.key[place] = won, keys[won]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is not in the table."""
        slot = self._slot(keys)
        out = self.row[slot]
        left = np.flatnonzero((self.key[slot] != keys) & (out >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            row = self.row[slot]
            out[left] = row
            wrong = (self.key[slot] != keys[left]) & (row >= 0)
            left, slot = left[wrong], slot[wrong]
        return out


class PpmModel:
    """Frozen statistics of all languages, ready to score byte arrays.

    ``counts``: arrays (lang index, order, gram key, count); a gram is the context and its byte."""

    def __init__(self, langs: list[str], lang: np.ndarray, order: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.langs, n = list(langs), len(langs)
        self.tables, self.costs, self.ctx, self.escapes = [], [], [], []
        lower = None                                   # cost of grams one order below, as a function of keys
        for k in range(ORDER + 1):
            at = order == k
            grams, g = np.unique(gram[at], return_inverse=True)
            c = np.zeros((len(grams), n))
            np.add.at(c, (g, lang[at]), count[at])
            ctxs, x = np.unique(grams >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(ctxs), n)), np.zeros((len(ctxs), n))
            np.add.at(total, x, c)
            np.add.at(kinds, x, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(c / (total[x] + kinds[x]))
            below = lower(grams & np.uint32((1 << (8 * k)) - 1)) if k else np.full((len(grams), n), 8.0)
            cost = np.where(c > 0, seen, escape[x] + below)
            self.tables.append(_Table(grams))
            self.costs.append(cost.astype(np.float32))
            self.ctx.append(_Table(ctxs))
            self.escapes.append(escape.astype(np.float32))
            lower = (lambda keys, k=k: self._cost(keys, k))

    def _cost(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits of each gram's last byte in every language, from order k down."""
        if k < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        row = self.tables[k].find(keys)
        out = self.costs[k][row] if len(self.costs[k]) else np.zeros((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            left = keys[miss]
            rest = self._cost(left & np.uint32((1 << (8 * k)) - 1) if k else left, k - 1)
            at = self.ctx[k].find(left >> np.uint32(8))
            known = at >= 0
            rest[known] += self.escapes[k][at[known]]
            out[miss] = rest
        return out

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each row in each language."""
        n, total = len(self.langs), np.zeros((len(off) - 1, len(self.langs)))
        step = max(4096, (1 << 20) // n)               # bytes whose costs are held at a time, for all languages
        for a, b in A.blocks(off, step):
            d, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
            for lo in range(0, len(d), 4 * step):      # a very long row goes through in parts
                hi, from_ = min(len(d), lo + 4 * step), max(0, lo - ORDER)
                part, po = d[from_:hi], np.clip(o, from_, hi) - from_
                po[0] = 0
                inside = np.clip(o, lo, hi) - lo
                place = np.arange(lo, hi) - np.repeat(o[:-1], np.diff(np.clip(o, lo, hi)))
                key, _ = _grams(part, po, ORDER + 1)
                key = key[lo - from_:]
                cost = np.empty((hi - lo, n), np.float32)
                full = place >= ORDER
                cost[full] = self._cost(key[full], ORDER)
                for k in range(ORDER):                 # the first bytes of a text have shorter contexts
                    at = np.flatnonzero(place == k)
                    cost[at] = self._cost(key[at] & np.uint32((1 << (8 * (k + 1))) - 1), k)
                cum = np.zeros((hi - lo + 1, n))
                np.cumsum(cost, axis=0, out=cum[1:], dtype=np.float64)
                total[a:b] += cum[inside[1:]] - cum[inside[:-1]]
        return total


def _count_grams(batches):
    """Gram counts of the sample: one row for each language, order and gram of a batch."""
    for batch in batches:
        data, off = A.text_buffers(batch.column(0))
        lang = batch.column(1).to_numpy(zero_copy_only=False)
        rows = np.repeat(lang, np.diff(off))
        for k in range(ORDER + 1):
            key, ok = _grams(data, off, k + 1)
            full, count = np.unique((rows[ok].astype(np.uint64) << np.uint64(32)) | key[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((full >> np.uint64(32)).astype(np.int32)), pa.array(np.full(len(full), k, np.int32)),
                 pa.array((full & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(count.astype(np.int64))],
                ["lang_no", "k", "gram", "n"])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> PpmModel | None:
    """Count the context trees on a bounded sample of (doc_id, text, lang) rows with a language.

    The sample takes, for each language, the rows of least hash of their id until ``sample_bytes``
    of text or the language's even share of ``sample_rows`` is reached (its first row always
    counts).  Rows of all languages are compared by their expected rank in their language (hash times
    the language's row count), so one top-k over the table finds them and no language is sorted in
    one task.  At most 2 * sample_rows ids, and counts bounded by sample_bytes a language, reach the
    driver, whatever the table's size.  No labelled row: None."""
    rows = labelled.where("lang is not null and text is not null and text <> ''")
    ids = rows.groupBy("lang", "doc_id").agg(F.min(F.octet_length("text")).alias("size"))      # an id given often counts once
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n_lang")).orderBy(F.desc("n_lang"), "lang").limit(sample_rows).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return None
    spark = labelled.sparkSession
    share = max(1, sample_rows // len(langs))
    counted = F.broadcast(spark.createDataFrame(sizes, "lang string, n_lang long"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = (ids.join(counted, "lang")
              .select("lang", "doc_id", "size", (h * F.col("n_lang")).alias("rank"))
              .orderBy("rank", "lang", "doc_id").limit(2 * sample_rows).collect())
    chosen, used = set(), {}
    for r in picked:
        n, size = used.get(r["lang"], (0, 0))
        if not n or n < share and size + r["size"] <= sample_bytes:
            used[r["lang"]] = (n + 1, size + r["size"])
            chosen.add((r["lang"], r["doc_id"]))
    keep = spark.createDataFrame([(x, i, langs.index(x)) for x, i in sorted(chosen, key=str)], "lang string, doc_id long, lang_no int")
    text = (rows.alias("r").join(F.broadcast(keep).alias("s"), F.expr("r.lang = s.lang and r.doc_id <=> s.doc_id"))
            .groupBy("s.lang_no", "r.doc_id").agg(F.min("r.text").alias("text")).select("text", "lang_no")
            .coalesce(max(1, len(langs) // 8)))        # a task counts the sample of eight languages: at most 8 * sample_bytes
    got = (text.mapInArrow(_count_grams, "lang_no int, k int, gram long, n long")
           .groupBy("lang_no", "k", "gram").agg(F.sum("n").alias("n")).toArrow())
    lang, k, gram, n = (got.column(i).to_numpy() for i in range(4))
    return PpmModel(langs, lang, k, gram.astype(np.uint32), n)


def _predict(model):
    def run(batches):
        m: PpmModel = model.value
        names = np.array(m.langs, dtype=object)
        for batch in batches:
            data, off = A.text_buffers(task_text(batch))
            bits = m.bits(data, off)
            size = np.maximum(np.diff(off), 1)
            best = bits.argmin(axis=1)                              # ties: first in alphabetical order
            least = bits[np.arange(len(bits)), best]
            with np.errstate(over="ignore"):
                score = 1.0 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
            rest, name = task_rest(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[best], pa.string()), pa.array(score), pa.array(least / size), batch.column(batch.num_columns - 1), rest],
                ["lang_best", "score", "bits_per_byte", "has", name])
    return run


def identify(docs: DataFrame, model: PpmModel | None, carry: bool = False) -> DataFrame:
    """doc_id (or with ``carry`` the whole row as struct ``row``), lang_pred, score, bits_per_byte.

    ``score`` is the posterior of the best language under equal priors, 2^-bits normalised.
    Defined results: a NULL text or one without a letter is ``und`` with score 0 and NULL
    bits_per_byte, as is every text when nothing could be learned; repeated rows get equal answers;
    texts of any length are scored whole, in parts of bounded memory."""
    ready(docs.sparkSession)
    own = "row" if carry else "doc_id"
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has")
    rows = docs.select(*task_input(docs, carry), has)
    if model is None:
        return rows.select(own, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast(model)        # bounded by the sample
    out = rows.mapInArrow(_predict(shared), f"lang_best string, score double, bits_per_byte double, has boolean, {task_output(docs, carry)}")
    return out.select(own, F.when(F.col("has"), F.col("lang_best")).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(F.col("has"), F.col("score")).otherwise(0.0).alias("score"),
                      F.when(F.col("has"), F.col("bits_per_byte")).alias("bits_per_byte"))


def accept(docs: DataFrame, model: PpmModel | None, max_bits: float = MAX_BITS) -> DataFrame:
    """The rows whose text a learned language explains: not ``und``, and coded in fewer than
    ``max_bits`` bits a byte (its raw bytes take 8).  Without a model every row stays."""
    if model is None:
        return docs
    found = identify(docs, model, carry=True)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < max_bits)).select("row.*")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: labelled, and not in the held-out quarter."""
    return docs.where(f"lang is not null and not coalesce({HELD_OUT}, false)").select("doc_id", "text", "lang")
