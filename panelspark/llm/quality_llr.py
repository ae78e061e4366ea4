"""Quality rules: surface rules, and a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of whitespace words (bigrams within a text) are hashed into ``BUCKETS``
buckets.  Two multinomials are estimated with add-one smoothing: the raw corpus from all documents,
and the trusted target from all documents labelled good.  A text's score is the
mean over its n-grams of ``ln(p_target / p_raw)``, so it does not depend on length.  Every
document is kept or dropped by one threshold on the score rounded to six decimals.

With a threshold of None the score and the cut do not hang on how many documents are labelled: p_target
is half the target's share and half p_raw (an n-gram that few good texts lack costs ln 2 at most), a
target document is scored without its own counts, so it stands like any other document, and the cut is
the one that best parts all labelled good rows, so scored, from all rows labelled 0 (``held_out_cut``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm import arrays as A
from panelspark.llm.scratch import ready, stored, task_input, task_output, task_rest, task_text

BUCKETS = 1 << 15
THRESHOLD = -0.08                # nats an n-gram, on average; labelled good texts score above, junk below
GOOD_LOST = 0.05                 # share of the labelled good rows that such a cut may lose
BACK_OFF = 0.5                   # share of p_raw in p_target, where the cut is drawn from labelled rows
CUT_BANDS = 1000                 # score bands of one nat; the driver holds a row for each band with a score
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def gram_buckets(h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of a block's unigrams and bigrams, rows' offsets): a row's unigrams, then its bigrams."""
    n = np.diff(wo)
    pairs = np.maximum(n - 1, 0)
    off = np.concatenate([[0], np.cumsum(n + pairs)])
    out = np.empty(int(off[-1]), np.int64)
    mask = np.uint64(BUCKETS - 1)
    uni = np.arange(len(h)) + np.repeat(off[:-1] - wo[:-1], n)
    out[uni] = (h & mask).astype(np.int64)
    ok = A.window_mask(wo, 2)
    bi = np.flatnonzero(ok)
    row = np.repeat(np.arange(len(n)), pairs)
    out[bi + (off[:-1] + n - wo[:-1])[row]] = (A.window_prints(h, 2)[bi] & mask).astype(np.int64)
    return out, off


def _count(batches):
    """Bucket counts of a task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, off = A.text_buffers(batch.column(0))
        for a, b in A.blocks(off):
            d, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
            s, e, wo = A.word_spans(d, o)
            total += np.bincount(gram_buckets(A.word_hashes(d, s, e), wo)[0], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])


def _repeats(h: np.ndarray, g: np.ndarray, wo: np.ndarray, size: int) -> np.ndarray:
    """Words covered by windows that occur twice or more in their row."""
    ok = np.flatnonzero(A.window_mask(wo, size))
    if not len(ok):
        return np.zeros(len(h), bool)
    row = np.searchsorted(wo, ok, side="right") - 1
    p = A.mix(A.window_prints(h, size)[ok] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    q = A.window_prints(g, size, True)[ok]
    order = np.argsort(p, kind="stable")
    like = (p[order][1:] == p[order][:-1]) & (q[order][1:] == q[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(ok), bool)
    twice[order[1:][like]] = True
    twice[order[:-1][like]] = True
    return A.covered(ok[twice], size, len(h))


def _lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def _weights(p_raw: np.ndarray, target: np.ndarray, total: float) -> np.ndarray:
    """ln(p_target / p_raw) where p_target backs off to p_raw."""
    return np.log((1 - BACK_OFF) * target / max(total, 1.0) / p_raw + BACK_OFF)


def _left_out(grams: np.ndarray, copies: int, p_raw: np.ndarray, target: np.ndarray) -> float:
    """A target document's score under the target without it (``copies`` rows of it were counted)."""
    at, inv, n = np.unique(grams, return_inverse=True, return_counts=True)
    w = _weights(p_raw[at], np.maximum(target[at] - copies * n, 0), target.sum() - copies * len(grams))
    return float((w * n).sum() / len(grams))


def _score(weights):
    """Scores by the broadcast weights; with (p_raw, target) broadcast, target documents are left out of theirs."""
    def run(batches):
        held = isinstance(weights.value, tuple)
        w = _weights(*weights.value, weights.value[1].sum()) if held else weights.value
        for batch in batches:
            data, off = A.text_buffers(task_text(batch))
            copies = batch.column(batch.schema.get_field_index("__copies")).to_numpy(zero_copy_only=False) if held else None
            cols = []
            for a, b in A.blocks(off):
                d, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
                s, e, wo = A.word_spans(d, o)
                h, g = A.word_hashes(d, s, e, both=True)
                n = np.diff(wo)
                points = (d & 0xC0) != 0x80
                chars = A.row_sums(points & ~A.SPACE[d], o)
                raw = d.tobytes()
                dup = np.array([_lines(raw[x:y]) for x, y in zip(o[:-1].tolist(), o[1:].tolist())], np.int64)
                grams, go = gram_buckets(h, wo)
                cum = np.concatenate([np.zeros(1), np.cumsum(w[grams])])
                count = np.diff(go)
                with np.errstate(invalid="ignore", divide="ignore"):
                    llr = (cum[go[1:]] - cum[go[:-1]]) / count
                if held:
                    for r in np.flatnonzero((copies[a:b] > 0) & (count > 0)):
                        llr[r] = _left_out(grams[go[r]:go[r + 1]], int(copies[a + r]), *weights.value)
                llr = np.round(llr, 6)
                cols.append((n, chars, A.row_sums(_SYMBOL[d], o), dup, A.row_sums(_repeats(h, g, wo, REPEAT_WINDOW), wo),
                             np.where(count > 0, llr, 0.0)))
            cols = [np.concatenate(x) for x in zip(*cols)] or [np.zeros(0, np.int64)] * 5 + [np.zeros(0)]
            rest, name = task_rest(batch)
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), rest],
                                             ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", name])
    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the target: all that are labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _counts(texts: DataFrame) -> np.ndarray:
    """Counts of every bucket over the column ``text``.

    Tasks add up their buckets, so at most BUCKETS rows a task are shuffled and BUCKETS reach the driver."""
    got = texts.select(F.coalesce("text", F.lit(""))).mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _labelled(docs: DataFrame, labels: DataFrame, carry: bool = False, junk: bool = True) -> tuple[DataFrame, DataFrame]:
    """(target ids ``__id``, stored labelled documents): the columns of ``task_input`` and ``__copies``, the rows of a
    target id in ``docs``, 0 for rows labelled 0.  This join alone moves the texts, and at any size in the same way: labels
    grow with the documents, so their ids are not sent whole to the tasks."""
    trusted = stored(trusted_ids(labels).withColumnRenamed("doc_id", "__id"), "trusted-ids")
    ids = docs.select(F.col("doc_id").cast("long").alias("__id"))
    marked = ids.join(trusted, "__id").groupBy("__id").agg(F.count(F.lit(1)).alias("__copies"))
    if junk:
        bad = labels.where("quality = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
        marked = marked.unionByName(bad.join(trusted, "__id", "left_anti").withColumn("__copies", F.lit(0).cast("long")))
    rows = docs.where("doc_id is not null").select(*task_input(docs, carry), F.col("doc_id").cast("long").alias("__id"))
    return trusted, stored(rows.join(stored(marked, "labelled-ids").hint("merge"), "__id").drop("__id"), "labelled", compression="zstd")


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """ln(p_target / p_raw) of every bucket, add-one; all zero when no labelled text is there."""
    raw, target = _counts(docs), _counts(_labelled(docs, labels, junk=False)[1])
    if not target.any():
        return np.zeros(BUCKETS)
    raw, target = raw + 1, target + 1
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def held_out_cut(good: np.ndarray, junk: np.ndarray) -> float:
    """The cut with the least sum of the share of good scores below it, GOOD_LOST at most, and of junk scores
    from it on (ties: the middle one), half-way to the next lower score.  Without junk no good score is cut off."""
    if not len(good) or not len(junk):
        return float(good.min()) if len(good) else 0.0
    at = np.unique(np.concatenate([good, junk]))
    lost = np.searchsorted(np.sort(good), at) / len(good)
    at, lost = at[lost <= GOOD_LOST], lost[lost <= GOOD_LOST]
    loss = lost + 1 - np.searchsorted(np.sort(junk), at) / len(junk)
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    i = int(best[len(best) // 2])
    return float(at[i] if i == 0 else (at[i] + at[i - 1]) / 2)


def cut_of(seen: DataFrame) -> float:
    """``held_out_cut`` of a table (good boolean, llr), with every row and in Spark: the distinct scores with their counts are
    summed up within bands of 1 / CUT_BANDS, and only the bands' totals come to the driver."""
    spark = seen.sparkSession
    scores = stored(seen.groupBy("llr").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("junk"))
                    .withColumn("band", F.floor(F.col("llr") * CUT_BANDS)), "scores")
    bands = scores.groupBy("band").agg(F.sum("good").alias("good"), F.sum("junk").alias("junk"), F.max("llr").alias("top"),
                                       F.min(F.when(F.col("good") > 0, F.col("llr"))).alias("first")).orderBy("band").collect()
    n_good, n_junk = sum(r["good"] for r in bands), sum(r["junk"] for r in bands)
    if not n_good or not n_junk:
        return min((r["first"] for r in bands if r["good"]), default=0.0)
    before, at, top = [], (0, 0), None
    for r in bands:
        before.append((r["band"], *at, top))
        at, top = (at[0] + r["good"], at[1] + r["junk"]), r["top"]
    starts = spark.createDataFrame(before, "band long, good_before long, junk_before long, top_before double")
    order = Window.partitionBy("band").orderBy("llr")
    inner = order.rowsBetween(Window.unboundedPreceding, -1)
    lost = (F.col("good_before") + F.coalesce(F.sum("good").over(inner), F.lit(0))) / F.lit(float(n_good))
    gone = (F.col("junk_before") + F.coalesce(F.sum("junk").over(inner), F.lit(0))) / F.lit(float(n_junk))
    cuts = stored(scores.join(F.broadcast(starts), "band")
                  .select("band", "llr", F.coalesce(F.lag("llr").over(order), "top_before").alias("lower"), lost.alias("lost"), gone.alias("gone"))
                  .where(F.col("lost") <= GOOD_LOST).select("band", "llr", "lower", (F.col("lost") + 1 - F.col("gone")).alias("loss")), "cuts")
    best = cuts.where(F.col("loss") <= cuts.agg(F.min("loss")).first()[0] + 1e-12)
    ties = best.groupBy("band").count().orderBy("band").collect()
    skip = sum(r["count"] for r in ties) // 2
    for r in ties:
        if skip < r["count"]:
            break
        skip -= r["count"]
    cut = best.where(F.col("band") == r["band"]).orderBy("llr").offset(skip).limit(1).first()
    return cut["llr"] if cut["lower"] is None else (cut["llr"] + cut["lower"]) / 2


_FAILED = "(n_words < 20 or 100 * n_repeat_words > 30 * n_words)"
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, "


def _held_out(docs: DataFrame, labels: DataFrame, carry: bool) -> tuple[DataFrame, float]:
    """(scored rows, cut) where target documents are scored without themselves."""
    spark = docs.sparkSession
    trusted, labelled = _labelled(docs, labels, carry)
    raw = _counts(docs) + 1
    target = _counts(labelled.where("__copies > 0").select("row.text" if carry else "text"))
    shared = spark.sparkContext.broadcast((raw / raw.sum(), target) if target.any() else np.zeros(BUCKETS))

    def scored(rows: DataFrame, out: str) -> DataFrame:
        return rows.mapInArrow(_score(shared), _COLUMNS + out)

    text = F.col("row.text" if carry else "text").alias("text")
    seen = scored(labelled.select(F.col("__copies").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), "__copies"), "doc_id long")
    cut = cut_of(seen.where(f"not {_FAILED}").select((F.col("doc_id") > 0).alias("good"), "llr"))
    # scores are small rows: those of target documents are taken out after scoring, and come from the labelled texts
    own = F.col("row.doc_id" if carry else "doc_id").cast("long")
    out = task_output(docs, carry)
    rest = scored(docs.select(*task_input(docs, carry), F.lit(0).cast("long").alias("__copies")), out).join(trusted, own == F.col("__id"), "left_anti")
    return rest.unionByName(scored(labelled.where("__copies > 0"), out)), cut


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = THRESHOLD, carry: bool = False) -> DataFrame:
    """doc_id (or with ``carry`` the whole row as struct ``row``), n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, llr of every row.

    A number as ``threshold`` cuts the plain add-one score; None draws the cut from the labelled rows,
    and reads ``docs`` four times.  Defined results: a NULL or empty text has no words, scores 0 and fails the base rules;
    without labels every score is 0 and, unless the number says otherwise, only the base rules count; repeated rows get
    equal answers; a document labelled twice counts once in the target, one labelled both good and 0 is good."""
    if threshold is not None and not math.isfinite(threshold):
        raise ValueError("the threshold must be a number")
    spark = docs.sparkSession
    ready(spark)
    if threshold is None:
        out, threshold = _held_out(docs, labels, carry)
    else:
        weights = spark.sparkContext.broadcast(fit(docs, labels))        # BUCKETS numbers
        out = docs.select(*task_input(docs, carry)).mapInArrow(_score(weights), _COLUMNS + task_output(docs, carry))
    return out.select("row" if carry else "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(_FAILED).alias("base_failed"),
                      (~F.expr(_FAILED) & (F.col("llr") >= threshold)).alias("kept"), "llr")
