"""Bucketed rank / prefix sum: exact ranks and running sums without a one-task window.

A window partitioned by a low-cardinality key (or by a hot subject) sends that key's rows
to one task.  The pattern here:

1. ``bucket`` is a pure function of the row (an integer range of the order column, or leading
   hex digits of a hash), so it can be recomputed anywhere;
2. rows are counted per (key, bucket) -> a small table whose running sum over buckets gives
   each bucket's offset (a window over the small table only);
3. the exact rank is offset + row_number inside (key, bucket), which splits a hot key over
   all of its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.operators.small import bounded
from panelspark.session import stored


def bucket_borders(keyed: DataFrame, key: str, order: list[str], rows: int) -> DataFrame | None:
    """(key, _borders): for each key of more than ``rows`` rows, sorted values of ``order`` that cut it into pieces
    of about ``rows`` rows (at most 1,024 pieces a key); None without such keys.

    The borders are every 32nd row of a sample by content hash whose rate follows from the key's counted rows."""
    hot = stored(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows), "hot-buckets")
    if hot.isEmpty():
        return None
    every = F.greatest(F.ceil(F.col("_n") / (32 * 1024)), F.lit(max(rows // 32, 1))).cast("long")
    at = F.struct(*[F.col(c) for c in order])
    sample = (keyed.join(F.broadcast(hot) if hot.count() <= 100000 else hot, key)
              .where(F.pmod(F.xxhash64(*order), every) == 0).groupBy(key).agg(F.array_sort(F.collect_set(at)).alias("_s")))
    return stored(sample.select(key, F.filter("_s", lambda x, i: i % 32 == 16).alias("_borders")), "borders")


def positions(df: DataFrame, part: list[str], order: str, ties: list[str], bucket: Column,
              carry: list[str] = (), name: str = "position", bucket_rows: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of the row within ``part`` ordered by (order, *ties),
    and ``prev_<c>`` = value of ``c`` on the previous row, for each ``c`` in ``carry``.

    ``bucket`` must be monotone in the order column (e.g. ``floor(visit / 1024)``); its width does
    not change the result.  With ``bucket_rows``, a bucket of more rows is cut further, at borders over (order,
    *ties) that are drawn from its rows, so that a part whose rows all share one order value is split too; this
    costs one count of the rows.  NULLs are values like any other: NULL parts form one part, NULL
    orders come first, and a previous row's NULL is carried as NULL.
    """
    key = "_key"                      # a struct is never NULL, so NULL parts and buckets join too
    coarse = df.withColumn(key, F.struct(*[F.col(c) for c in part], bucket.alias("_bucket")))
    borders = bucket_borders(coarse, key, [order, *ties], bucket_rows) if bucket_rows else None
    piece = F.lit(0)
    if borders is not None:           # at most one border for ``bucket_rows`` rows
        coarse = coarse.join(bounded(borders), key, "left")
        at = F.struct(F.col(order), *[F.col(t) for t in ties])
        piece = F.coalesce(F.size(F.filter("_borders", lambda b: b <= at)), F.lit(0))
        piece = F.when(F.col("_borders").isNotNull(), piece).otherwise(F.lit(0))
    fields = [F.col(f"{key}.{c}").alias(c) for c in part]
    keyed = coarse.withColumn(key, F.struct(*fields, F.struct(F.col(f"{key}._bucket").alias("b"), piece.alias("p")).alias("_bucket"))).drop("_borders")
    last_key = F.struct(F.col(order), *[F.col(t) for t in ties])
    aggs = [F.count(F.lit(1)).alias("_n")]
    if carry:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in carry]), last_key).alias("_last"))
    per_bucket = keyed.groupBy(key).agg(*aggs)
    w = Window.partitionBy(*[F.col(f"{key}.{c}") for c in part]).orderBy(f"{key}._bucket")
    cols = [key, (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_offset")]
    if carry:
        cols.append(F.lag("_last").over(w).alias("_prev_last"))
    offsets = per_bucket.select(*cols)
    joined = keyed.repartition(key).join(offsets.hint("merge"), key, "inner")
    inner = Window.partitionBy(key).orderBy(F.col(order), *[F.col(t) for t in ties])
    out = joined.withColumn("_r", F.row_number().over(inner))
    for c in carry:
        # the first row of a bucket follows the last row of the bucket before, whatever its value
        out = out.withColumn(f"prev_{c}", F.when(F.col("_r") == 1, F.col("_prev_last")[c]).otherwise(F.lag(c).over(inner)))
    return out.withColumn(name, (F.col("_offset") + F.col("_r")).cast("long")).drop(key, "_r", "_offset", "_prev_last")


def global_rank(df: DataFrame, orders: list[Column], name: str) -> DataFrame:
    """Add ``name`` = 1-based position of each row in the order of ``orders`` over the whole table.

    A window over everything would be one task.  Here the rows are dealt by ranges of the order and stored with
    their partition's number; the partitions' sizes (one row each) give its offset, and only a partition is
    ranked in one task.  The order must be total for the ranks to be unique."""
    pid = "_range"
    dealt = stored(df.repartitionByRange(*orders).withColumn(pid, F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in dealt.groupBy(pid).agg(F.count(F.lit(1)).alias("n")).orderBy(pid).collect():       # one row per partition
        offsets.append((r[pid], before))
        before += r["n"]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, f"{pid} int, _before long"))
    local = F.row_number().over(Window.partitionBy(pid).orderBy(*orders))
    return dealt.join(table, pid).withColumn(name, (F.col("_before") + local).cast("long")).drop(pid, "_before")


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """Integer bucket from the leading hex digits of a hex hash (monotone in the hash)."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def first_k_by_hash(df: DataFrame, key: str, h: str, quota: DataFrame, tie: str, digits: int = 4) -> DataFrame:
    """Flag (``_selected``) the first ``quota[k]`` rows of each key ``k`` in (h, tie) order.

    Only the one bucket per key in which the quota is crossed needs a local rank: buckets
    below it are wholly selected, buckets above it wholly not.  ``quota`` has columns
    (key, quota).  The threshold table has one row per key; its join is broadcast only when it is
    checked to be small.
    """
    hb = hash_bucket(F.col(h), digits)
    keyed = df.withColumn("_hb", hb)
    counts = keyed.groupBy(key, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_hb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).join(quota, key, "inner")
    crossing = cum.where((F.col("_before") < F.col("quota")) & (F.col("_before") + F.col("_n") >= F.col("quota")))
    thr = crossing.select(key, F.col("_hb").alias("_cross"), (F.col("quota") - F.col("_before")).alias("_need"))
    j = keyed.join(bounded(thr), key, "left")
    cross = F.col("_cross")
    whole = j.where(cross.isNull() | (F.col("_hb") != cross)).withColumn(
        "_selected", F.coalesce(F.col("_hb") < cross, F.lit(False)))
    part = j.where(F.col("_hb") == cross)
    wl = Window.partitionBy(key, "_hb").orderBy(F.col(h), F.col(tie))
    part = part.withColumn("_selected", F.row_number().over(wl) <= F.col("_need"))
    return whole.unionByName(part).drop("_hb", "_cross", "_need")


BUCKET_ROWS = 65536              # distinct values a local ranking task should hold


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _c): rows per distinct value of each key, NULL values included, written once."""
    return stored(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), "value-counts")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact percentiles of ``value`` per ``keys`` (linear interpolation), one column ``q<i>`` per
    probability, with the interpolation of Spark's ``percentile``:
    ``(hi - pos) * v[lo] + (pos - lo) * v[hi]`` at ``pos = p * (n - 1)``.

    ``percentile`` keeps every distinct value of a group in one task; see ``quantiles_of_counts``.
    Keys with no non-NULL value get no row; a NULL key is a key."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, value, probs, bucket_rows)


def quantiles_of_counts(counted: DataFrame, keys: list[str], value: str, probs: list[float], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``exact_quantiles`` over a stored table of ``value_counts``.

    No task holds more than one value bucket of one key: the values are cut at approximate
    quantiles of the whole table (as many buckets as the counted rows ask for), running counts over the small
    bucket table locate the target ranks, and only buckets that hold a target rank are ranked."""
    v = F.col(value)
    vc = counted.where(v.isNotNull()).withColumn("_k", F.struct(*[F.col(k) for k in keys]))
    n_buckets = min(max(-(-vc.count() // bucket_rows), 1), 1024)
    cuts = []
    if n_buckets > 1:
        inner = [i / n_buckets for i in range(1, n_buckets)]
        cuts = sorted(set(vc.agg(F.percentile_approx(value, inner, 20 * n_buckets)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda b: b < v)) if cuts else F.lit(0)
    vb = vc.withColumn("_b", bucket)
    bt = vb.groupBy("_k", "_b").agg(F.sum("_c").alias("_bc"))
    wk = Window.partitionBy("_k")
    bt = bt.withColumn("_before", F.coalesce(F.sum("_bc").over(wk.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("_n", F.sum("_bc").over(wk))
    # target ranks (0-based) per key and probability
    targets = bt.select("_k", "_n").distinct().select(
        "_k", "_n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                                         for i, p in enumerate(probs)])).alias("_t"))
    pos = F.col("_t.p") * (F.col("_n") - 1).cast("double")
    targets = targets.select("_k", F.col("_t.i").alias("_i"), pos.alias("_pos"),
                             F.floor(pos).cast("long").alias("_lo"), F.ceil(pos).cast("long").alias("_hi"))
    ranks = targets.select("_k", F.explode(F.array("_lo", "_hi")).alias("_r")).distinct()
    # buckets that hold a target rank: at most 2 per probability and key
    need = ranks.join(bt, "_k").where(
        (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_bc"))).select("_k", "_b", "_before").distinct()
    local = vb.join(need, ["_k", "_b"])
    wb = Window.partitionBy("_k", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumn("_end", F.col("_before") + F.sum("_c").over(wb)).withColumn("_start", F.col("_end") - F.col("_c"))
    asked = ranks.join(need, "_k").where(F.col("_r") >= F.col("_before"))       # a rank meets the buckets at or below it
    at = asked.join(local.drop("_before"), ["_k", "_b"]).where((F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_end"))) \
        .select("_k", "_r", v.cast("double").alias("_v"))
    lo = at.select("_k", F.col("_r").alias("_lo"), F.col("_v").alias("_vlo"))
    hi = at.select("_k", F.col("_r").alias("_hi"), F.col("_v").alias("_vhi"))
    t = targets.join(lo, ["_k", "_lo"]).join(hi, ["_k", "_hi"])
    interp = F.when((F.col("_hi") == F.col("_lo")) | (F.col("_vhi") == F.col("_vlo")), F.col("_vlo")).otherwise(
        (F.col("_hi").cast("double") - F.col("_pos")) * F.col("_vlo")
        + (F.col("_pos") - F.col("_lo").cast("double")) * F.col("_vhi"))
    t = t.select("_k", "_i", interp.alias("_q"))
    q = t.groupBy("_k").agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probs))])
    return q.select("_k.*", *[f"q{i}" for i in range(len(probs))])
