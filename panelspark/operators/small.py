"""Joins with tables of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.session import stored


def bounded(df: DataFrame, max_rows: int = 100000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    The check is ``limit(max_rows + 1).collect()``: at most max_rows + 1 rows ever reach the
    driver.  The join stays the same; above the bound the planner chooses its strategy."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def local_or_stored(df: DataFrame, name: str, max_rows: int = 100000) -> DataFrame:
    """``df``, evaluated once: as a broadcast local table if it has at most ``max_rows`` rows (which are all that
    reaches the driver), else stored."""
    kept = df.limit(max_rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(kept, df.schema)) if len(kept) <= max_rows else stored(df, name)


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``per_key``, an aggregate with one row per ``key``, so that a hot key can be split.

    Adaptive execution splits a skewed partition only if both sides of the join come straight from
    an exchange.  An aggregate on the join key would reuse its own partitioning and sit between;
    joining on the key wrapped in a struct gives both sides an exchange of their own.  NULL keys
    match NULL keys."""
    wrapped = "_join_key"
    left = rows.withColumn(wrapped, F.struct(F.col(key).alias("k")))
    right = per_key.withColumn(wrapped, F.struct(F.col(key).alias("k"))).drop(key)
    return left.join(right, wrapped, how).drop(wrapped)


SPREAD = 8                       # groups of a heavy key for each shuffle partition's share of the rows


def heavy_keys(counts: DataFrame, key: str, n: str, spread: int = SPREAD) -> DataFrame | None:
    """(key, _salts): keys that hold more rows than 1/``spread`` of a shuffle partition's even share, and into how
    many groups of that size they are cut.  None without such keys.

    ``counts`` has one row per key.  At most ``spread`` * partitions keys can be so heavy, so the table is broadcast."""
    spark = counts.sparkSession
    total = counts.agg(F.sum(n)).first()[0] or 0
    groups = spread * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.where(F.col(n) * groups > total).select(key, F.ceil(F.col(n) * groups / F.lit(max(total, 1))).cast("int").alias("_salts"))
    got = rows.where("_salts > 1").limit(groups + 1).collect()
    return F.broadcast(spark.createDataFrame(got, rows.schema)) if got else None


def join_spread(rows: DataFrame, per_key: DataFrame, key: str, n: str, how: str = "inner", spread: int = SPREAD) -> DataFrame:
    """Join ``rows`` with ``per_key``, a stored table with one row per ``key`` and the key's row count ``n``,
    so that no task gets much more than its share of the rows, whatever adaptive execution does.

    The rows of a heavy key are dealt by their content's hash to the groups that its size asks for, and its one row in
    ``per_key`` goes to each of them; all other keys are one group.  NULL keys match NULL keys.  ``n`` is dropped.
    Rows that are equal in all columns lie in one group."""
    heavy = heavy_keys(per_key, key, n, spread)
    salt, wrapped = "_salt", "_join_key"
    left, right = rows, per_key.drop(n)
    if heavy is None:
        left, right = left.withColumn(salt, F.lit(0)), right.withColumn(salt, F.lit(0))
    else:
        h = heavy.select(F.struct(F.col(key).alias("k")).alias("_heavy"), "_salts")
        k = lambda df: F.struct(df[key].alias("k")) == h["_heavy"]
        left = left.join(h, k(left), "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("_salts")).cast("int"), F.lit(0)))
        right = right.join(h, k(right), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        left, right = left.drop("_heavy", "_salts"), right.drop("_heavy", "_salts")
    left = left.withColumn(wrapped, F.struct(F.col(key).alias("k"))).withColumnRenamed(salt, f"{salt}_l")
    right = right.withColumn(wrapped, F.struct(F.col(key).alias("k"))).drop(key).withColumnRenamed(wrapped, f"{wrapped}_r")
    on = (F.col(wrapped) == F.col(f"{wrapped}_r")) & (F.col(f"{salt}_l") == F.col(salt))
    return left.join(right.hint("merge"), on, how).drop(wrapped, f"{wrapped}_r", salt, f"{salt}_l")
