"""Joins that stay balanced when a few keys hold much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

HOT_SHARE = 0.001
COPIES = "_copies"


def replication(rows: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of the rows, with as many copies as they hold such shares.

    At most ``1 / share`` keys qualify whatever the data, with at most twice as many copies
    together, so the table may be broadcast. A group of one key and copy has about ``share`` of the rows,
    however common the key is. The count is combined map-side before its shuffle; store
    the table to use it for several joins, or for a stream whose keys follow the same counts.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return keys_over_share(counts, key, "_n", share)


def keys_over_share(counts: DataFrame, key: str, n: str, share: float = HOT_SHARE) -> DataFrame:
    """``replication`` out of a table that already has one row and its count per key."""
    limit = counts.agg((F.sum(n) * F.lit(share)).alias("_limit")).scalar()
    return counts.where(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias(COPIES))


def add_salt(rows: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """``_salt`` spreads the rows of hot (and of NULL) keys by ``spread``; others get 0."""
    marks = F.broadcast(hot.select(key, COPIES))
    copies = F.when(F.col(key).isNull(), F.lit(round(1 / HOT_SHARE))).otherwise(F.coalesce(COPIES, F.lit(1)))
    salt = F.pmod(F.xxhash64(spread), copies).cast("int")
    return rows.join(marks, key, "left").withColumn("_salt", salt).drop(COPIES)


def copy_per_salt(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Each hot-key row once for each of its copies, the other rows once with salt 0."""
    marks = F.broadcast(hot.select(key, COPIES))
    salts = F.sequence(F.lit(0), F.coalesce(COPIES, F.lit(1)) - 1)
    return rows.join(marks, key, "left").withColumn("_salt", F.explode(salts)).drop(COPIES)


def row_digest(rows: DataFrame) -> Column:
    """What spreads rows: the whole row, since many may carry the same (default) id, and a
    repeated task must find the same salt."""
    return F.struct(*[f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def join_dimension(
    fact: DataFrame,
    dimension: DataFrame,
    key: str,
    share: float = HOT_SHARE,
    keys: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left join fact -> dimension where one key may own a third of the fact rows.

    Spark broadcasts the dimension by itself when its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold``; beyond that the shuffle is on
    (key, salt), so no task receives all rows of a hot key. ``keys`` may be a table with the
    fact's keys that is cheaper to count than the fact itself, and ``hot`` a stored
    ``replication`` table, with which nothing is counted; the fact may then be a stream.
    """
    if hot is None:
        hot = replication(fact if keys is None else keys, key, share)
    return (
        add_salt(fact, key, hot, row_digest(fact))
        .join(copy_per_salt(dimension, key, hot), [key, "_salt"], "left")
        .drop("_salt")
    )
