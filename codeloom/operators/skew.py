"""Joins that stay balanced when single keys hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most keys that are ever joined by broadcast, and rows of a key that one task may join.
HOT_KEYS, HOT_ROWS = 4096, 1_000_000


def hot_limit(rows: int, hot_keys: int = HOT_KEYS) -> int:
    """How many of ``rows`` rows a key may have that is joined by shuffle."""
    return max(HOT_ROWS, rows // hot_keys)


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, rows: int, how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """``left`` joined on ``key`` with ``right``, which has one row for each key and in ``count`` how many of ``left``'s ``rows``
    rows have that key.

    Keys with more than ``hot_limit`` rows, of which there are at most ``hot_keys``, are joined by broadcast, so none
    of them has to fit into one task; all others are joined by shuffle. ``how`` is inner, left or left_semi; null keys
    match nothing. ``right``'s count column is dropped. Where all rows fit into one task, so does every key, and there is one plain join.
    """
    limit = hot_limit(rows, hot_keys)
    if rows <= limit:
        return left.join(right.drop(count), key, how)
    hot = F.broadcast(right.where(F.col(count) > limit).drop(count))
    rest = right.where(F.col(count) <= limit).drop(count)
    often = left.join(hot, key, "left_semi" if how == "left_semi" else "inner")
    seldom = left.join(hot.select(key), key, "left_anti").join(rest, key, how)
    return often.unionByName(seldom)


#: Rows of one key that one task joins.
KEY_ROWS = 1_000_000


def spread(right: DataFrame, key: str, rows: int = KEY_ROWS) -> tuple[DataFrame, DataFrame]:
    """``right`` with a column _part, and (key, _parts) of its hot keys, for ``join_spread``: keys with more than ``rows`` rows are cut into parts of about
    that many. There is at most one hot key for every ``rows`` rows, so that table is broadcast."""
    hot = right.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts")).where("_parts > 1")
    cut = right.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*right.columns), "_parts"), F.lit(0)).cast("int"))
    return cut.drop("_parts"), hot


def join_spread(left: DataFrame, cut: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``left`` joined on ``key`` with what ``spread`` made; a row of a hot key goes to every part of it."""
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    many = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return many.join(cut, [key, "_part"]).drop("_part")
