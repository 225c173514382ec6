"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than this share of the rows, so fewer keys than ``HOT_KEYS`` are.
HOT_KEYS = 1024


def join_weighted(left: DataFrame, right: DataFrame, key: str | list[str], weight: Column, total: int) -> DataFrame:
    """Inner join on ``key``, columns of both sides that are unique in ``right`` and not null.

    ``weight`` is a column of ``right``: how many rows of ``left`` have the key, ``total``
    of them in all. Fewer than ``HOT_KEYS`` keys can have more than ``total / HOT_KEYS``
    rows; they alone are broadcast, so no task gets all rows of a hot key. The other keys
    meet in a shuffle join.
    """
    key = [key] if isinstance(key, str) else key
    is_hot = weight > F.lit(total / HOT_KEYS)
    hot, cold = (right.where(c) for c in (is_hot, ~is_hot))
    tagged = left.join(F.broadcast(hot.select(*key, F.lit(True).alias("_hot"))), key, "left")
    return (
        tagged.where("_hot").drop("_hot").join(F.broadcast(hot), key)
        .unionByName(tagged.where(F.col("_hot").isNull()).drop("_hot").join(cold, key))
    )
