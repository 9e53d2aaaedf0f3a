"""Joins with one row per key where a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in so many, so there are fewer hot keys than this.
HOT = 1000


def join_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, how: str = "inner", hot: int = HOT) -> DataFrame:
    """``rows`` joined on ``keys`` with ``keyed``: a saved table of one row per key, with the key's number of rows in ``count``.

    Hot keys are matched by a broadcast of fewer than ``hot`` rows, whatever the size of the
    corpus; so no task of the other join gets more than a 1/``hot`` of all rows for one key.
    Both tables are read twice and should be narrow.  ``how``: inner or left.  Keys are not null.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * hot > total
    many, few = keyed.where(heavy), keyed.where(~heavy)
    out = rows.join(F.broadcast(many), keys)
    rest = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(few, keys, how)
    return out.unionByName(rest)
