"""A join for keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies of the smaller side.
SALT = 16


def beside(left: DataFrame, right: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which is unique on ``on``; null where it has no row.

    ``right`` is repeated :data:`SALT` times, so that a hot key of ``left`` is spread by the columns ``by``. Rows of ``left``
    with an empty or null key ask for nothing; they get keys of their own, so that they don't meet in one task.
    """
    keys = [f"_{c}" for c in on]
    alone = F.concat(F.lit("#"), F.xxhash64(*by).cast("string"))
    asking = left.withColumns({"_salt": F.pmod(F.xxhash64(*by), F.lit(SALT)), **{k: F.when(F.col(c) != "", F.col(c)).otherwise(alone) for k, c in zip(keys, on)}})
    there = right.withColumnsRenamed(dict(zip(on, keys))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
    return asking.join(there, [*keys, "_salt"], "left").drop(*keys, "_salt")
