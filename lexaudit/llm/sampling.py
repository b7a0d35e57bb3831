"""Bounded samples of rows, chosen by a hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BITS = 30


def hash_share(id_col: str) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.xxhash64(id_col).bitwiseAND((1 << _BITS) - 1) / float(1 << _BITS)


def bounded_sample(rows: DataFrame, id_col: str, group: str, n: int, max_groups: int = 256) -> DataFrame:
    """Up to ``n`` rows of each group (of the ``max_groups`` largest), those of the smallest hashes of their ids.

    A first cut by the share of rows wanted leaves about 4 n rows of a group, so that ranking never gathers a large group. A row
    that passes depends on its id and the size of its group only.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size")).orderBy(F.desc("_size"), group).limit(max_groups)
    cut = rows.join(F.broadcast(sizes), group).where(hash_share(id_col) * F.col("_size") <= 4.0 * n + 64).drop("_size")
    order = Window.partitionBy(group).orderBy(F.xxhash64(id_col), id_col)
    return cut.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n).drop("_at")


def bounded_rows(rows: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` of ``rows``, drawn row by row where there are more, so that an id that many rows share can't fill the driver."""
    keyed = rows.withColumns({"_row": F.xxhash64(F.monotonically_increasing_id()), "_all": F.lit(True)})
    return bounded_sample(keyed, "_row", "_all", n).select(*rows.columns)
