"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltacell.session import settle, written_bytes

BROADCAST_BYTES = 16 * 1024 * 1024
SALTS = 16
_HASHABLE = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.BooleanType)


def _row_salt(df: DataFrame, salts: int) -> Column:
    """Salt from the row's own content, so a rerun task places every row as before."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, _HASHABLE)]
    return F.pmod(F.xxhash64(*[F.col(n) for n in names]), F.lit(salts))


def cell_join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that both grow with the data: sorted, merged and never broadcast.

    Spark guesses a table's size from its compressed files. Cells compress well, so that guess
    would send millions of rows through the driver.
    """
    return df.join(other.hint("merge"), keys, how)


def salted_join(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join that spreads each key of ``df`` over ``salts`` partitions.

    ``lookup`` is repeated once per salt, so it should be the much smaller side. It is never broadcast,
    as the repeated rows would all pass the driver.
    """
    left = df.withColumn("_salt", _row_salt(df, salts))
    right = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])))
    return cell_join(left, right, [*keys, "_salt"], how).drop("_salt")


def attach(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add scalar columns kept one row per key, such as a grid's threshold.

    The lookup is written out once and its size on disk looked up. Up to ``max_bytes`` it is
    broadcast and ``df`` does not move; beyond that the join is shuffled with salted keys.
    """
    written = settle(lookup)
    if written_bytes(written) <= max_bytes:
        return df.join(F.broadcast(written), keys, how)
    return salted_join(df, written, keys, how)
