"""Keeping or dropping documents by a table of ids without moving their texts where the ids are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell.session import settle

#: Ids that may be sent to every executor: a long each, so some tens of megabytes in memory at most.
FEW = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, column: str = "doc_id", few: int | None = None, reused: bool = False) -> DataFrame:
    """Semi or anti join of ``docs`` with ``ids`` on their long ``column``.

    The ids are written and counted. Up to ``few`` (:data:`FEW`) they are broadcast; beyond that both
    sides are shuffled, with the same result. With ``reused`` a shuffled result is written, so that texts
    move once however often it is read.
    """
    ids = settle(ids.select(F.col(column).cast("long").alias(column)).distinct())
    if ids.count() <= (FEW if few is None else few):
        return docs.join(F.broadcast(ids), column, how)
    out = docs.join(ids, column, how)
    return settle(out) if reused else out
