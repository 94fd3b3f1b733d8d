"""Results that grow run by run: only events without a result are computed, errors kept as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "event_folder"
MOST_PARTS = 1 << 40


def pending(events: DataFrame, results_path: str, key: str = "event_id") -> DataFrame:
    """Events without a result yet: not tried, or tried with an error. Without a results folder, all of them."""
    spark = events.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(results_path)
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        return events
    return events.join(latest(spark, results_path, key).where("error is null").select(key), key, "left_anti")


def append_results(events: DataFrame, results_path: str, evaluate: Callable[[DataFrame], DataFrame], key: str = "event_id") -> None:
    """Evaluate what is pending and store it event by event, each in a folder that a later run replaces.

    All pending events run as keys of one job. If that job fails, its events are halved by a hash of
    their key and both halves run again, until a broken event stands alone; its error text becomes
    its row, and all others keep their results (a fault of every event costs two jobs each). An event that yields no row is recorded too. Events
    with an error are tried again by the next call. A write that is killed leaves whole folders, old
    or new, and the rest pending, so no event ever has its rows twice.
    """
    todo = pending(events, results_path, key)
    waiting = [(1, 0)] if not todo.isEmpty() else []
    while waiting:
        parts, number = waiting.pop()
        some = todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == number) if parts > 1 else todo
        try:
            done = evaluate(some).withColumn("_ok", F.lit(True))
            rows = some.select(key).distinct().join(done, key, "left")
            _store(rows.withColumn("error", F.when(F.col("_ok").isNull(), F.lit("no result"))).drop("_ok"), results_path, key)
        except Exception as failure:  # noqa: BLE001 - whatever an event raises becomes its row
            alone = some.select(key).distinct()
            first = alone.limit(2).count()
            if first > 1 and parts < MOST_PARTS:
                waiting += [(2 * parts, number), (2 * parts, number + parts)]
            elif first:
                _store(alone.withColumn("error", F.lit(f"{type(failure).__name__}: {failure}"[:1000])), results_path, key)


def _store(rows: DataFrame, path: str, key: str) -> None:
    named = rows.withColumn("error", F.col("error").cast("string")).withColumn(FOLDER, F.col(key).cast("string"))
    placed = named.repartition(FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    placed.partitionBy(FOLDER).parquet(path)


def latest(spark: SparkSession, results_path: str, key: str = "event_id") -> DataFrame:
    """Results, and one error row of each event that has none."""
    return spark.read.option("mergeSchema", "true").parquet(results_path).drop(FOLDER)
