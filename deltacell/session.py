"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "deltacell", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every plan here assumes; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` as the cluster names it.

    Where it is unset and one machine does all the work, as in tests, the context gets a fresh
    folder. On a cluster that is an error, as a folder of one machine would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Used where a result feeds more than one branch or closes a loop round. The written table
    survives lost executors and gives the optimizer real sizes. A table that has just been
    written is returned as it is.
    """
    if "_written_to" in df.__dict__:
        return df
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/deltacell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_to"] = path
    return out


def written_bytes(df: DataFrame) -> int:
    """Size on disk of a table returned by :func:`settle`, without a Spark job."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["_written_to"])
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    return path.getFileSystem(conf).getContentSummary(path).getLength()
