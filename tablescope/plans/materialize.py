"""Written tables: the way in which this package cuts lineage. They go when the application ends."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else one below the warehouse: both are seen by every executor."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def _gone_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once, so later uses survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
        _gone_at_exit(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """A summary written as a table, so that its size is known: the planner broadcasts it only below its own threshold."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/summary-{uuid4().hex}"
    df.write.parquet(folder)
    _gone_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)
