"""Written tables that cut lineage and outlive lost executors."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else one below the warehouse: both are seen by every executor."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


class Scratch:
    """A folder of intermediate tables and files for one call of an operator.

    A table that is used up goes with ``drop``; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
        where = self._hadoop(self.path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """``df`` written as Parquet and read again."""
        path = f"{self.path}/{table}"
        df.write.mode("overwrite").parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def files(self, name: str) -> str:
        """A folder for files that executors write; its URI names the file system."""
        where = self._hadoop(f"{self.path}/{name}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        return fs.makeQualified(where).toString()

    def drop(self, table: str) -> None:
        where = self._hadoop(f"{self.path}/{table}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
