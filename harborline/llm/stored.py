"""Tables written to the shared folder between jobs, and removed when they are used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.session import shared_dir

# Shuffle files go when the job that wrote them has ended, so disk holds one job's at a time.
CLEAN_UP = "spark.sql.shuffleDependency.fileCleanup.enabled"


class Stored:
    """The intermediate tables of one operator.

    A written table cuts the lineage: when an executor is lost later, no earlier job runs again.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, shared_dir(spark, label)
        self.count = 0

    def keep(self, df: DataFrame, *partition: str) -> DataFrame:
        """Write `df` and return it as read back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(*partition) if partition else writer).parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._stored_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._stored_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
