"""A base table in buckets by its key: changes by the key leave it where it is, only the changes move."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harborline.session import remove_folder, shared_dir


class KeyedTable:
    """Versions of a table whose files are dealt by the hash of `key`.

    What `read` gives can go through any of `operators.changes` by the same key: Spark joins it bucket by bucket,
    without a shuffle of the base, and `apply` writes the result in the same buckets, without one either. A
    version is a catalogue table of its own, entered when all its files are written; a write that fails leaves
    the version before. The one before the newest stays, for readers that have begun.

    The key should be nearly unique: all rows of one key are in one bucket. Buckets are fixed when the table is
    made; take so many that one is some hundred megabytes. Null keys share a bucket. One writer at a time.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int):
        self.spark, self.name, self.key, self.buckets = spark, name, key, buckets

    def _versions(self) -> list[int]:
        head = f"{self.name}_v"
        names = [t.name for t in self.spark.catalog.listTables(pattern=f"{head}*")]
        return sorted(int(n[len(head):]) for n in names if n[len(head):].isdigit())

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise LookupError(f"no version of {self.name} has been written")
        return self.spark.table(f"{self.name}_v{versions[-1]}")

    def replace(self, rows: DataFrame) -> DataFrame:
        """Write `rows` as the next version. Rows that lie in the buckets already are not shuffled."""
        versions = self._versions()
        number = versions[-1] + 1 if versions else 0
        (
            rows.repartition(self.buckets, self.key)
            .write.format("parquet")
            .bucketBy(self.buckets, self.key)
            .sortBy(self.key)
            .option("path", shared_dir(self.spark, self.name))
            .saveAsTable(f"{self.name}_v{number}")
        )
        for old in versions[:-1]:
            self._drop(old)
        return self.read()

    def apply(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return self.replace(change(self.read()))

    def drop(self) -> None:
        """Remove all versions and their files."""
        for version in self._versions():
            self._drop(version)

    def _drop(self, version: int) -> None:
        table = f"{self.name}_v{version}"
        detail = self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()
        self.spark.sql(f"DROP TABLE {table}")
        remove_folder(self.spark, detail.data_type)
