"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Runtime settings every job here relies on. All can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins on a hot key are split at run time, even where the next operator would
    # otherwise have reused the join's partitioning.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Session windows merge inside each map task first, so that a hot key reaches
    # its reducer as a few sessions and not as all of its rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Tables in buckets are always read by bucket, so that what is added to one in the same
    # buckets can be written back without a shuffle.
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    # Rows that Python gets at once: some megabytes of texts and not some tens.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Streaming state on disk with incremental uploads: it may outgrow executor memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # Python workers look for the package where this process found it, too.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))
    return spark


def local_session(cpus: int, memory: str = "16g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("harborline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="harborline-")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder that the session names for checkpoints.

    Only a local session, as in tests, may do without one; it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _test_folder()
    return f"{root.rstrip('/')}/harborline/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of files that nothing reads any more; one that is not there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows stay the same when executors are lost."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of fixed values that travels in the plan: its size is known to the planner."""
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrow = pa.table(
        [pa.array(list(values), type=to_arrow_type(f.dataType)) for values, f in zip(columns, fields)],
        names=fields.names,
    )
    return spark.createDataFrame(arrow, schema=fields)


def is_small(df: DataFrame, max_rows: int = 20_000) -> bool:
    """Whether `df` has at most `max_rows` rows, looking at no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows
