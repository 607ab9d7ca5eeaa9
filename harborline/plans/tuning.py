"""PostgreSQL settings by plan size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.session import local_table

# Versions that have default settings.
DEFAULT_VERSIONS = ["10", "11", "12"]

# Settings all tuned sizes share.
COMMON_SETTINGS = {
    "max_connections": "512",
    "checkpoint_completion_target": "0.9",
    "default_statistics_target": "100",
    "random_page_cost": "1.1",
    "effective_io_concurrency": "200",
    "min_wal_size": "1GB",
    "max_wal_size": "4GB",
}

# Fixed values: (vcpu, memory in bytes, shared_buffers, effective_cache_size,
# maintenance_work_mem, wal_buffers, work_mem, max_worker_processes,
# max_parallel_workers_per_gather, max_parallel_workers). None of them is rotational.
TUNED_SIZES = [
    (1, 1000000000, "256MB", "768MB", "64MB", "7864kB", "655kB", None, None, None),
    (1, 2000000000, "512MB", "1536MB", "128MB", "16MB", "1310kB", None, None, None),
    (2, 1000000000, "256MB", "768MB", "64MB", "7864kB", "1310kB", 2, 1, 2),
    (2, 2000000000, "512MB", "1536MB", "128MB", "16MB", "2621kB", 2, 1, 2),
    (2, 8000000000, "2GB", "6GB", "512MB", "16MB", "1MB", 2, 1, 2),
    (4, 16000000000, "4GB", "12GB", "1GB", "16MB", "4MB", 4, 2, 4),
    (8, 32000000000, "8GB", "24GB", "2GB", "16MB", "4MB", 8, 4, 8),
]
SIZE_SETTINGS = [
    "shared_buffers", "effective_cache_size", "maintenance_work_mem", "wal_buffers", "work_mem",
    "max_worker_processes", "max_parallel_workers_per_gather", "max_parallel_workers",
]


def tuning_table(spark: SparkSession) -> DataFrame:
    """One row per tuned size, keyed by (rotational, vcpu, memory)."""
    texts = "shared_buffers string, effective_cache_size string, maintenance_work_mem string, wal_buffers string, work_mem string"
    workers = "max_worker_processes int, max_parallel_workers_per_gather int, max_parallel_workers int"
    rows = [(False, *size) for size in TUNED_SIZES]
    return local_table(spark, rows, f"rotational boolean, vcpu int, memory long, {texts}, {workers}")
