"""Streaming loads: rows of a stream merged into keyed tables, in micro-batches.

Each batch writes a new version ``v<epoch>`` merged from the one before, so a batch that failed and runs again
rewrites its own version. Large tables are dealt over buckets by a hash of their keys (``bucket=<b>/v<epoch>``):
a batch then rewrites only the buckets that its keys fall into. Readers take the highest complete
version of each (it has a _SUCCESS file), see :func:`newest`; the last ``KEPT`` versions stay, so a reader that
began before a batch can finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators.graph_build import upsert

KEPT = 2


def latest(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key of a batch."""
    cols = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def _versions(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The complete versions in each folder of a table, oldest first."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {}
    for pattern in (f"{path}/v*/_SUCCESS", f"{path}/bucket=*/v*/_SUCCESS"):
        for status in fs.globStatus(fs_path(pattern)) or ():
            version = status.getPath().getParent()
            found.setdefault(version.getParent().toString(), []).append(int(version.getName()[1:]))
    return {folder: sorted(v) for folder, v in sorted(found.items())}


def newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its newest complete versions have it; None before the first batch."""
    parts = [f"{folder}/v{v[-1]}" for folder, v in _versions(spark, path).items()]
    return spark.read.parquet(*parts) if parts else None


def _merge(new: DataFrame, folder: str, epoch: int, keys: list[str]) -> None:
    spark = new.sparkSession
    before = [v for versions in _versions(spark, folder).values() for v in versions if v < epoch]
    merged = upsert(spark.read.parquet(f"{folder}/v{before[-1]}"), new, keys) if before else new
    merged.write.mode("overwrite").parquet(f"{folder}/v{epoch}")
    for old in before[: 1 - KEPT]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{old}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def merge_batches(path: str, keys: list[str], order: list[str], buckets: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into the table at ``path``."""

    def run(batch: DataFrame, epoch: int) -> None:
        if buckets is None:
            return _merge(latest(batch, keys, order), path, epoch, keys)
        rows = latest(batch, keys, order).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).persist()
        for b in sorted(r[0] for r in rows.select("_bucket").distinct().collect()):  # at most `buckets` numbers
            _merge(rows.where(F.col("_bucket") == b).drop("_bucket"), f"{path}/bucket={b}", epoch, keys)
        rows.unpersist()

    return run


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per type and window; rows later than ``late`` are dropped and their state with them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
