"""Session helpers: table access, lineage cuts in the shared folder, bounded broadcasts."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many parts as there are cores; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many parts as the session's shuffles have. For rows that grow when they are unfolded: the number is asked for, so it is not lowered by their size before."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def once(value: Column, name: str) -> Column:
    """``value`` as a generated column: later filters and projections use it without computing it again."""
    return F.explode(F.array(value)).alias(name)


BROADCAST_ROWS = 200_000  # of keys of at most 36 characters: some 15 MB


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (one narrow key column) with a broadcast hint if it was counted to have at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, local mode)
    a folder of this machine is used.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = "file://" + os.path.join(tempfile.gettempdir(), "veridraft-shared")
    return conf.rstrip("/")


_written: list = []


@atexit.register
def _remove_written() -> None:
    """At the end of the driver its cut tables go, where the shared folder is a mounted path."""
    for path in _written:
        if path.startswith("file:"):
            shutil.rmtree(path[len("file:") :].replace("///", "/").replace("//", "/"), ignore_errors=True)


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets later steps read single columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veridraft/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # on any file system, when the driver's JVM ends
    release(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a cut table that nothing reads any longer."""
    path = getattr(table, "_cut_path", None)
    if path:
        spark = table.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans nobody holds any longer (it does so when the JVM collects them)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucket_counts(spark_df: DataFrame, col: str, bits: int = 16) -> "object":
    """A count-min sketch (two rows of ``2**bits`` counters) of a bigint hash column.

    Its size does not depend on the data (1 MB at 16 bits), so it may be collected and broadcast.
    Counters cover every row of ``spark_df``.
    """
    import numpy as np

    size = 1 << bits
    h = F.col(col)
    rows = (
        spark_df.select(F.explode(F.array(F.shiftrightunsigned(h, 64 - bits).cast("int"), (h.bitwiseAND(F.lit(size - 1)) + size).cast("int"))).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most 2 * 2**bits rows
    )
    out = np.zeros(2 * size, dtype=np.int64)
    for r in rows:
        out[r.slot] = r.n
    return out


def sketch_count(sketch, hashes, bits: int = 16):
    """Estimated counts (never too low) of int64 hashes under a :func:`bucket_counts` sketch."""
    import numpy as np

    size = 1 << bits
    u = hashes.view(np.uint64)
    return np.minimum(sketch[(u >> np.uint64(64 - bits)).astype(np.int64)], sketch[(u & np.uint64(size - 1)).astype(np.int64) + size])


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package (once for each context)."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_veridraft_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="veridraft-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._veridraft_shipped = True
