"""Lake tables: typed reads, idempotent appends, replacement by key, partitioned writes.

A table is never overwritten while it is read: new contents go to a sibling folder, the old ones are
moved aside, the new ones take their place, and only then the old ones are deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _has_parquet(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    if fs.getFileStatus(p).isFile():
        return True
    it = fs.listFiles(p, True)
    while it.hasNext():
        if it.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table in the order of its schema; a missing or empty one is an empty typed table."""
    if not _has_parquet(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def read_taxonomy(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The taxonomy; it must be there."""
    if not _has_parquet(spark, path):
        raise FileNotFoundError(path)
    return F.broadcast(read_table(spark, path, schema))


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace a table, zstd; by way of a sibling folder, so ``df`` may read the table itself."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    w = (df.repartition(partition_by) if partition_by else df).write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(fresh)
    fs, target = _fs(spark, path)
    aside = _fs(spark, f"{path.rstrip('/')}__old-{uuid.uuid4().hex}")[1]
    before = fs.exists(target)
    if before and not fs.rename(target, aside):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(_fs(spark, fresh)[1], target):
        if before:
            fs.rename(aside, target)
        raise OSError(f"{fresh} can't take the place of {path}")
    if before:
        fs.delete(aside, True)


def with_rows(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Existing and new rows, equal rows once."""
    return existing.unionByName(rows, allowMissingColumns=True).distinct()


def append_rows(path: str, rows: DataFrame, schema: StructType, partition_by: str | None = None) -> None:
    """Union, equal rows once. No new rows: the table is not touched."""
    if rows.isEmpty():
        return
    write_table(with_rows(read_table(rows.sparkSession, path, schema), rows).select(*schema.names), path, partition_by)


def without_value(existing: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column differs from the value; nulls stay."""
    return existing.where(~F.col(column).eqNullSafe(F.lit(value)))


def replaced_rows(existing: DataFrame, column: str, value, rows: DataFrame) -> DataFrame:
    return with_rows(without_value(existing, column, value), rows)


def replace_rows(path: str, column: str, value, rows: DataFrame, schema: StructType, partition_by: str | None = None) -> None:
    """Drop the rows of one value of a column and put others in their place."""
    write_table(replaced_rows(read_table(rows.sparkSession, path, schema), column, value, rows).select(*schema.names), path, partition_by)


def new_documents(batch: DataFrame, existing: DataFrame, mode: str = "sha256") -> DataFrame:
    """Documents of a batch not yet in the lake: by content hash, by doc_id or by the full row; first in a batch wins."""
    key = {"sha256": ["sha256"], "doc_id": ["doc_id"], "full_row": batch.columns}[mode]
    return batch.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")
