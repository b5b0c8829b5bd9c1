"""Small helpers that the operators share: reading tables, cutting lineage, running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java's \s with Unicode classes (so also the no-break spaces) and the four ASCII separators.
SPACE = r"[\s\x{1c}-\x{1f}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(text: Column) -> Column:
    """Text without white space around it; Unicode white space counts."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def blank(text: Column) -> Column:
    """True for null, empty and white space only."""
    return text.isNull() | ~text.rlike(f"(?U)[^\\s\\x{{1c}}-\\x{{1f}}]")


def every_50th(identifier: Column) -> Column:
    """The stated set of queries: identifiers whose last four digits, read as a hexadecimal number, are divisible by 50."""
    return F.coalesce(identifier.rlike("[0-9a-f]{4}$") & (F.conv(F.right(identifier, F.lit(4)), 16, 10).cast("int") % 50 == 0), F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only in local mode (tests) one is made where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/palimpsest/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column], label: str = "running") -> DataFrame:
    """Inclusive running totals per key along an order, without ever giving one key to one task.

    Rows are range-partitioned by key and order, so a key that holds a third of all rows spreads over many
    partitions. Each partition sums its own rows; a table of one row per key and partition carries the sums of
    the partitions before. The order must be unique within a key. Nulls count as a key of their own.
    """
    keys, order = list(keys), list(order)
    named = df.withColumns({f"__{k}": v for k, v in totals.items()})
    spread = named.repartitionByRange(*(F.col(c) for c in [*keys, *order])).withColumn("__part", F.spark_partition_id())
    spread = materialize(spread, label)
    sums = spread.groupBy(*keys, "__part").agg(*(F.sum(f"__{k}").alias(f"__before_{k}") for k in totals))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__part", *(F.coalesce(F.sum(f"__before_{k}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k in totals))
    sums = sums.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col("__part").alias("__at"), *(f"__before_{k}" for k in totals))
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = spread.withColumns({k: F.sum(f"__{k}").over(within) for k in totals})
    on = F.col("__part") == F.col("__at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return rows.join(sums, on).select(*(c for c in df.columns if c not in totals), *((F.col(k) + F.col(f"__before_{k}")).alias(k) for k in totals))


def with_previous(df: DataFrame, key: str, order: Sequence[str], column: str, label: str = "previous") -> DataFrame:
    """df with ``before``: the value of ``column`` in the row before, in an order that is unique within a key; null for the first.

    Rows are range-partitioned by key and order, so a hot key spreads over many partitions; one row per key and partition
    carries the last value over the border. Nulls of the column itself are passed over at borders only.
    """
    spread = materialize(df.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()), label)
    here = Window.partitionBy(key, "__part").orderBy(*order)
    ends = spread.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__at")).agg(F.max_by(column, F.struct(*order)).alias("__end"))
    ends = ends.select("__key", "__at", F.lag("__end").over(Window.partitionBy("__key").orderBy("__at")).alias("__carry"))
    rows = spread.withColumns({"__lag": F.lag(column).over(here), "__first": F.row_number().over(here) == 1})
    joined = rows.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")))
    return joined.select(*df.columns, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__lag")).alias("before"))
