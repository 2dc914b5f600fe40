"""What several operators share: words, saved intermediate tables, missing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rill.session import shared_folder

#: White space of the contracts, as a regular-expression class and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """`df` written to the shared folder and read again: later stages start from files that outlive executors."""
    path = shared_folder(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """`df`, saved, with a long `name`: each row's place, from 0, in the order of all rows.

    Rows are sorted in ranges, of which only the lengths, one for each task, meet in one place. `order` should tell
    rows apart: equal ones share a range.
    """
    at, part = f"{name}_at", f"{name}_part"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = saved(ranged.withColumn(at, place).withColumn(part, F.spark_partition_id()))
    lengths = placed.groupBy(part).agg(F.count(F.lit(1)).alias(name))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select(part, F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name))
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col(at)).drop(at, part)


def dropped(*frames: DataFrame) -> None:
    """Remove the files of frames that `saved` made, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def per_worker(key: tuple, make):
    """What `make()` gives, made once in a Python worker: loaded vocabularies and caches serve its later tasks.

    The first part of a key is a kind, of which a worker keeps one. Functions reach workers pickled by value, so
    module globals are not shared between tasks; `sys` is.
    """
    import sys

    store = sys.__dict__.setdefault("rill_per_worker", {})
    if key not in store:
        for other in [k for k in store if k[0] == key[0]]:
            del store[other]
        store[key] = make()
    return store[key]


def released(spark) -> None:
    """Have the driver collect what finished rounds left: Spark then removes their shuffle files."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
