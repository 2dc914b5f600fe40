"""Running a stream over what is there, and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rill.session import shared_folder
from rill.sources.fixedwidth import FixedWidthSource, Layout


def run_available_now(stream: DataFrame, mode: str, state_partitions: int = 8) -> DataFrame:
    """Process all available input, then return the result.

    State, offsets and results live in the shared folder: a complete-mode table is rewritten by each batch,
    append-mode rows go to a file sink that commits each batch once.
    """
    spark = stream.sparkSession
    root = shared_folder(spark)
    out, log = f"{root}/out", f"{root}/log"
    spark.createDataFrame([], stream.schema).write.parquet(out)

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", log)
        if mode == "append":
            out += "-rows"
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(store).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.schema(stream.schema).parquet(out)


def run_to_files(stream: DataFrame, path: str, layout: str) -> None:
    """Process all available input into fixed-width files, each batch's once it is whole."""
    spark = stream.sparkSession
    spark.dataSource.register(FixedWidthSource)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in Layout.parse(layout).schema]
    writer = stream.select(*columns).writeStream.format("fixedwidth").option("layout", layout).option("path", path)
    writer.option("checkpointLocation", f"{shared_folder(spark)}/log").trigger(availableNow=True).start().awaitTermination()


def progress_rows(spark: SparkSession, query) -> DataFrame:
    """Input and processing rate of each finished batch."""
    rows = [(p["batchId"], p["numInputRows"], p.get("processedRowsPerSecond")) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, input_rows long, rows_per_second double")
