"""Scans of streams: the same columns, applied to texts as they arrive."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import scan_table
from ..plans.config import RuleSet


def arriving(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """Rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def scan_stream(texts: DataFrame, file: str, text: str, rules: RuleSet, out: str, checkpoint: str, now: float | None = None):
    """Scan each micro-batch whole and append its findings as Parquet; a batch that is tried again replaces itself.

    A text is one row, so no state outlives a batch, and late data needs no watermark.
    """
    def batch(df: DataFrame, number: int) -> None:
        found = scan_table(df, file, text, rules, now=now).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_per_window(found: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Findings by reason and window of event time; what is later than `late` no longer counts."""
    return found.withWatermark(time, late).groupBy(F.window(time, width), "reason").agg(F.count("*").alias("n"))


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the cluster names; in local mode, where none is named, a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="siftline-stream-")
    return f"{root.rstrip('/')}/siftline/{uuid.uuid4().hex}"


def drained(source: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a stream holds now, scanned batch by batch; a batch that is tried again replaces itself."""
    spark = source.sparkSession
    path = scratch(spark)
    schema = scan(spark.createDataFrame([], source.schema)).schema

    def batch(df: DataFrame, number: int) -> None:
        scan(df).write.mode("overwrite").parquet(f"{path}/found/batch={number}")

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/found")
