"""Candidates of a growing table: each micro-batch is blocked against all rows so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.text import tokens


def token_pairs_with(batch: DataFrame, everything: DataFrame, value: str, cap: int) -> DataFrame:
    """Pairs of a batch's nodes with any node that shares a token of a bucket of up to ``cap``."""
    keyed = everything.select("id", F.explode(F.array_distinct(tokens(F.col(value)))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n between 2 and {cap}").select("key")
    new = batch.select(F.col("id").alias("x"), F.explode(F.array_distinct(tokens(F.col(value)))).alias("key")).join(sizes, "key")
    return new.join(keyed.withColumnRenamed("id", "y"), "key").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def watch(stream: DataFrame, store: str, handle: Callable[[DataFrame, int], None], value: str, checkpoint: str, cap: int = 500):
    """Append each micro-batch to the table at ``store`` and hand on the pairs that it makes. A batch that is replayed overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{store}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        everything = spark.read.option("basePath", store).parquet(store).where(F.col("batch") <= number)
        handle(token_pairs_with(spark.read.parquet(path), everything, value, cap), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
