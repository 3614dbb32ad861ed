"""Appending tensors from a stream to a container's tables, exactly once for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.container import digest


def append_tensors(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of rows (name, dtype, shape, payload) to ``path``: one folder for each micro-batch, replaced if the batch runs again.

    Start it with .start(). read_appended() gives the tensors, the last one of each name.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"checksum": digest(F.col("payload")), "length": F.octet_length("payload").cast("long")})
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.select("name", "dtype", "shape", "payload").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def read_appended(spark, path: str) -> DataFrame:
    """name, dtype, shape, payload, checksum, length and batch: of each name, the row of the last batch (of equal ones, the least digest)."""
    rows = spark.read.parquet(path)
    facts = [c for c in rows.columns if c not in ("name", "payload")]
    last = rows.groupBy("name").agg(F.max(F.struct("batch", "checksum")).alias("own__last")).select("name", F.col("own__last.batch").alias("batch"), F.col("own__last.checksum").alias("checksum"))
    return rows.join(last, ["name", "batch", "checksum"], "left_semi").dropDuplicates(["name"]).select("name", *facts, "payload")


def state_dict(spark, path: str) -> DataFrame:
    """The names, types and shapes so far, in order of the names."""
    return read_appended(spark, path).select("name", "dtype", "shape", "length").orderBy("name")
