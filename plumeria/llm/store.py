"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set, a folder of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='plumeria-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so that lost executors cost one stage at most.

    The files go when the driver's JVM ends, or with forget().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, fs = _place(spark, path)
    fs.deleteOnExit(at)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(spark: SparkSession, since: int = 0, but: str | None = None) -> int:
    """Delete the tables written since there were ``since`` of them, but for the last one named ``but``; returns how many are left.

    Call it when nothing reads them any more: after the result of a step has been written itself.
    """
    last = next((p for p in reversed(_made) if but and f"/{but}-" in p), None)
    gone = [p for p in _made[since:] if p != last]
    for path in gone:
        at, fs = _place(spark, path)
        fs.delete(at, True)
    _made[since:] = [p for p in _made[since:] if p not in gone]
    return len(_made)


def discard(spark: SparkSession, name: str) -> None:
    """Delete the last table written under a name, once what was made of it has been written too."""
    path = next(p for p in reversed(_made) if f"/{name}-" in p)
    at, fs = _place(spark, path)
    fs.delete(at, True)
    _made.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame) -> int:
    """All bytes of the text column."""
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
