"""Byte ranges of files inside tasks: what a reader of a model file needs, whatever keeps the bytes.

Files are listed by Spark's binary file source (whose content column is never read), so any path that Spark can list works.
The bytes come through an ``opener``: a function from a path to an object with read, seek, and size. The default opens what Arrow
can (local files, HDFS, S3, GCS); another store gives its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RangeFile(Protocol):
    """A file that can be read from any place on."""

    def seek(self, at: int) -> object: ...

    def read(self, n: int) -> bytes: ...

    def size(self) -> int: ...


Opener = Callable[[str], RangeFile]


def arrow_opener(path: str) -> RangeFile:
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def read_range(file: RangeFile, start: int, length: int) -> bytes:
    """The bytes of a range; one that the file does not hold whole is an error."""
    if start < 0 or length < 0:
        raise ValueError(f"no range: {start}, {length}")
    file.seek(start)
    out = file.read(length)
    if len(out) != length:
        raise ValueError(f"the file ends {length - len(out)} bytes before the range {start} + {length}")
    return out


def listed(spark: SparkSession, path: str | list[str], *endings: str) -> DataFrame:
    """path and length of all files under the paths with one of the endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    keep = F.lit(False)
    for e in endings:
        keep = keep | F.endswith("path", F.lit(e))
    return files.where(keep) if endings else files


def parsed(files: DataFrame, parse: Callable[[str, RangeFile], Iterator[dict]], schema: str, opener: Opener = arrow_opener, broken: str = "fail") -> DataFrame:
    """The rows that ``parse`` gives for each file, read in tasks; about one file a task where there are few.

    ``broken`` is fail, or keep: a file that cannot be parsed then gives one row with its path and an ``error``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = files.sparkSession
    types = spark.createDataFrame([], schema).schema
    kinds = {f.name: to_arrow_type(f.dataType) for f in types}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, error = [], None
                try:
                    rows = [{"path": name, "error": None} | row for row in parse(name, opener(name))]
                except Exception as x:  # one broken file is not to lose the others
                    if broken == "fail":
                        raise ValueError(f"{name}: {x}") from x
                    error = f"{type(x).__name__}: {x}"
                if error is not None:
                    rows = [{"path": name, "error": error}]
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in part], kind) for f, kind in kinds.items()], list(kinds))

    return files.select("path").repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, types)


def with_payload(entries: DataFrame, opener: Opener = arrow_opener, most: int = 1 << 30) -> DataFrame:
    """entries (path, start, length, ...) with ``payload``: only the ranges asked for are read, in the tasks that hold their rows.

    A payload over ``most`` bytes is an error: cut it in ranges first (see chunks()).
    """
    names = entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                path, start, length = (batch.column(c)[r].as_py() for c in ("path", "start", "length"))
                if length is not None and length > most:
                    raise ValueError(f"{path}: a payload of {length} bytes is over {most}")
                if path != open_path:
                    open_path, file = path, opener(path)
                data = None if start is None else read_range(file, start, length)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in names), pa.array([data], pa.binary())], [*names, "payload"])

    return entries.mapInArrow(run, T.StructType([*entries.schema.fields, T.StructField("payload", T.BinaryType())]))


def chunks(entries: DataFrame, size: int = 16 << 20) -> DataFrame:
    """entries cut into ranges of at most ``size`` bytes, with their number in ``chunk``, so that large payloads spread over tasks."""
    count = F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("int")
    rows = entries.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    step = F.col("chunk").cast("long") * size
    return rows.withColumns({"start": F.col("start") + step, "length": F.least(F.lit(size).cast("long"), F.col("length") - step)})
