"""The catalog of tensor files with payloads, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import model_files
from .ranges import Opener, arrow_opener, with_payload


def read_tensors(spark: SparkSession, path: str, payload: bool = False, opener: Opener = arrow_opener) -> DataFrame:
    """model_files.read_tensors(), with a ``payload`` column if asked for."""
    rows = model_files.read_tensors(spark, path, opener)
    return with_payload(rows, opener) if payload else rows
