"""Sinks.  All writes are distributed; file layout follows the partition columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with a header, nulls as blanks, standard quote doubling."""
    df.write.mode(mode).option("header", "true").option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
    return path


def json_lines(df: DataFrame, path: str, columns: Sequence[str], partition_by: Sequence[str] = (),
               mode: str = "errorifexists") -> str:
    """One JSON line per row, with nulls written out, under the partition folders."""
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")
    writer = df.select(*partition_by, line).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).text(path)
    return path


def text(df: DataFrame, path: str, column: str, mode: str = "errorifexists") -> str:
    df.select(column).write.mode(mode).option("lineSep", "\n").text(path)
    return path


def table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> str:
    """A versioned snapshot: an existing path is never overwritten unless asked."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path
