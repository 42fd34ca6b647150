"""Text files as rows with a true line order that survives file splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``file, seq, value``: ``seq`` grows with the line's place inside its file.

    ``seq`` is the byte offset of the line's split plus the line's position in its task.
    A task reads at most one split size of bytes, so positions never reach the next
    split's offset: the number is unique and increasing per file although no task reads
    a whole file.  Land the rows as a table before joining on ``seq``.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # The running id counts a task's lines in its low 33 bits.
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select(
        F.col("file_path").alias("file"),
        (F.col("file_block_start") + position).alias("seq"),
        "value",
    )


def folder_of(file_col) -> Column:
    """Name of the session folder a file lies in."""
    return F.element_at(F.split(file_col, "/"), -2)
