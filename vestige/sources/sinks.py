"""Writers: graph tables, score rows, key and pair lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """One parquet table per node and edge type, split by trace."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("trace_id").parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str, schemas: dict) -> dict[str, DataFrame]:
    """The tables back, each under its schema (a table may hold no rows and no files)."""
    return {n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in schemas.items()}


def register_views(tables: dict[str, DataFrame]) -> None:
    """Node and edge tables as SQL views of the same names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_rows(df: DataFrame, folder: str, form: str = "json") -> None:
    """Trial rows, evaluation rows, envelope keys, session pairs."""
    df.write.mode("overwrite").format(form).save(folder)
