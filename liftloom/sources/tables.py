"""Readers of inputs and writers of results; formats are Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, format: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """A table from parquet, orc, csv, json or any format that Spark knows; the ending of ``path`` names it."""
    kind = format or path.rstrip("/").rsplit(".", 1)[-1]
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", options.get("header", "true"))
    return reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def result_frame(df: DataFrame, frame: str = "spark"):
    """A result as a Spark or pandas table."""
    if frame == "spark":
        return df
    if frame == "pandas":
        return df.toPandas()
    raise ValueError(f"unknown frame {frame!r}; known are spark and pandas")


def from_matrix(spark: SparkSession, x, t=None, y=None, names: list[str] | None = None) -> DataFrame:
    """A table from an in-memory matrix (anything with rows), with ``row_id`` for the rows' positions."""
    import numpy as np

    if hasattr(x, "columns"):
        names = names or [str(c) for c in x.columns]
    x = np.asarray(x.to_numpy() if hasattr(x, "to_numpy") else x, float)
    x = x.reshape(len(x), -1)
    names = names or [f"feature_{i}" for i in range(x.shape[1])]
    columns = {n: x[:, i].tolist() for i, n in enumerate(names)}
    schema = "row_id long, " + ", ".join(f"`{n}` double" for n in names)
    if t is not None:
        columns["t"] = np.asarray(t).reshape(-1).astype(int).tolist()
        schema += ", t int"
    if y is not None:
        columns["y"] = np.asarray(y, float).reshape(-1).tolist()
        schema += ", y double"
    return spark.createDataFrame(list(zip(range(len(x)), *columns.values(), strict=True)), schema)
