"""Event logs from files: any format Spark reads, with columns named for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.sequences import parse_time


def read_events(spark: SparkSession, path: str, actor: str, action: str, time: str | None = None, order: str | None = None, kind: str = "parquet", **options) -> DataFrame:
    """actor, action, time, ord and the file's other columns. Text formats have a header."""
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}), **options)
    df = reader.format(kind).load(path)
    df = parse_time(df, time) if time else df
    names = {actor: "actor", action: "action", **({time: "time"} if time else {}), **({order: "ord"} if order else {})}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def write_network(edges: DataFrame, path: str, kind: str = "parquet") -> None:
    edges.select("from", "to", "weight").write.format(kind).save(path)


def infer_shape(df: DataFrame, columns: list[str] | None = None) -> str:
    """`onehot` if all (given) columns hold 0 and 1 alone, `long` with columns action and
    actor, else `wide`. One aggregate."""
    names = {c.lower() for c in df.columns}
    if {"actor", "action"} <= names:
        return "long"
    columns = columns or df.columns
    bad = df.agg(*[F.sum((~F.col(f"`{c}`").cast("string").isin("0", "1", "0.0", "1.0", "true", "false")).cast("int")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return "onehot" if all(not x for x in bad) else "wide"
