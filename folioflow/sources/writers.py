"""Sinks: collections, conversations, partitioned saves, citation exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_collection(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows under ``collection=...``; ``rebuild`` replaces the whole table."""
    if mode not in ("append", "rebuild"):
        raise ValueError("mode must be append or rebuild")
    out = df.write.partitionBy("collection")
    out.mode("append" if mode == "append" else "overwrite").parquet(path)


def write_conversations(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


def save_data(df: DataFrame, path: str) -> None:
    """Append JSON rows under ``data_type=.../category=...``."""
    df.write.partitionBy("data_type", "category").mode("append").json(path)


def export_citations(df: DataFrame, fmt: str = "json") -> DataFrame:
    """One text line per citation, ready for ``write.text``."""
    if fmt == "json":
        line = F.to_json(F.struct("query", "citation", "text", "source", "metadata"))
    elif fmt == "csv":
        line = F.to_csv(
            F.struct("text", "source", F.to_json("metadata").alias("metadata")), {"escape": '"'}
        )
    elif fmt == "html":
        line = F.format_string("<li>%s (%s)</li>", "text", "source")
    else:
        raise ValueError("Unsupported format")
    return df.select(line.alias("value"))
