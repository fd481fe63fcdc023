"""Writers: tables, JSON, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(path: str, by: str | None = None, **tables: DataFrame) -> None:
    """A parquet folder per table, by graph if asked, so that one graph can be overwritten alone."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{path}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    """K01."""
    df.write.mode("overwrite").json(path)


def summary(nodes: DataFrame, edges: DataFrame, rejected: DataFrame) -> DataFrame:
    """The Markdown lines of a graph's summary, in order (section, line)."""
    count = lambda df, col, title: df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).select(F.lit(title).alias("section"), F.format_string("- %s: %d", F.col(col), F.col("n")).alias("line"))
    return count(nodes, "node_type", "1 Nodes").unionByName(count(edges, "edge_type", "2 Edges")).unionByName(count(rejected, "reason", "3 Rejected"))


def conversation_markdown(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A document per conversation, a numbered section per message."""
    part = F.sort_array(F.collect_list(F.struct(order, "role", "text")))
    body = F.transform(part, lambda m, i: F.format_string("## %d. %s\n\n%s", i + 1, m["role"], m["text"]))
    return messages.groupBy(key).agg(F.array_join(body, "\n\n").alias("markdown"))
