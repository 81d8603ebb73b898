"""Files of a request by field, in the order in which they arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_field(files: DataFrame, columns: list[str], request_col: str = "request_id", field_col: str = "fieldname", order_col: str = "arrival_idx") -> DataFrame:
    """One row for each request and field, with its files as a list of structs."""
    item = F.struct(F.col(order_col).alias("_at"), F.struct(*columns).alias("f"))
    lists = files.groupBy(request_col, field_col).agg(F.array_sort(F.collect_list(item)).alias("files"))
    return lists.withColumn("files", F.transform("files", lambda x: x["f"]))


def as_map(files: DataFrame, columns: list[str], request_col: str = "request_id", field_col: str = "fieldname", order_col: str = "arrival_idx") -> DataFrame:
    """One row for each request: a map of field names to lists of files."""
    lists = by_field(files, columns, request_col, field_col, order_col)
    entry = F.struct(F.coalesce(F.col(field_col), F.lit("")).alias("k"), F.col("files").alias("v"))
    return lists.groupBy(request_col).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("files"))


def totals(files: DataFrame, by: list[str], size_col: str = "size") -> DataFrame:
    """Files and bytes of each group."""
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.sum(F.coalesce(F.col(size_col), F.lit(0))).cast("long").alias("n_bytes"))
