"""Places of rows in their files.

Spark reads a file in splits, in parallel. A row's place is the number of rows in the files and splits
before its own plus its number within its split, so first-n and last-wins mean the order that
a person sees in the file, whatever the splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Column of a row's place in datasets of flows.
POSITION = "_pos"


def positioned(scan: DataFrame, into: str = "pos") -> DataFrame:
    """A plain file scan with the place of each row, from 0 on, files in the order of their paths.

    Rows are not moved: each is numbered within its split where it is read, and joined with the offset of its split
    (one row a split). ``scan`` must come straight from a reader. Both passes plan the same
    splits, as the settings and files are the same.
    """
    rows = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    in_file = Window.partitionBy("_file")
    before = F.coalesce(F.sum("_n").over(in_file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_file", "_start", "_first", before.alias("_within"), F.sum("_n").over(in_file).alias("_rows"))
    files = splits.select("_file", "_rows").distinct()
    along = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("_file", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_ahead"))
    offsets = splits.join(files, "_file").select("_file", "_start", (F.col("_ahead") + F.col("_within") - F.col("_first")).alias("_offset"))
    return rows.join(offsets, ["_file", "_start"]).select(*scan.columns, (F.col("_offset") + F.col("_at")).cast("long").alias(into))


def with_position(df: DataFrame) -> DataFrame:
    """A table of a flow with the place of its rows: the reader's, else the order in which the table has them."""
    return df if POSITION in df.columns else df.withColumn(POSITION, F.monotonically_increasing_id())
