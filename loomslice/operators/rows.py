"""Row identity, counts, high-water marks and checks of references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "_row_id"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with the place of each row, file and position, as its identity."""
    df = spark.read.parquet(path)
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(ROW_ID))


def pack_place(block: Column, offset: Column) -> Column:
    """A page number and a 16-bit offset as one number."""
    return F.shiftleft(block.cast("long"), 16).bitwiseOR(offset.cast("long"))


def unpack_place(place: Column) -> Column:
    return F.struct(F.shiftright(place, 16).alias("block"), place.bitwiseAND(0xFFFF).alias("offset"))


def keys_match(a: DataFrame, b: DataFrame, ours: list[str], theirs: list[str]) -> Column:
    """All parts equal; a null part never matches. (Comparing structs would match null with null.)"""
    return reduce(lambda x, y: x & y, [a[f"`{x}`"] == b[f"`{y}`"] for x, y in zip(ours, theirs, strict=True)])


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_id, row_count."""
    each = [df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_id"), "row_count") for t, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, each)


def high_water(current: DataFrame, dumped: DataFrame) -> DataFrame:
    """Sequences (id, last_value) that only ever advance: the greater of both values, for every id of either."""
    c, d = current.select("id", F.col("last_value").alias("now")), dumped.select("id", F.col("last_value").alias("then"))
    return c.join(d, "id", "full").select("id", F.greatest("now", "then").alias("last_value"))


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Child rows whose key has no null part and no parent."""
    whole = reduce(lambda x, y: x & y, [F.col(f"`{c}`").isNotNull() for c in columns])
    return child.where(whole).join(parent, keys_match(child, parent, columns, parent_columns), "left_anti")
