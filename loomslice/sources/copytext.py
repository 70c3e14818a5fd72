"""Rows as tab-separated text with backslash escapes, by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Character and its letter after a backslash.
_LETTERS = (("\b", "b"), ("\f", "f"), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\v", "v"))


def encode_field(c: Column) -> Column:
    out = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for char, letter in _LETTERS:
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return F.coalesce(out, F.lit("\\N"))


def decode_field(c: Column) -> Column:
    """The text of a field; ``\\N`` is null, and a backslash before any other character is dropped."""

    def piece(x: Column) -> Column:
        for char, letter in _LETTERS:
            x = F.replace(x, F.lit("\\" + letter), F.lit(char))
        return F.replace(x, F.lit("\\"), F.lit(""))

    return F.when(c != "\\N", F.array_join(F.transform(F.split(c, r"\\\\"), piece), "\\"))


def encode_rows(df: DataFrame) -> DataFrame:
    """A column ``value`` with a line per row."""
    return df.select(F.concat_ws("\t", *[encode_field(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def decode_rows(lines: DataFrame, columns: list[str], schema: StructType | None = None) -> DataFrame:
    """Lines (``value``) to columns, text or cast to the schema's types."""
    parts = F.split("value", "\t", -1)
    out = lines.select(*[decode_field(parts[i]).alias(c) for i, c in enumerate(columns)])
    return out.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema]) if schema else out
