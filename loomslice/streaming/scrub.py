"""Scrubbing streams: native transforms are expressions of one row, so they apply to streaming frames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomslice.functions.registry import TransformError, Transforms


def scrub_stream(stream: DataFrame, transforms: Transforms, table: str) -> DataFrame:
    """A streaming frame with its configured columns scrubbed; numbering rows isn't possible there."""
    for name in transforms.tables.get(table, {}).values():
        if transforms.numbers_rows(name):
            raise TransformError(f"{name} numbers rows, which a stream has no order for")
    return transforms.apply(table, stream)
