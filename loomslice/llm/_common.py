"""What the operators of this subpackage share: column picking, shared folders, written tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of one narrow column pair that may be broadcast (some 16 MB); beyond it a shuffle join runs.
BROADCAST_ROWS = 500_000

_local_dirs: dict[str, str] = {}


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Select columns by exact name under new names; other columns, even ones that differ only in case, don't matter."""
    names = df.columns
    at = {new: names.index(old) for new, old in cols.items()}
    if len({n.lower() for n in names}) == len(names):
        return df.select(*[F.col(f"`{names[i]}`").alias(new) for new, i in at.items()])
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="loomslice-"))
    if "://" not in base and not base.startswith("file:"):
        base = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(base)).toString()
    return f"{base.rstrip('/')}/loomslice-{app}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder; results not yet read are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plain_uri(uri: str) -> str:
    """file:/x and file:///x as pyarrow's file systems read them."""
    return re.sub(r"^file:/+", "file:///", uri)


def words_of(text: Column) -> Column:
    """The words of a text as an array, by built-in expressions."""
    return F.array_remove(F.split(text, SPACE), "")


def count_words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it is counted to be small, else df itself, which is then joined by shuffle."""
    rows = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: one thing at a time, so that a later stage's takes the place of an earlier's."""
    if key not in _kept:
        _kept.clear()
        _trim()
        _kept[key] = make()
    return _kept[key]


def _trim() -> None:
    """Give freed memory back to the system; allocators would keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving memory back at the end of a task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return wrapped
