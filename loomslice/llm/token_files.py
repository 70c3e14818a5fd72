"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A folder holds, per shard, ``tokens-*.bin`` (ids of all its documents, unsigned 16 or 32 bits, little
endian), ``offsets-*.bin`` (n + 1 signed 64-bit offsets into it) and ``ids-*.bin`` (a 64-bit doc_id and
a byte that is 0 for null, per document), and ``index.json`` with the shards in order and each one's
base, the prefix sum of the ids before it. A document's start is its shard's base plus its offset. The
files are memory-mapped where the folder is on a local or mounted file system, else read by ranges.

Documents are in ascending order of doc_id, nulls first; rows with equal ids are in order of the text's
hash and then the text. A null text counts as empty and gives the end id alone. Every input row is a
document, so repeated rows repeat. An empty table gives an index without shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, pick, plain_uri, tidy
from ._tokens import encoder, resolve, together

_SHARD = "part int, name string, docs long, tokens long"
#: Documents read at a time.
_STEP = 128


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str | None = None, *, tokenizer: str = "public:byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, specials_as_text: bool = False) -> str:
    """Encode docs into ``folder`` (by default a new one in the shared folder); returns the folder.

    One shuffle puts the texts in order of ids. Each task streams its range into files under a name of
    its own attempt, and the index names those of the attempts that succeeded, so a task that is run
    again leaves no trace in the result. width: bits of an id on disk, 16 or 32; by default the fewest
    that hold the vocabulary and the end id. specials_as_text: whether a special token's string in a text is
    ordinary text instead of that token.
    """
    spark = docs.sparkSession
    folder = plain_uri(folder or new_path(spark, "tokens"))
    if width is None:
        width = 16 if max(encoder(resolve(tokenizer)).tk.get_vocab_size(), end_id + 1) <= 1 << 16 else 32
    kind = {16: "<u2", 32: "<u4"}[width]
    fs, root = _store(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, name, end = encoder(resolve(tokenizer), specials_as_text), uuid.uuid4().hex, np.array([end_id], "<u4").tobytes()
        fs, root = _store(folder)
        docs = tokens = 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = [fs.open_output_stream(f"{root}/{k}-{name}.bin") for k in ("tokens", "offsets", "ids")]
                out[1].write(np.zeros(1, "<i8").tobytes())
            for part in together(batch, 1):
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                coded = [ids + end for ids in enc.encode(texts)]
                counts = np.array([len(c) // 4 for c in coded], "<i8")
                blob = b"".join(coded)
                if width == 16:
                    ids = np.frombuffer(blob, "<u4")
                    if ids.max() > 65535:
                        raise ValueError("an id is over 65535: write with width=32")
                    blob = ids.astype(kind).tobytes()
                out[0].write(blob)
                out[1].write((np.cumsum(counts) + tokens).astype("<i8").tobytes())
                keys = np.zeros(len(coded), [("id", "<i8"), ("set", "u1")])
                keys["set"] = [x.is_valid for x in part.column(0)]
                keys["id"] = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                out[2].write(keys.tobytes())
                docs += len(coded)
                tokens += int(counts.sum())
        if out is not None:
            for f in out:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "docs": [docs], "tokens": [tokens]})

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    # a row per task; tasks are as many as the shuffle has partitions
    shards = sorted(ordered.select("doc_id", "text").mapInArrow(tidy(run), _SHARD).collect())
    base, index = 0, []
    for s in shards:
        index.append({"name": s["name"], "docs": s["docs"], "tokens": s["tokens"], "base": base})
        base += s["tokens"]
    with fs.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps({"width": width, "tokens": base, "shards": index}).encode())
    return folder


def read_index(folder: str) -> dict:
    fs, root = _store(plain_uri(folder))
    with fs.open_input_stream(f"{root}/index.json") as f:
        return json.loads(f.read())


def _opened(fs, path: str, kind) -> tuple[Callable[[int, int], np.ndarray], int]:
    """The file as a function from first and end to an array, and its length: mapped if the file system is a mounted one, else read by range."""
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(path, kind, "r")
        return lambda a, b: whole[a:b], len(whole)
    f, width = fs.open_input_file(path), np.dtype(kind).itemsize
    return lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), kind), f.size() // width


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """The documents of a folder: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    A shard is a task, which holds no more than the documents it is at.
    """
    folder, index = plain_uri(folder), read_index(folder)
    kind = {16: "<u2", 32: "<u4"}[index["width"]]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                tokens, _ = _opened(fs, f"{root}/tokens-{shard['name']}.bin", kind)
                offsets, _ = _opened(fs, f"{root}/offsets-{shard['name']}.bin", "<i8")
                keys, n = _opened(fs, f"{root}/ids-{shard['name']}.bin", [("id", "<i8"), ("set", "u1")])
                for i in range(0, n, _STEP):
                    k = keys(i, min(n, i + _STEP))
                    o = np.asarray(offsets(i, i + len(k) + 1))
                    every = tokens(int(o[0]), int(o[-1]))
                    own = [every[a:b] for a, b in zip(o[:-1] - o[0], o[1:] - o[0])]
                    out = {
                        "doc_id": pa.array(np.asarray(k["id"]), pa.int64(), mask=np.asarray(k["set"]) == 0),
                        "start": pa.array(o[:-1] + shard["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(o), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([x.astype("i8") for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    shards = index["shards"]
    rows = spark.createDataFrame([(s["name"], s["base"]) for s in shards], "name string, base long")
    return rows.repartition(max(1, len(shards))).mapInArrow(run, schema)
