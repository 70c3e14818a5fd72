"""Slices as folders of text segments with a manifest, or packed as one ZIP file.

Spark writes a table's segments in parallel under ``<table>/``; the manifest lists them with their row
counts. ``pack`` puts a folder into a ZIP with the layout ``manifest.json``, ``<table>/<n>.tsv``,
``<sequence>.txt``, ``<section>/<n>.sql``, numbered from 1; ``unpack`` does the reverse.
"""

from __future__ import annotations

import json
import shutil
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomslice.plans.graph import SchemaGraph
from loomslice.sources.copytext import decode_rows, encode_rows

#: Rows of a segment at most.
SEGMENT_ROWS = 50_000


def write_slice(graph: SchemaGraph, tables: dict[str, DataFrame], folder: str, *, sequences: dict[str, int] | None = None, pre: list[str] = (), post: list[str] = ()) -> dict:
    """Write segments, sequences and schema statements; returns the manifest, which is written last."""
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    manifest = {"preData": {"count": len(pre)}, "postData": {"count": len(post)}, "sequences": {}, "tables": {}}
    for t, df in sorted(tables.items()):
        own = f"{folder.rstrip('/')}/{t}"
        encode_rows(df).write.option("lineSep", "\n").option("maxRecordsPerFile", SEGMENT_ROWS).text(own)
        # a row per file comes back
        lines = spark.read.option("lineSep", "\n").text(own).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).orderBy("file").collect()
        table = graph.tables[t]
        manifest["tables"][t] = {"columns": df.columns, "name": table.name, "schema": table.schema, "types": [f.dataType.simpleString() for f in df.schema], "segments": [{"rowCount": r["n"]} for r in lines], "files": [r["file"].rsplit("/", 1)[1] for r in lines]}
    texts = {f"{s}.txt": str(v) for s, v in (sequences or {}).items()}
    for s in sequences or {}:
        manifest["sequences"][s] = {"name": graph.sequences[s].name, "schema": graph.sequences[s].schema}
    texts |= {f"{section}/{i}.sql": x for section, xs in (("pre-data", pre), ("post-data", post)) for i, x in enumerate(xs, 1)}
    for name, text in texts.items():
        _put(spark, f"{folder.rstrip('/')}/{name}", text)
    _put(spark, f"{folder.rstrip('/')}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    stream.close()
    return text


class SliceReader:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifest = json.loads(_get(spark, f"{self.folder}/manifest.json"))

    def table(self, t: str, schema: StructType | None = None) -> DataFrame:
        """A table's rows, as text or in the schema's types."""
        m = self.manifest["tables"][t]
        if not m["segments"]:
            empty = schema or StructType.fromDDL(", ".join(f"`{c}` string" for c in m["columns"]))
            return self.spark.createDataFrame([], empty)
        lines = self.spark.read.option("lineSep", "\n").text([f"{self.folder}/{t}/{f}" for f in m["files"]])
        return decode_rows(lines, m["columns"], schema)

    def sequence(self, s: str) -> int:
        return int(_get(self.spark, f"{self.folder}/{s}.txt"))

    def statements(self, section: str) -> list[str]:
        n = self.manifest["preData" if section == "pre-data" else "postData"]["count"]
        return [_get(self.spark, f"{self.folder}/{section}/{i}.sql") for i in range(1, n + 1)]


def pack(folder: str, target: str) -> None:
    """A local or mounted slice folder as a ZIP file."""
    root = Path(folder.removeprefix("file://"))
    manifest = json.loads((root / "manifest.json").read_text())
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for t, m in sorted(manifest["tables"].items()):
            for i, f in enumerate(m["files"], 1):
                z.write(root / t / f, f"{t}/{i}.tsv")
            m["files"] = [f"{i}.tsv" for i in range(1, len(m["files"]) + 1)]
        for f in sorted([*root.glob("*.txt"), *root.glob("p*-data/*.sql")]):
            z.write(f, str(f.relative_to(root)))
        z.writestr("manifest.json", json.dumps(manifest, sort_keys=True))


def unpack(source: str, folder: str) -> str:
    """A ZIP file as a slice folder; archives whose manifests don't name files are read by number."""
    root = Path(folder.removeprefix("file://"))
    root.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(source) as z:
        manifest = json.loads(z.read("manifest.json"))
        for t, m in manifest["tables"].items():
            m["files"] = [f"{i}.tsv" for i in range(1, len(m["segments"]) + 1)]
        for name in z.namelist():
            if name != "manifest.json" and not name.endswith("/"):
                at = (root / name).resolve()
                if not at.is_relative_to(root.resolve()):
                    raise ValueError(f"{name} lies outside the archive")
                at.parent.mkdir(parents=True, exist_ok=True)
                with z.open(name) as src, at.open("wb") as out:
                    shutil.copyfileobj(src, out)
    (root / "manifest.json").write_text(json.dumps(manifest, sort_keys=True))
    return folder
