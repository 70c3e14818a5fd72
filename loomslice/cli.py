"""Command line: dump, restore, schema, schema-filter, transform, transform-field. Errors end with a non-zero status."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from loomslice.functions.registry import Transforms
from loomslice.operators import rows
from loomslice.plans.graph import Root, SchemaGraph
from loomslice.plans.slicer import Slicer
from loomslice.sources import archive, introspect, restore, sqlscript


def _text(path: str) -> str:
    return sys.stdin.read() if path == "-" else Path(path).read_text(encoding="utf-8")


def _out(path: str, text: str) -> None:
    if path == "-":
        sys.stdout.write(text)
    else:
        Path(path).write_text(text, encoding="utf-8")


def _spark() -> SparkSession:
    return SparkSession.builder.appName("loomslice").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomslice", fromfile_prefix_chars="@", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("dump", help="write a slice of a folder of Parquet tables")
    d.add_argument("--data", required=True, help="folder with <table>.parquet")
    d.add_argument("-s", "--schema", required=True)
    d.add_argument("-r", "--root", nargs=2, metavar=("TABLE", "CONDITION"), action="append", required=True)
    d.add_argument("-o", "--output", required=True)
    d.add_argument("--output-type", choices=("slice", "zip", "sql"), default="slice")
    d.add_argument("--include-schema", action="store_true")
    d.add_argument("--transform")
    d.add_argument("--pepper")
    d.add_argument("--compat", action="store_true", help="seeded draws by value")
    d.add_argument("--arrival", choices=("all", "first"), default="all")
    r = sub.add_parser("restore", help="append a slice to catalog tables")
    r.add_argument("-i", "--input", required=True)
    r.add_argument("-s", "--schema", required=True)
    r.add_argument("--include-schema", action="store_true")
    r.add_argument("--disable-triggers", action="store_true", help="don't check references")
    c = sub.add_parser("schema", help="the catalog's tables as a schema")
    c.add_argument("--database")
    c.add_argument("-o", "--output", default="-")
    f = sub.add_parser("schema-filter", help="change a schema's references")
    f.add_argument("filter", choices=("children",))
    f.add_argument("tables", nargs="*")
    f.add_argument("-i", "--input", default="-")
    f.add_argument("-o", "--output", default="-")
    t = sub.add_parser("transform", help="scrub a slice that is there already")
    t.add_argument("--transform", required=True)
    t.add_argument("--pepper")
    t.add_argument("-i", "--input", required=True)
    t.add_argument("-s", "--schema", required=True)
    t.add_argument("-o", "--output", required=True)
    v = sub.add_parser("transform-field", help="one value's result")
    v.add_argument("--transforms", required=True, help="JSON of named transforms")
    v.add_argument("--name", default="")
    v.add_argument("--pepper")
    v.add_argument("field")
    return p


def _dump(a) -> None:
    spark, graph = _spark(), SchemaGraph.from_json(_text(a.schema))
    tables = {t: rows.scan(spark, f"{a.data}/{x.name}.parquet") for t, x in graph.tables.items()}
    found = Slicer(graph, tables).run([Root(*r) for r in a.root], arrival=a.arrival)
    if a.transform:
        t = Transforms.load(_text(a.transform), pepper=a.pepper, mode="compat" if a.compat else "native")
        found = {k: t.apply(k, df, df.columns) for k, df in found.items()}
    pre = [sqlscript.create_table(graph.tables[k].schema, graph.tables[k].name, df.schema) for k, df in found.items()] if a.include_schema else []
    post = sqlscript.add_references(graph) if a.include_schema else []
    sequences = introspect.sequence_values(graph, tables)
    if a.output_type == "sql":
        if a.output == "-":
            sqlscript.write_script(graph, found, sys.stdout, sequences=sequences, pre=pre, post=post)
        else:
            with open(a.output, "w", encoding="utf-8") as out:
                sqlscript.write_script(graph, found, out, sequences=sequences, pre=pre, post=post)
    elif a.output == "-":
        raise SystemExit("a slice of files can't be written to the standard output; --output-type sql can")
    else:
        folder = a.output + ".d" if a.output_type == "zip" else a.output
        archive.write_slice(graph, found, folder, sequences=sequences, pre=pre, post=post)
        if a.output_type == "zip":
            archive.pack(folder, a.output)


def _restore(a) -> None:
    folder = archive.unpack(a.input, a.input + ".d") if a.input.endswith(".zip") else a.input
    restore.restore(_spark(), SchemaGraph.from_json(_text(a.schema)), folder, check=not a.disable_triggers, include_schema=a.include_schema)


def _transform(a) -> None:
    graph, reader = SchemaGraph.from_json(_text(a.schema)), archive.SliceReader(_spark(), a.input)
    t = Transforms.load(_text(a.transform), pepper=a.pepper)
    found = {k: t.apply(k, df, df.columns) for k in reader.manifest["tables"] for df in [reader.table(k)]}
    archive.write_slice(graph, found, a.output, sequences={s: reader.sequence(s) for s in reader.manifest["sequences"]}, pre=reader.statements("pre-data"), post=reader.statements("post-data"))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "dump":
        _dump(a)
    elif a.command == "restore":
        _restore(a)
    elif a.command == "schema":
        _out(a.output, json.dumps(introspect.from_catalog(_spark(), a.database).to_json(), indent=2) + "\n")
    elif a.command == "schema-filter":
        _out(a.output, json.dumps(SchemaGraph.from_json(_text(a.input)).children(a.tables).to_json(), indent=2) + "\n")
    elif a.command == "transform":
        _transform(a)
    else:
        config = json.loads(a.transforms)
        print(Transforms.load({"transforms": config}, pepper=a.pepper).field(a.name, a.field))
    return 0


if __name__ == "__main__":
    sys.exit(main())
