"""SQL scripts: quoting, statements, table definitions, and slices as scripts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from loomslice.plans.graph import SchemaGraph
from loomslice.sources.copytext import encode_rows

_TOKEN = re.compile(r"--[^\n]*|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|;|[^-'\";]+|.", re.S)


def identifier(name: str, quote: str = '"') -> str:
    return quote + name.replace(quote, quote * 2) + quote


def qualified(schema: str, name: str, quote: str = '"') -> str:
    return ".".join(identifier(x, quote) for x in (schema, name) if x)


def literal(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def statements(script: str) -> Iterator[str]:
    """The statements of a script, without their semicolons; those in comments and quotes don't end one."""
    own = ""
    for m in _TOKEN.finditer(script):
        if m[0] == ";":
            if own.strip():
                yield own.strip()
            own = ""
        else:
            own += m[0]
    if own.strip():
        yield own.strip()


def create_table(schema: str, name: str, columns: StructType) -> str:
    kinds = {"string": "text", "int": "integer", "bigint": "bigint", "double": "double precision", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp", "boolean": "boolean", "date": "date", "float": "real", "binary": "bytea", "smallint": "smallint"}
    cols = ", ".join(f"{identifier(f.name)} {kinds.get(f.dataType.simpleString(), f.dataType.simpleString())}" + ("" if f.nullable else " NOT NULL") for f in columns)
    return f"CREATE TABLE {qualified(schema, name)} ({cols})"


def add_references(graph: SchemaGraph) -> list[str]:
    out = []
    for r in graph.references.values():
        a, b = graph.tables[r.table], graph.tables[r.to_table]
        lists = [", ".join(map(identifier, x)) for x in (r.columns, r.to_columns)]
        out.append(f"ALTER TABLE {qualified(a.schema, a.name)} ADD FOREIGN KEY ({lists[0]}) REFERENCES {qualified(b.schema, b.name)} ({lists[1]})" + " DEFERRABLE" * r.deferrable)
    return out


def write_script(graph: SchemaGraph, tables: dict[str, DataFrame], out: TextIO, *, sequences: dict[str, int] | None = None, pre: list[str] = (), post: list[str] = ()) -> None:
    """A script that loads the slice. Rows stream through the driver a partition at a time, as one file needs one writer."""
    for s in pre:
        out.write(s.rstrip(";") + ";\n")
    for t in [x for x in graph.tables if x in tables]:
        table, df = graph.tables[t], tables[t]
        out.write(f"COPY {qualified(table.schema, table.name)} ({', '.join(map(identifier, df.columns))}) FROM stdin;\n")
        for row in encode_rows(df).toLocalIterator():
            out.write(row[0] + "\n")
        out.write("\\.\n\n")
    for s, v in sorted((sequences or {}).items()):
        name = literal(qualified(graph.sequences[s].schema, graph.sequences[s].name))
        out.write(f"SELECT setval({name}, {v}) FROM {qualified(graph.sequences[s].schema, graph.sequences[s].name)} WHERE last_value < {v};\n")
    for s in post:
        out.write(s.rstrip(";") + ";\n")
