"""Schemas of tables: from Spark's catalog, from data, or from PostgreSQL over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomslice.operators.rows import orphans
from loomslice.plans.graph import Reference, SchemaGraph, Sequence, Table

#: Foreign keys with their columns in order, for a JDBC reader's query option.
PG_REFERENCES = """
SELECT c.conname, cn.nspname AS from_schema, ct.relname AS from_table, pn.nspname AS to_schema, pt.relname AS to_table, c.condeferrable,
  ARRAY(SELECT a.attname::text FROM unnest(c.conkey) WITH ORDINALITY k(n, i) JOIN pg_attribute a ON a.attrelid = c.conrelid AND a.attnum = k.n ORDER BY k.i) AS from_columns,
  ARRAY(SELECT a.attname::text FROM unnest(c.confkey) WITH ORDINALITY k(n, i) JOIN pg_attribute a ON a.attrelid = c.confrelid AND a.attnum = k.n ORDER BY k.i) AS to_columns
FROM pg_constraint c JOIN pg_class ct ON ct.oid = c.conrelid JOIN pg_namespace cn ON cn.oid = ct.relnamespace
  JOIN pg_class pt ON pt.oid = c.confrelid JOIN pg_namespace pn ON pn.oid = pt.relnamespace
WHERE c.contype = 'f'
"""

#: Ordinary tables and their columns.
PG_COLUMNS = """
SELECT n.nspname AS schema, c.relname AS name, a.attname AS "column", a.attnum AS position
FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum > 0 AND NOT a.attisdropped
WHERE c.relkind IN ('r', 'p') AND n.nspname NOT IN ('pg_catalog', 'information_schema')
"""
#: Sequences and the tables that own them.
PG_SEQUENCES = """
SELECT n.nspname AS schema, s.relname AS name, tn.nspname AS owner_schema, t.relname AS owner_table
FROM pg_class s JOIN pg_namespace n ON n.oid = s.relnamespace
  LEFT JOIN pg_depend d ON d.objid = s.oid AND d.classid = 'pg_class'::regclass AND d.refclassid = 'pg_class'::regclass AND d.deptype IN ('a', 'i')
  LEFT JOIN pg_class t ON t.oid = d.refobjid LEFT JOIN pg_namespace tn ON tn.oid = t.relnamespace
WHERE s.relkind = 'S'
"""


def from_catalog(spark: SparkSession, database: str | None = None) -> SchemaGraph:
    """The catalog's tables; Spark keeps no references, so there are none."""
    found = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    return SchemaGraph({t: Table(t, t, tuple(c.name for c in spark.catalog.listColumns(f"{database}.{t}" if database else t)), database or "") for t in found})


def from_frames(tables: dict[str, DataFrame]) -> SchemaGraph:
    return SchemaGraph({t: Table(t, t, tuple(df.columns)) for t, df in tables.items()})


def with_pg_references(graph: SchemaGraph, rows: DataFrame) -> SchemaGraph:
    """The graph with the foreign keys that PG_REFERENCES returned; tables are known by schema.table."""
    refs = {}
    for r in rows.collect():  # a row per foreign key
        a, b = f"{r['from_schema']}.{r['from_table']}", f"{r['to_schema']}.{r['to_table']}"
        if a in graph.tables and b in graph.tables:
            refs[f"{a}.{r['conname']}"] = Reference(f"{a}.{r['conname']}", a, tuple(r["from_columns"]), b, tuple(r["to_columns"]), deferrable=bool(r["condeferrable"]))
    return SchemaGraph(dict(graph.tables), {**graph.references, **refs}, dict(graph.sequences))


def pg_schema(references: DataFrame, columns: DataFrame, sequences: DataFrame) -> SchemaGraph:
    """A schema from what PG_REFERENCES, PG_COLUMNS and PG_SEQUENCES returned; tables and sequences are known by schema.name.

    Tables without columns have one row with a null column.
    """
    owned: dict[str, list[str]] = {}
    seqs = {}
    for r in sequences.collect():  # a row per sequence
        s = f"{r['schema']}.{r['name']}"
        seqs[s] = Sequence(s, r["name"], r["schema"])
        if r["owner_table"] is not None:
            owned.setdefault(f"{r['owner_schema']}.{r['owner_table']}", []).append(s)
    listed: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for r in columns.collect():  # a row per column
        own = listed.setdefault((r["schema"], r["name"]), [])
        if r["column"] is not None:
            own.append((r["position"], r["column"]))
    tables = {f"{a}.{b}": Table(f"{a}.{b}", b, tuple(c for _, c in sorted(cs)), a, tuple(sorted(owned.get(f"{a}.{b}", [])))) for (a, b), cs in sorted(listed.items())}
    return with_pg_references(SchemaGraph(tables, {}, seqs), references)


def sequence_values(graph: SchemaGraph, tables: dict[str, DataFrame]) -> dict[str, int]:
    """The last value that each sequence has given, as the whole tables show it: the greatest in the column that the sequence is named for.

    A sequence is named as serial columns name theirs, <table>_<column>_seq. One that isn't, or whose column
    has no values yet, is left out.
    """
    out = {}
    for t, table in graph.tables.items():
        for s in table.sequences:
            name = graph.sequences[s].name
            column = next((c for c in table.columns if name == f"{table.name}_{c}_seq"), None)
            if column and t in tables and (last := tables[t].agg(F.max(F.col(f"`{column}`").cast("long"))).first()[0]) is not None:
                out[s] = last
    return out


def infer_reference(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> bool:
    """Whether the parent's column is unique and holds all of the child's values."""
    twice = parent.groupBy(F.col(parent_column)).agg(F.count("*").alias("n")).where("n > 1 or " + f"`{parent_column}` is null")
    return twice.isEmpty() and orphans(child, parent, [column], [parent_column]).isEmpty()


def row_estimates(spark: SparkSession, names: list[str]) -> dict[str, int]:
    """Rows by table from statistics where there are any, else counted."""
    out = {}
    for n in names:
        stats = spark._jsparkSession.table(n).queryExecution().optimizedPlan().stats().rowCount()
        out[n] = int(stats.get().toString()) if stats.isDefined() else spark.table(n).count()
    return out
