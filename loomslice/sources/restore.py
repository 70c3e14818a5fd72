"""Restoring slices into catalog tables: staged, checked, then published in the order of references."""

from __future__ import annotations

from functools import partial

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomslice.operators.rows import high_water, orphans
from loomslice.plans.graph import SchemaGraph
from loomslice.sources.archive import SliceReader
from loomslice.storage import written


class RestoreError(RuntimeError):
    pass


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _understood(spark: SparkSession, statement: str) -> bool:
    """Whether a statement is in Spark's dialect."""
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException:
        return False
    return True


def restore(spark: SparkSession, graph: SchemaGraph, folder: str, *, names: dict[str, str] | None = None, check: bool = True, include_schema: bool = False, sequence_table: str | None = None) -> list[str]:
    """Append a slice's rows to catalog tables (by default each one's name); returns them in loading order.

    Rows are staged and references checked against the staged and the present rows before any table changes.
    A cycle of references needs a deferrable one. check=False leaves the check out. include_schema creates
    tables that are missing, with the column types that the slice's manifest has, and runs those of the slice's
    statements before and after that are Spark's; definitions in another dialect are for other databases.
    Tables are appended to one after the other: a failure of the storage midway leaves the earlier ones' rows.
    """
    reader = SliceReader(spark, folder)
    order = graph.load_order(reader.manifest["tables"])
    name = {t: (names or {}).get(t, graph.tables[t].name) for t in order}
    if include_schema:
        for s in filter(partial(_understood, spark), reader.statements("pre-data")):
            spark.sql(s)
        for t in order:
            m = reader.manifest["tables"][t]
            if "types" in m and not spark.catalog.tableExists(name[t]):
                columns = StructType.fromDDL(", ".join(f"{quoted(c)} {kind}" for c, kind in zip(m["columns"], m["types"])))
                spark.createDataFrame([], columns).write.saveAsTable(name[t])
    staged: dict[str, DataFrame] = {}
    for t in order:
        if not spark.catalog.tableExists(name[t]):
            raise RestoreError(f"there is no table {name[t]}")
        schema = spark.table(name[t]).select(*[f"`{c}`" for c in reader.manifest["tables"][t]["columns"]]).schema
        staged[t] = written(reader.table(t, schema), "staged")
    if check:
        for r in graph.references.values():
            if r.table in staged:
                there = name.get(r.to_table) or (names or {}).get(r.to_table, graph.tables[r.to_table].name)
                columns = [quoted(c) for c in r.to_columns]
                if r.to_table not in staged and not spark.catalog.tableExists(there):
                    raise RestoreError(f"reference {r.id}: there is no table {there}")
                parent = spark.table(there).select(*columns)
                if r.to_table in staged:
                    parent = parent.unionByName(staged[r.to_table].select(*columns))
                if not orphans(staged[r.table], parent, list(r.columns), list(r.to_columns)).isEmpty():
                    raise RestoreError(f"reference {r.id} has rows without a parent")
    for t in order:
        missing = [c for c in spark.table(name[t]).columns if c not in staged[t].columns]
        rows = staged[t].withColumns({c: F.lit(None) for c in missing}) if missing else staged[t]
        rows.select(*[f"`{c}`" for c in spark.table(name[t]).columns]).write.insertInto(name[t])
    if sequence_table and reader.manifest["sequences"]:
        dumped = spark.createDataFrame([(s, reader.sequence(s)) for s in reader.manifest["sequences"]], "id string, last_value long")
        written(high_water(spark.table(sequence_table), dumped), "sequences").write.mode("overwrite").insertInto(sequence_table)
    if include_schema:
        for s in filter(partial(_understood, spark), reader.statements("post-data")):
            spark.sql(s)
    return order
