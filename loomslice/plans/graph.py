"""Tables and the references between them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from enum import Enum


class SchemaError(ValueError):
    pass


class CycleError(SchemaError):
    pass


class Direction(str, Enum):
    FORWARD = "forward"  # from the table that refers to the one that is referred to
    REVERSE = "reverse"

    @property
    def opposite(self) -> Direction:
        return Direction.REVERSE if self is Direction.FORWARD else Direction.FORWARD


BOTH = frozenset(Direction)


@dataclass(frozen=True)
class Reference:
    id: str
    table: str
    columns: tuple[str, ...]
    to_table: str
    to_columns: tuple[str, ...]
    directions: frozenset[Direction] = BOTH
    deferrable: bool = False

    def side(self, d: Direction) -> tuple[str, tuple[str, ...], str, tuple[str, ...]]:
        """(source table, its columns, target table, its columns) when walked in a direction."""
        own, other = (self.table, self.columns), (self.to_table, self.to_columns)
        return (*own, *other) if d is Direction.FORWARD else (*other, *own)


@dataclass(frozen=True)
class Table:
    id: str
    name: str
    columns: tuple[str, ...]
    schema: str = ""
    sequences: tuple[str, ...] = ()


@dataclass(frozen=True)
class Sequence:
    id: str
    name: str
    schema: str = ""


@dataclass(frozen=True)
class Root:
    table: str
    condition: str


@dataclass
class SchemaGraph:
    tables: dict[str, Table]
    references: dict[str, Reference] = field(default_factory=dict)
    sequences: dict[str, Sequence] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for r in self.references.values():
            for t, columns in ((r.table, r.columns), (r.to_table, r.to_columns)):
                if t not in self.tables:
                    raise SchemaError(f"reference {r.id}: there is no table {t}")
            if len(r.columns) != len(r.to_columns) or not r.columns:
                raise SchemaError(f"reference {r.id}: {len(r.columns)} columns refer to {len(r.to_columns)}")
        for t in self.tables.values():
            for s in t.sequences:
                if s not in self.sequences:
                    raise SchemaError(f"table {t.id}: there is no sequence {s}")

    @classmethod
    def from_json(cls, config: dict | str) -> SchemaGraph:
        """From the configuration's form: references, sequences and tables by id. Keys it doesn't know are ignored."""
        c = json.loads(config) if isinstance(config, str) else config

        def need(kind: str, key: str, x: dict, *names: str) -> list:
            if not isinstance(x, dict):
                raise SchemaError(f"{kind} {key} isn't an object")
            if missing := [n for n in names if n not in x]:
                raise SchemaError(f"{kind} {key} lacks {', '.join(missing)}")
            return [x[n] for n in names]

        tables, refs, seqs = {}, {}, {}
        for k, x in (c.get("tables") or {}).items():
            name, columns = need("table", k, x, "name", "columns")
            tables[k] = Table(k, name, tuple(columns), x.get("schema", ""), tuple(x.get("sequences") or ()))
        for k, x in (c.get("references") or {}).items():
            table, columns, to, to_columns = need("reference", k, x, "table", "columns", "referenceTable", "referenceColumns")
            try:
                ways = frozenset(Direction(d) for d in x.get("directions", BOTH))
            except ValueError as e:
                raise SchemaError(f"reference {k}: {e}") from e
            refs[k] = Reference(k, table, tuple(columns), to, tuple(to_columns), ways, bool(x.get("deferrable", False)))
        for k, x in (c.get("sequences") or {}).items():
            (name,) = need("sequence", k, x, "name")
            seqs[k] = Sequence(k, name, x.get("schema", ""))
        return cls(tables, refs, seqs)

    def to_json(self) -> dict:
        refs = {r.id: {"table": r.table, "columns": list(r.columns), "referenceTable": r.to_table, "referenceColumns": list(r.to_columns), "directions": sorted(d.value for d in r.directions)} | ({"deferrable": True} if r.deferrable else {}) for r in self.references.values()}
        return {
            "references": refs,
            "sequences": {s.id: {"schema": s.schema, "name": s.name} for s in self.sequences.values()},
            "tables": {t.id: {"schema": t.schema, "name": t.name, "columns": list(t.columns), "sequences": list(t.sequences)} for t in self.tables.values()},
        }

    def children(self, tables: Iterable[str]) -> SchemaGraph:
        """The graph in which rows of the tables and of all that refers to them bring in no children of rows outside."""
        inside, todo = set(), list(tables)
        while todo:
            t = todo.pop()
            if t not in self.tables:
                raise SchemaError(f"there is no table {t}")
            if t not in inside:
                inside.add(t)
                todo += [r.table for r in self.references.values() if r.to_table == t and Direction.REVERSE in r.directions]
        cut = {k: replace(r, directions=r.directions - {Direction.REVERSE}) if r.table in inside and r.to_table not in inside else r for k, r in self.references.items()}
        return SchemaGraph(dict(self.tables), cut, dict(self.sequences))

    def load_order(self, tables: Iterable[str] | None = None) -> list[str]:
        """Tables so that each comes after those it refers to, but for deferrable references; else CycleError."""
        left = sorted(self.tables if tables is None else tables)
        parents = {t: {r.to_table for r in self.references.values() if r.table == t and not r.deferrable and r.to_table in left} for t in left}
        out: list[str] = []
        while left:
            ready = [t for t in left if parents[t] <= set(out)]
            if not ready:
                raise CycleError("references without a deferrable one form a cycle among " + ", ".join(left))
            out += ready
            left = [t for t in left if t not in out]
        return out
