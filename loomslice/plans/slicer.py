"""Slices: the rows that references reach from root rows.

A row is known by the state it was reached in: its table and the last step (a reference and a direction).
A step may not be undone at once: rows reached over a reference don't go back over it. States form an
automaton as small as the schema. If it has no cycle, a slice is one lazy plan of semi-joins; else rounds
of semi-joins run until they find no new rows, each round's findings being written to the shared folder.
Rows never come to the driver.

By default (arrival="all") a row expands from every state it is reached in, which doesn't depend on any
order. With arrival="first" it expands only from the state it is reached in first, level by level, ties
going to the forward direction and then the reference's id, which gives smaller slices.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomslice.operators.rows import ROW_ID, keys_match
from loomslice.plans.graph import Direction, Root, SchemaError, SchemaGraph
from loomslice.storage import written

State = tuple[str, tuple[str, Direction] | None]
#: Rounds whose findings stay tables of their own before they are written as one.
_ROUNDS = 8


@dataclass(frozen=True)
class Step:
    source: State
    target: State
    reference: str
    direction: Direction


def automaton(graph: SchemaGraph, roots: list[Root]) -> list[Step]:
    """Every step that the roots can lead to."""
    steps, seen, todo = [], set(), []
    for r in roots:
        if r.table not in graph.tables:
            raise SchemaError(f"root: there is no table {r.table}")
        todo.append((r.table, None))
    while todo:
        state = todo.pop(0)
        if state in seen:
            continue
        seen.add(state)
        table, via = state
        for d in (Direction.FORWARD, Direction.REVERSE):
            for k in sorted(graph.references):
                ref = graph.references[k]
                if d in ref.directions and ref.side(d)[0] == table and via != (k, d.opposite):
                    target = (ref.side(d)[2], (k, d))
                    steps.append(Step(state, target, k, d))
                    todo.append(target)
    return steps


def topological(steps: list[Step], roots: list[Root]) -> list[State] | None:
    """The states so that steps lead onward only, or None if they can't."""
    into: dict[State, set[State]] = defaultdict(set)
    states = {(r.table, None) for r in roots}
    for s in steps:
        into[s.target].add(s.source)
        states |= {s.source, s.target}
    out: list[State] = []
    left = sorted(states, key=str)
    while left:
        ready = [s for s in left if into[s] <= set(out)]
        if not ready:
            return None
        out += ready
        left = [s for s in left if s not in ready]
    return out


class Slicer:
    """tables: a DataFrame by table id. keys: columns that tell a table's rows apart; by default the row id of
    ``operators.rows.scan``. Without either, rows are known by all their columns, which must be comparable then
    (no maps); repeated rows are reached together and all stay."""

    def __init__(self, graph: SchemaGraph, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None):
        self.graph, self.tables = graph, tables
        if missing := sorted(set(graph.tables) - set(tables)):
            raise SchemaError("no data for " + ", ".join(missing))
        self.keys = {t: list((keys or {}).get(t) or ([ROW_ID] if ROW_ID in df.columns else df.columns)) for t, df in tables.items()}

    def _roots(self, roots: list[Root]) -> dict[State, DataFrame]:
        """Roots of a table are one scan with alternatives."""
        by: dict[str, list[str]] = defaultdict(list)
        for r in roots:
            by[r.table].append(re.sub(r"\s*where(?=[\s(])", "", r.condition, count=1, flags=re.I) if re.match(r"\s*where[\s(]", r.condition, re.I) else r.condition)
        return {(t, None): self.tables[t].where(" OR ".join(f"({c})" for c in cs)) for t, cs in by.items()}

    def _step(self, step: Step, source: DataFrame, target: DataFrame) -> DataFrame:
        ref = self.graph.references[step.reference]
        _, ours, _, theirs = ref.side(step.direction)
        left = source.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(ours)])
        return target.join(left, keys_match(target, left, list(theirs), left.columns), "left_semi")

    def _one_each(self, table: str, parts: list[DataFrame]) -> DataFrame:
        if len(parts) == 1:
            return parts[0]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        if self.keys[table] != self.tables[table].columns:
            return df.dropDuplicates(self.keys[table])
        # rows have no identity: equal ones are reached together, and stay as many as they are
        return self._own(table, df.dropDuplicates())

    def _own(self, table: str, ids: DataFrame) -> DataFrame:
        """The table's rows whose keys are among ids."""
        own, keys = self.tables[table], self.keys[table]
        ids = ids.select(*[F.col(f"`{c}`").alias(f"_s{i}") for i, c in enumerate(keys)])
        return own.join(ids, [own[f"`{c}`"].eqNullSafe(ids[f"_s{i}"]) for i, c in enumerate(keys)], "left_semi")

    def run(self, roots: list[Root], *, arrival: str = "all", columns: bool = True) -> dict[str, DataFrame]:
        """The slice's rows by table; tables that can't be reached are left out.

        columns: only the columns that the schema lists, in its order.
        """
        if arrival not in ("all", "first"):
            raise ValueError("arrival is all or first")
        steps = automaton(self.graph, roots)
        order = topological(steps, roots)
        found = self._static(steps, order, roots) if order is not None and arrival == "all" else self._loop(steps, roots, arrival)
        return {t: df.select(*[f"`{c}`" for c in self.graph.tables[t].columns]) if columns else df for t, df in found.items()}

    def _static(self, steps: list[Step], order: list[State], roots: list[Root]) -> dict[str, DataFrame]:
        rows, begin = {}, self._roots(roots)
        for state in order:
            table = state[0]
            parts = [self._step(s, rows[s.source], self.tables[table]) for s in steps if s.target == state]
            rows[state] = self._one_each(table, ([begin[state]] if state in begin else []) + parts)
        by: dict[str, list[DataFrame]] = defaultdict(list)
        for state, df in rows.items():
            by[state[0]].append(df)
        return {t: self._one_each(t, parts) for t, parts in sorted(by.items())}

    def _loop(self, steps: list[Step], roots: list[Root], arrival: str) -> dict[str, DataFrame]:
        # identities and the columns that references use are all that the rounds carry
        need = {t: list(dict.fromkeys([*self.keys[t], *[c for r in self.graph.references.values() for x, cs in ((r.table, r.columns), (r.to_table, r.to_columns)) if x == t for c in cs]])) for t in self.tables}
        narrow = {t: df.select(*[f"`{c}`" for c in need[t]]) for t, df in self.tables.items()}
        spot = (lambda s: s) if arrival == "all" else (lambda s: s[0])  # what a row expands once for
        seen: dict[object, list[DataFrame]] = defaultdict(list)
        fresh: dict[State, DataFrame] = {}
        for state, df in self._roots(roots).items():
            first = written(df.select(*[f"`{c}`" for c in need[state[0]]]).dropDuplicates(self.keys[state[0]]), "round")
            if not first.isEmpty():
                fresh[state] = first
                seen[spot(state)].append(first)
        rank = {s.target: (i, s) for i, s in enumerate(sorted(steps, key=lambda s: (s.direction.value, s.reference)))}
        while fresh:
            parts: dict[State, list[DataFrame]] = defaultdict(list)
            for s in steps:
                if s.source in fresh:
                    parts[s.target].append(self._step(s, fresh[s.source], narrow[s.target[0]]))
            fresh = {}
            for state in sorted(parts, key=lambda s: rank[s][0]):
                t = state[0]
                new = self._one_each(t, [p.dropDuplicates(self.keys[t]) for p in parts[state]])
                for old in seen[spot(state)]:
                    ids = old.select(*[F.col(f"`{c}`").alias(f"_s{i}") for i, c in enumerate(self.keys[t])])
                    on = [new[f"`{c}`"].eqNullSafe(ids[f"_s{i}"]) for i, c in enumerate(self.keys[t])]
                    new = new.join(ids, on, "left_anti")
                new = written(new, "round")
                if not new.isEmpty():
                    fresh[state] = new
                    own = seen[spot(state)]
                    own.append(new)
                    if len(own) > _ROUNDS:  # else each round would plan a join with every one before it
                        whole = own[0]
                        for d in own[1:]:
                            whole = whole.unionByName(d)
                        own[:] = [written(whole, "seen")]
        by: dict[str, list[DataFrame]] = defaultdict(list)
        for at, dfs in seen.items():
            by[at if isinstance(at, str) else at[0]] += dfs
        out = {}
        for t, dfs in sorted(by.items()):
            ids = dfs[0].select(*[f"`{c}`" for c in self.keys[t]])
            for d in dfs[1:]:
                ids = ids.unionByName(d.select(*[f"`{c}`" for c in self.keys[t]]))
            out[t] = self._own(t, ids)
        return out
