"""Transforms by configuration: named instances of classes, linked by name, applied to tables.

A configuration is ``{"transforms": {name: {"class", "module"?, "config"?}}, "tables": {id: {"columns":
{column: name}}}}``. Built-in classes have a native form, a Spark expression, and a compat one, a function
of one value in a pandas UDF. A class of another module is looked up by name: an object with
``column(col, key, config)`` that gives a Column, or ``value(text, key, config)`` that gives a string.
A transform's key is the pepper followed by its name; neither is logged.
"""

from __future__ import annotations

import importlib
import json
import secrets
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomslice.operators.numbering import running_count

from . import compat, jsonpath, lexicon, native


class TransformError(ValueError):
    pass


_SIMPLE = {
    "AddressLine1Transform": "address_line1", "AddressLine2Transform": "address_line2", "CityTransform": "city", "GeozipTransform": "geozip", "GivenNameTransform": "given_name",
    "SurnameTransform": "surname", "WordTransform": "words", "DateYearTransform": "date_year",
}
#: Classes that draw from a list, which ``{"file": path}`` replaces.
_LISTED = ("AddressLine1Transform", "CityTransform", "GeozipTransform", "GivenNameTransform", "SurnameTransform", "WordTransform", "UsStateTransform")
_OTHERS = ("UsStateTransform", "AlphanumericTransform", "ConstTransform", "ReplaceTransform", "IncrementingConstTransform", "NullTransform", "JsonPathTransform", "ComposeTransform")
CLASSES = (*_SIMPLE, *_OTHERS)


@dataclass
class Instance:
    name: str
    kind: str
    module: str | None = None
    config: object = None


@dataclass
class Transforms:
    """instances by name; pepper; mode: native or compat."""

    instances: dict[str, Instance]
    pepper: str = field(default="", repr=False)
    mode: str = "native"
    tables: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def load(cls, config: dict | str, *, pepper: str | None = None, mode: str = "native") -> Transforms:
        """Without a pepper, one is drawn for this run."""
        config = json.loads(config) if isinstance(config, str) else config
        named = {}
        for name, c in (config.get("transforms") or {}).items():
            if not isinstance(c, dict) or "class" not in c:
                raise TransformError(f"transform {name!r} has no class")
            if not c.get("module") and c["class"] not in CLASSES:
                raise TransformError(f"transform {name!r}: no class {c['class']!r}")
            named[name] = Instance(name, c["class"], c.get("module"), c.get("config"))
        tables = {t: dict(c.get("columns") or {}) for t, c in (config.get("tables") or {}).items()}
        out = cls(named, secrets.token_hex(8) if pepper is None else pepper, mode, tables)
        for name in named:
            out.check(name, ())
        for t, columns in tables.items():
            for c, name in columns.items():
                if name not in named:
                    raise TransformError(f"{t}.{c}: no transform {name!r}")
        return out

    def _linked(self, i: Instance) -> list[str]:
        if i.module:
            return []
        if i.kind == "ComposeTransform":
            return list(i.config or ())
        return [r["transform"] for r in i.config or ()] if i.kind == "JsonPathTransform" else []

    def check(self, name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise TransformError("transforms refer to each other in a circle: " + " > ".join((*above, name)))
        if name not in self.instances:
            raise TransformError(f"no transform {name!r}")
        for other in self._linked(self.instances[name]):
            self.check(other, (*above, name))

    @staticmethod
    def _values(i: Instance) -> tuple[tuple[str, ...], ...]:
        """The list of a configured file, as an argument, if there is one: ``{"file": path}``, a value per line, read by the driver."""
        if not isinstance(i.config, dict) or "file" not in i.config:
            return ()
        if i.kind not in _LISTED:
            raise TransformError(f"transform {i.name!r}: {i.kind} draws from no list")
        values = lexicon.load(i.config["file"])
        if not values:
            raise TransformError(f"transform {i.name!r}: its file has no values")
        return (values,)

    def numbers_rows(self, name: str) -> bool:
        """Whether the transform, or one that it is made of, counts rows."""
        i = self.instances[name]
        return not i.module and (i.kind == "IncrementingConstTransform" or any(map(self.numbers_rows, self._linked(i))))

    def _plug_in(self, i: Instance):
        found = getattr(importlib.import_module(i.module), i.kind, None)
        if found is None:
            raise TransformError(f"transform {i.name!r}: module {i.module} has no {i.kind}")
        return found() if isinstance(found, type) else found

    def value(self, name: str) -> Callable[[str | None], str | None]:
        """The transform as a function of one value, by the compat rules."""
        i, key = self.instances[name], (self.pepper + name).encode()
        c = i.config
        if i.module:
            own = self._plug_in(i)
            return lambda x: own.value(x, key, c)
        if i.kind in _SIMPLE:
            f, values = getattr(compat, _SIMPLE[i.kind]), self._values(i)
            return lambda x: f(x, key, *values)
        if i.kind == "UsStateTransform":
            abbr, values = bool((c or {}).get("abbr")), self._values(i)
            return lambda x: compat.us_state(x, key, abbr, *values)
        if i.kind == "AlphanumericTransform":
            f = compat.alphanumeric_unique if (c or {}).get("unique") else compat.alphanumeric
            own_key = self.pepper.encode() + name.encode()
            return lambda x: f(x, own_key)
        if i.kind == "ConstTransform":
            return lambda x: compat.const(x, key, c)
        if i.kind == "ReplaceTransform":
            return lambda x: compat.replace(x, key, c["old"], c["new"])
        if i.kind == "NullTransform":
            return lambda x: None
        if i.kind == "ComposeTransform":
            steps = [self.value(n) for n in c]

            def run(x):
                for f in steps:
                    x = f(x)
                return x

            return run
        if i.kind == "JsonPathTransform":
            return jsonpath.updater([(r["path"], self.value(r["transform"])) for r in c])
        count = iter(range(1, 1 << 62))
        return lambda x: x if not x or c.get("exclude") is not None and c["exclude"] in x else f"{c['value']} {next(count)}"

    def field(self, name: str, text: str | None) -> str:
        """One value's result, empty for null."""
        out = self.value(name)(text)
        return "" if out is None else out

    def column(self, name: str, col: Column, order: list[str] | None = None) -> Column:
        """The transform as a Column. order: columns that number rows for IncrementingConstTransform."""
        i, key, c = self.instances[name], self.pepper + name, self.instances[name].config
        if i.module:
            own = self._plug_in(i)
            return own.column(col, key, c) if hasattr(own, "column") else self._udf(name)(col)
        if i.kind == "ComposeTransform":
            return native.compose(col, [lambda x, n=n: self.column(n, x, order) for n in c])
        if i.kind == "IncrementingConstTransform":
            return incrementing(col, c["value"], c.get("exclude"), order)
        if self.mode == "compat" or i.kind == "JsonPathTransform" or i.kind == "AlphanumericTransform" and (c or {}).get("unique"):
            return self._udf(name)(col)
        if i.kind in _SIMPLE:
            return getattr(native, _SIMPLE[i.kind])(col, key, *self._values(i))
        if i.kind == "UsStateTransform":
            return native.us_state(col, key, abbr=bool((c or {}).get("abbr")), values=next(iter(self._values(i)), ()))
        if i.kind == "AlphanumericTransform":
            return native.alphanumeric(col, key)
        if i.kind == "ConstTransform":
            return native.const(col, c)
        return native.null(col) if i.kind == "NullTransform" else native.replace(col, c["old"], c["new"])

    def _udf(self, name: str):
        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            f = self.value(name)
            return values.astype(object).where(values.notna(), None).map(f, na_action=None)

        return run

    def apply(self, table: str, df: DataFrame, order: list[str] | None = None) -> DataFrame:
        """The table with its configured columns scrubbed, each cast to text and back; the others untouched."""
        new, numbered = {}, []
        for c, name in self.tables.get(table, {}).items():
            if c not in df.columns:
                raise TransformError(f"{table} has no column {c!r}")
            kind, text, i = df.schema[c].dataType, F.col(f"`{c}`").cast("string"), self.instances[name]
            if not i.module and i.kind == "IncrementingConstTransform":
                numbered.append((c, kind, i.config))
            else:
                new[c] = self.column(name, text, order).cast(kind)
        names = df.columns
        for k, (c, kind, config) in enumerate(numbered):
            if not order:
                raise TransformError("IncrementingConstTransform needs columns to number rows by")
            at, text = f"_number{k}", F.col(f"`{c}`").cast("string")
            df = running_count(df, ~_passed_over(text, config.get("exclude")), order, at)
            new[c] = F.when(_passed_over(text, config.get("exclude")), text).otherwise(F.concat(F.lit(config["value"] + " "), F.col(at).cast("string"))).cast(kind)
        return df.withColumns(new).select(*[f"`{c}`" for c in names]) if new else df


def _passed_over(text: Column, exclude: str | None) -> Column:
    """Rows that aren't counted: null, empty or with the excluded text."""
    plain = text.isNull() | (text == "")
    return plain if exclude is None else plain | F.coalesce(text.contains(exclude), F.lit(False))


def incrementing(col: Column, value: str, exclude: str | None, order: list[str] | None) -> Column:
    """``value k``, k counting the rows that are neither empty nor excluded, in the given order of the table.

    Within an expression the count needs all rows in one task; ``Transforms.apply`` counts by ranges instead.
    """
    if not order:
        raise TransformError("IncrementingConstTransform needs columns to number rows by")
    plain = _passed_over(col, exclude)
    k = F.sum(F.when(plain, 0).otherwise(1)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(plain, col).otherwise(F.concat(F.lit(value + " "), k.cast("string")))
