"""A small JSONPath: $, .name, ['name'], [i], [*], .* and ..name."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

_STEP = re.compile(r"\.\.(?P<deep>[\w-]+|\*)|\.(?P<name>[\w-]+|\*)|\[(?P<at>-?\d+|\*)\]|\[(?P<q>['\"])(?P<quoted>.*?)(?P=q)\]")


def parse(path: str) -> list[tuple[str, object]]:
    rest, steps = path.removeprefix("$"), []
    if rest and rest[0] not in ".[":
        rest = "." + rest
    while rest:
        m = _STEP.match(rest)
        if not m:
            raise ValueError(f"JSON path {path!r}: can't read {rest!r}")
        if m["deep"]:
            steps.append(("deep", m["deep"]))
        elif m["quoted"] is not None:
            steps.append(("key", m["quoted"]))
        elif m["at"]:
            steps.append(("all", None) if m["at"] == "*" else ("index", int(m["at"])))
        else:
            steps.append(("all", None) if m["name"] == "*" else ("key", m["name"]))
        rest = rest[m.end() :]
    return steps


def find(doc: object, steps: list[tuple[str, object]]) -> list[tuple[object, object]]:
    """(container, key) of every match; the document itself has the container None."""
    found: list[tuple[object, object, object]] = [(None, None, doc)]
    for kind, what in steps:
        after = []
        for _, _, v in found:
            stack = [v]
            while stack:
                x = stack.pop(0)
                items = list(x.items()) if isinstance(x, dict) else list(enumerate(x)) if isinstance(x, list) else []
                if kind == "index":
                    items = [(k, y) for k, y in items if isinstance(x, list) and k == (what if what >= 0 else len(x) + what)]
                hit = [(x, k, y) for k, y in items if kind in ("all", "index") or what == "*" or k == what]
                after += hit
                if kind == "deep":
                    stack += [y for _, y in items]
        found = after
    return [(c, k) for c, k, _ in found]


def updater(rules: list[tuple[str, Callable]]) -> Callable[[str | None], str | None]:
    """Text to text: strings and nulls that a path matches go through its function; all are found before any changes."""
    parsed = [(parse(p), f) for p, f in rules]

    def update(text: str | None) -> str | None:
        if text is None:
            return None
        box = [json.loads(text)]
        hits = [(c if c is not None else box, k if c is not None else 0, f) for steps, f in parsed for c, k in find(box[0], steps)]
        for c, k, f in hits:
            if c[k] is None or isinstance(c[k], str):
                c[k] = f(c[k])
        return json.dumps(box[0], separators=(",", ":"))

    return update
