"""Helpers that tests import by name."""


def rows(df, *cols):
    """Sorted tuples of the columns named (by default all), nulls first."""
    got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(got, key=lambda t: [(x is not None, x) for x in t])
