"""Helpers that several test files import (a module of its own, since every ``conftest.py`` has the same module name)."""


def rows(df, *cols):
    """Collected rows as sorted tuples (None sorts first)."""
    sel = df.select(*cols) if cols else df
    key = lambda t: tuple((v is not None, v) for v in t)
    return sorted((tuple(r) for r in sel.collect()), key=key)
