"""Column expressions for recoding person-level report records.

All helpers return ``Column`` objects built from ``pyspark.sql.functions``, so
they stay inside whole-stage codegen. NULL plays the role of a missing value;
where the two R idioms the analysis relies on differ in how they treat
missing values, both forms are offered (``ladder`` vs ``ladder_strict``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------- sentinels


def replace_value(col, old, new) -> Column:
    """``ifelse(x == old, new, x)``: one code swapped for another (77 -> 0).

    A NULL input stays NULL, as in R.
    """
    c = _c(col)
    return F.when(c == _lit(old), _lit(new)).otherwise(c)


def null_if(col, sentinel) -> Column:
    """Sentinel code -> missing (99 -> NULL)."""
    c = _c(col)
    return F.when(c == _lit(sentinel), F.lit(None)).otherwise(c)


def null_if_above(col, bound) -> Column:
    """Out-of-range values -> missing (age > 18 -> NULL)."""
    c = _c(col)
    return F.when(c > _lit(bound), F.lit(None)).otherwise(c)


def fill_missing(col, value) -> Column:
    """Missing -> explicit code (NULL -> 99)."""
    return F.coalesce(_c(col), _lit(value))


def equals_flag(col, value) -> Column:
    """Boolean derived by equality; NULL stays NULL (``rptsrc == 2``)."""
    return _c(col) == _lit(value)


# ------------------------------------------------------------------ ladders


def ladder(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    """``case_when``: first branch whose condition is TRUE wins.

    A condition that evaluates to NULL counts as not matched and the ladder
    falls through to the next branch. Without ``default`` unmatched rows get
    NULL.
    """
    if not branches:
        raise ValueError("ladder needs at least one branch")
    cond, value = branches[0]
    out = F.when(cond, _lit(value))
    for cond, value in branches[1:]:
        out = out.when(cond, _lit(value))
    if default is not None:
        out = out.otherwise(_lit(default))
    return out


def ladder_strict(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    """Nested ``ifelse``: a NULL condition makes the result NULL.

    Branches are tested in order; the first whose condition is NULL stops the
    ladder with NULL, the first TRUE returns its value.
    """
    if not branches:
        raise ValueError("ladder_strict needs at least one branch")
    out = _lit(default) if default is not None else F.lit(None)
    for cond, value in reversed(branches):
        out = F.when(cond.isNull(), F.lit(None)).when(cond, _lit(value)).otherwise(out)
    return out


def code_labels(col, mapping: dict, rest_label=None, rest_unless=None) -> Column:
    """Code -> label ladder with an optional catch-all.

    ``rest_label`` is given to every non-NULL code not in ``mapping`` except
    ``rest_unless`` (the missing-code sentinel), which maps to NULL.
    """
    c = _c(col)
    branches = [(c == _lit(k), v) for k, v in mapping.items()]
    if rest_label is not None:
        rest = c.isNotNull() if rest_unless is None else (c != _lit(rest_unless))
        branches.append((rest, rest_label))
    return ladder(branches)


# -------------------------------------------------------------- flag folds


def any_of(conds: Iterable[Column]) -> Column:
    """Kleene OR over conditions: TRUE if any TRUE, NULL if undecidable."""
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds)


def any_equals(cols: Sequence, value) -> Column:
    """Multi-slot membership: is ``value`` in any of the slot columns."""
    return any_of(_c(c) == _lit(value) for c in cols)


def any_in(cols: Sequence, values: Sequence) -> Column:
    return any_of(_c(c).isin(list(values)) for c in cols)


def any_above(cols: Sequence, bound) -> Column:
    return any_of(_c(c) > _lit(bound) for c in cols)


def tri_flag(cols: Sequence, true_code=1, false_code=2) -> Column:
    """Three-valued any-of flag.

    TRUE when any column equals ``true_code``; otherwise FALSE when any equals
    ``false_code``; otherwise NULL (missing).
    """
    return ladder([
        (any_equals(cols, true_code), True),
        (any_equals(cols, false_code), False),
    ])


def priority_group(rules: Sequence[tuple[Column, str]], strict: bool = False) -> Column:
    """Assign one group from several indicator conditions, first TRUE wins.

    ``strict=False`` falls through NULL indicators (``case_when``);
    ``strict=True`` returns NULL as soon as a tested indicator is NULL
    (nested ``ifelse``).
    """
    return ladder_strict(rules) if strict else ladder(rules)


def binary_label(cond: Column, if_true: str, if_false: str) -> Column:
    """``ifelse(cond, a, b)``: NULL condition -> NULL label."""
    return F.when(cond, F.lit(if_true)).when(~cond, F.lit(if_false))


# ------------------------------------------------------------------- keys


def paste_key(*cols, sep: str = "") -> Column:
    """``paste(a, b, sep="")``: NULL parts print as the text ``NA``."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def not_in_keep_null(col, values: Sequence) -> Column:
    """``!(x %in% values)``: TRUE for NULL x (R's %in% never returns NA)."""
    return ~F.coalesce(_c(col).isin(list(values)), F.lit(False))


def level_ordinal(col, levels: Sequence) -> Column:
    """Position (1-based) of a label in an explicit level order; NULL if absent."""
    c = _c(col)
    return ladder([(c == _lit(v), i + 1) for i, v in enumerate(levels)])
