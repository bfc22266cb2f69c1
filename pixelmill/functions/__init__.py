"""Column functions: every one takes columns and returns a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once and gives it to `use`, however often `use` mentions it.

    Without it a value used many times is repeated in the expression tree, and
    nesting a few such functions makes the tree too large to optimise.
    """
    return F.get(F.transform(F.array(value), use), 0)
