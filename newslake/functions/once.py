"""Barrier for costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def computed_once(c: Column) -> Column:
    """``c`` itself, kept as a column of its own.

    Catalyst copies deterministic expressions into the filters and projections above them, which would run
    a ladder of regular expressions or a parser once per reference. It never copies an expression that
    draws a random number, so a condition on one that is always true (the sum hides that from the optimizer) pins ``c`` to the
    projection that defines it.
    """
    return F.when(F.rand(0) + 1.0 > 0.0, c)
