"""Use a computed value several times without computing it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluate_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` bound to a lambda variable.

    The optimizer may merge a column into the expression that reads it. Inside a
    lambda that would compute it again for every array element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(**columns: Column) -> Column:
    """The given columns as a generator of one row, for use in ``select``.

    A later filter on such a column stays above the generator. On a plain column
    the optimizer would push the filter below, with the whole computation in it,
    and every text would be worked on twice.
    """
    return F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
