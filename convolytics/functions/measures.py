"""How an analysis counts its input: by rows, or by the cells of a cube that
hold partial counts (``operators.cube``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from convolytics.functions.numeric import safe_divide


class Measures:
    """One input row is one conversation."""

    def rows(self, condition: Column | None = None) -> Column:
        """Rows (where ``condition`` is true)."""
        return F.count(F.lit(1) if condition is None else F.when(condition, F.lit(1)))

    def non_null(self, column: str) -> Column:
        return F.count(column)

    def total(self, column: str) -> Column:
        return F.sum(column)

    def mean(self, column: str) -> Column:
        return F.avg(column)

    def rate(self, condition: Column) -> Column:
        """rows where ``condition`` is true / all rows x 100; a null
        condition stays in the denominator."""
        return safe_divide(self.rows(condition), self.rows()) * F.lit(100.0).cast("double")


class CellMeasures(Measures):
    """One input row is a cell: ``n`` conversations; a word column holds the
    sum of its words, the id column the number of its non-null ids."""

    def __init__(self, n: str = "n"):
        self.n = n

    def rows(self, condition: Column | None = None) -> Column:
        n = F.col(self.n) if condition is None else F.when(condition, F.col(self.n))
        return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")

    def non_null(self, column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    def mean(self, column: str) -> Column:
        return safe_divide(F.sum(column), F.sum(self.n))


PER_ROW = Measures()
