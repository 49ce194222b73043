"""Pages of an ordered sheet by an order-statistics index: sorted runs and their counts.

``rows.query`` takes the top of the whole table for each page, which grows with
the page's start.  Here the order is made once: rows are dealt by ranges of it,
sorted, and written a folder a run; the counts of the runs, one number each,
say which run a place is in.  A page reads its own run, or two where it
straddles them, whatever its start; whether more follows is known from counts.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import AT, PART, in_order
from .rows import PAGE, ordered, projected


class Pages:
    """The rows of a sheet that match, in an order, by place."""

    def __init__(self, sheet: DataFrame, where: dict | None = None, order_by: list[tuple[str, str]] | None = None, kind: str = "survey", runs: int | None = None):
        rows, keys = ordered(sheet, where, order_by, kind)
        self.sheet, self.known = sheet, rows.columns
        self.rows = in_order(rows, keys, "pages", runs, folders=True)
        counts = dict(self.rows.groupBy(PART).count().collect())
        self.parts = sorted(counts)
        self.starts = [0, *accumulate(counts[p] for p in self.parts)]
        self.total = self.starts[-1]

    def page(self, start: int = 0, limit: int = PAGE, columns: list[str] | None = None) -> DataFrame:
        """Rows start to start + limit in order; the last column more_results says whether rows follow."""
        if not 0 < limit <= PAGE:
            raise ValueError(f"limit is 1 to {PAGE}")
        wanted = F.lit(False)
        for part, first, after in zip(self.parts, self.starts, self.starts[1:]):
            low, high = max(start, first), min(start + limit, after)
            if low < high:
                wanted = wanted | ((F.col(PART) == part) & F.col(AT).between(low - first, high - first - 1))
        page = self.rows.where(wanted).orderBy(PART, AT)
        return page.select(*projected(self.sheet, self.known, columns), F.lit(start + limit < self.total).alias("more_results"))
