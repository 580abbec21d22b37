"""One request of an interactive table: linked filters, column filters, search, page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from wavebook.operators import linked
from wavebook.operators.predicates import all_of, search_everywhere
from wavebook.operators.view import Order, info, page


@dataclass
class View:
    """The state of a table: what is filtered, searched, sorted and shown."""

    key: str
    order: Order
    links: dict[str, DataFrame | None] = field(default_factory=dict)
    filters: list[Column | None] = field(default_factory=list)
    search: str = ""
    columns: list[str] | None = None
    page_length: int = 10

    def rows(self, df: DataFrame) -> DataFrame:
        """Rows passing the linked filters, all column filters and the search."""
        kept = linked.apply(df, self.key, linked.intersect(self.links))
        kept = kept.where(all_of(self.filters))
        return search_everywhere(kept, self.search) if self.search else kept

    def page(self, df: DataFrame, number: int) -> DataFrame:
        shown = page(self.rows(df), self.order, number, self.page_length)
        return shown.select(*self.columns) if self.columns else shown

    def info(self, df: DataFrame) -> DataFrame:
        return info(self.rows(df), F.lit(True), self.page_length)
