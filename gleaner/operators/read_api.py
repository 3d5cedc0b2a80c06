"""Reading: filters, stable orders and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gleaner.operators.batch import numbered


def select(rows: DataFrame, q: str | None = None, text: list[str] = (), **allowed: list) -> DataFrame:
    """Rows whose text columns, together and in any case, hold ``q``, and whose columns have one of the allowed values."""
    if q:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *text)), F.lit(q.lower())))
    for name, values in allowed.items():
        rows = rows.where(F.col(name).isin(list(values)))
    return rows


#: Pages that end within so many rows come from a bounded sort instead of numbering all rows.
TOP = 10_000


def page(rows: DataFrame, order: list, position: int, limit: int) -> DataFrame:
    """Rows ``position`` + 1 to ``position`` + ``limit`` in a total order, numbered ``rn``."""
    if position + limit <= TOP:
        rows = rows.orderBy(*order).limit(position + limit)  # every task keeps that many rows
        placed = rows.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        placed = numbered(rows, order, "rn")
    return placed.where((F.col("rn") > position) & (F.col("rn") <= position + limit))


def cursor_page(rows: DataFrame, order: list, position: int, limit: int) -> DataFrame:
    """A page with the ``total`` of rows and the positions of the ``next`` and ``previous`` page, NULL if there is none."""
    total = rows.agg(F.count("*").alias("total"))
    after = F.when(F.col("total") > position + limit, position + limit)
    before = F.when(F.lit(position) > 0, max(0, position - limit))
    return page(rows, order, position, limit).join(F.broadcast(total)).withColumns({"next": after, "previous": before})


def sort_key(column: str, key: str, descending: bool = False) -> list:
    """A user's sort: NULLs last either way, strings in any case, and equal ones in ascending order of the key."""
    folded = F.lower(column)
    return [F.desc_nulls_last(folded) if descending else F.asc_nulls_last(folded), F.asc(key)]
