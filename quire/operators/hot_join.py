"""Joins of text rows with a table of words, whose frequent words are hot keys.

A few words make up a third of all rows, and an equi-join would send each to one
task. The table's most frequent rows, as many as fit into ``BUDGET`` bytes, are
broadcast and met where the text rows lie; only rows of rarer words are shuffled.
With m rows broadcast no shuffled word holds more than 1/m of the rows. Both
kinds are read from the rows on their own, so these should be written ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import stored

#: Bytes of the table that may be broadcast.
BUDGET = 16 * 1024 * 1024


def hot_join(rows: DataFrame, table: DataFrame, key: str | list[str], frequency: str, row_bytes: int,
             id_col: str, budget: int | None = None) -> DataFrame:
    """The inner join of ``rows`` with the written ``table`` (one row a ``key``).

    ``frequency`` orders the table's rows, ``row_bytes`` is what one takes in
    memory. ``id_col`` names the rows' document; joined rows of one document come
    from several partitions.
    """
    keys = [key] if isinstance(key, str) else key
    names = [c for c in table.columns if c not in keys]
    most = max(1, (BUDGET if budget is None else budget) // row_bytes)
    if table.count() <= most:  # written tables are counted from their footers
        return rows.join(F.broadcast(table), keys).select(*rows.columns, *names)
    hot = stored(table.orderBy(F.desc(frequency), *keys).limit(most), "hot-rows")
    frequent = F.broadcast(hot.select(*keys))
    met = rows.join(F.broadcast(hot), keys).select(*rows.columns, *names)
    rest = rows.join(frequent, keys, "left_anti").join(table.join(frequent, keys, "left_anti"), keys)
    return met.unionByName(rest.select(*rows.columns, *names))
