"""Small bounded tables (formats, named vectors) as one array that every row can read.

The array is a scalar subquery: Spark computes it once, and pairing every row with every
entry is then a local ``explode``, without a join, a shuffle or an unchecked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20


def as_array(table: DataFrame, order_by: str, max_bytes: int = MAX_BYTES) -> Column:
    """The rows of ``table`` as an array of structs, ``order_by`` first.

    A table of over ``max_bytes`` (counted as JSON, before its rows are put together) is an error.
    """
    columns = [order_by] + [name for name in table.columns if name != order_by]
    n_bytes = table.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*columns)))), F.lit(0)).alias("n")).scalar()
    entries = F.array_sort(F.collect_list(F.struct(*columns)))
    too_large = F.raise_error(F.lit(f"a dimension table must not have more than {max_bytes} bytes"))
    return table.filter(n_bytes <= max_bytes).agg(F.when(n_bytes > max_bytes, too_large).otherwise(entries)).scalar()


def for_each_format(rows: DataFrame, formats: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every row once per format; the format comes as the struct column ``spec``."""
    return rows.select("*", F.explode(as_array(formats, "format_id", max_bytes)).alias("spec"))
