"""Joining a per-key table onto rows without moving the rows, where the table is small enough."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import equi
from barloom.session import cut_lineage

BROADCAST_BYTES = 64 << 20


def table_bytes(table: DataFrame) -> float:
    """Bytes of all rows, from the schema and the lengths of arrays and strings."""

    def size(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, T.ArrayType):
            if not isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType)):
                return F.lit(24) + F.coalesce(F.size(c), F.lit(0)) * 8
            return F.lit(24) + F.coalesce(F.aggregate(c, F.lit(0).cast("double"), lambda a, x: a + size(kind.elementType, x)), F.lit(0.0))
        if isinstance(kind, T.StructType):
            out = F.lit(8)
            for f in kind.fields:
                out = out + size(f.dataType, c[f.name])
            return out
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.lit(16) + F.coalesce(F.octet_length(c), F.lit(0))
        return F.lit(8)

    total = F.lit(16)
    for f in table.schema.fields:
        total = total + size(f.dataType, F.col(f.name))
    return float(table.agg(F.sum(total.cast("double"))).first()[0] or 0.0)


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Equi-join of a one-row-per-key table (a few numbers or short arrays per row).

    The table is written once and measured; up to `max_bytes` it is broadcast, so a hot key never gathers
    in one task. Beyond that it is a shuffle join, whose skewed partitions adaptive execution splits.
    """
    table = cut_lineage(per_key)
    small = table_bytes(table) <= max_bytes
    return equi(rows, F.broadcast(table) if small else table, list(keys), how)
