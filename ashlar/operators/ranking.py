"""Places in one global order without one global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that a table is cut into, and sampled keys that their limits come from (only the balance of tasks depends on them).
RANGES = 256
SAMPLE = 16_384


def ranged(df: DataFrame, by: Column, ties: list[Column], descending: bool = False) -> DataFrame:
    """``df`` with ``_range``, the number of its range in the order of ``by`` (nulls first, or last if descending) and then ``ties``.

    A value that many rows share is cut by their ties. The limits are keys of a bounded
    sample, held as literals, so that every evaluation cuts alike.
    """
    names = ["v", *(f"t{i}" for i in range(len(ties)))]
    keys = df.select(*(c.alias(n) for c, n in zip([by, *ties], names)))
    share = min(1.0, SAMPLE / max(1, keys.count()))
    some = keys.where(F.pmod(F.xxhash64(F.lit("range"), *names), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).distinct()
    first = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first()
    held = some.orderBy(first, *(F.col(n).asc_nulls_first() for n in names[1:])).limit(4 * SAMPLE).collect()
    limits = held[:: max(1, len(held) // RANGES)]
    if not limits:
        return df.withColumn("_range", F.lit(0))
    kinds = [keys.schema[n].dataType for n in names]
    given = F.array(*[F.struct(*[F.lit(x).cast(k).alias(n) for x, k, n in zip(row, kinds, names)]) for row in limits])

    def reached(limit: Column) -> Column:
        head, own = F.struct(limit["v"].alias("v")), F.struct(by.alias("v"))
        before = head > own if descending else head < own
        if not ties:
            return before | (head == own)
        return before | ((head == own) & (F.struct(*[limit[n].alias(n) for n in names[1:]]) <= F.struct(*[c.alias(n) for c, n in zip(ties, names[1:])])))

    return df.withColumn("_range", F.size(F.filter(given, reached)))


def counted(df: DataFrame, by: Column, ties: list[Column], what: Column, name: str, descending: bool = False) -> DataFrame:
    """``df`` with the number of rows that meet ``what`` up to each row, in the order of ``ranged``: counted inside ranges and shifted by the ranges before."""
    rows = ranged(df, by, ties, descending)
    shifts = rows.groupBy("_range").agg(F.count_if(what).alias("_n")).withColumn("_shift", F.sum("_n").over(W.orderBy("_range")) - F.col("_n"))
    first = by.desc_nulls_last() if descending else by.asc_nulls_first()
    order = W.partitionBy("_range").orderBy(first, *(c.asc_nulls_first() for c in ties))
    near = F.count_if(what).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_near", near).join(F.broadcast(shifts.select("_range", "_shift")), "_range").withColumn(name, F.col("_near") + F.col("_shift")).drop("_range", "_near", "_shift")
