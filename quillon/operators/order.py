"""Numbers in an order, and order statistics, without one task for a whole table or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.sources.shared import cut


def running(rows: DataFrame, order: list, group: str | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """rows with running sums (default: ``place``, the row's number from 1) in this order, in each group.

    The order should name each row's place; ``sums`` gives names and what to add up, not
    null. Rows are dealt by ranges of (group, order); sums run within a range, and what lies
    in the ranges before is added by a join of a row for each group and range.
    """
    sums = sums or {"place": F.lit(1).cast("long")}
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    rows = rows.withColumns({"_g": F.struct(group) if group else F.struct(F.lit(0).alias("all")), **{f"_v_{n}": c for n, c in sums.items()}})
    dealt = cut(rows.repartitionByRange(F.col("_g"), *keys).withColumn("_p", F.spark_partition_id()))
    each = dealt.groupBy("_g", "_p").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    earlier = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = each.select("_g", "_p", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inside = W.partitionBy("_p", "_g").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(before, ["_p", "_g"])
    own = [c for c in rows.columns if c != "_g" and not c.startswith("_v_")]
    return out.select(*own, *((F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def percentiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles (interpolated) of a column, nulls left out; None for each of an empty one.

    Of the numbered values only the two beside each percentile reach the driver.
    """
    some = rows.select(F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    placed = cut(running(some, ["x"]))
    n = placed.count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    wanted = sorted({int(a) + d for a in at for d in (1, 2)})
    found = {r.place: r.x for r in placed.filter(F.col("place").isin(wanted)).collect()}
    low = [found[int(a) + 1] for a in at]
    return [x + (a - int(a)) * (found.get(int(a) + 2, x) - x) for a, x in zip(at, low)]
