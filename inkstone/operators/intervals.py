"""Operators on half-open intervals: overlap and containment joins, point lookups, composition, coalescing, offsets.

All take an equality key beside the interval (a document, a user), so that Spark hashes on it and the inequality is a
residual condition within one key; an interval join without a key goes over buckets of the axis (``bucketed_overlap``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(df: DataFrame, key: str | list[str], order: list[str], length: Column, start: str = "cp_start", end: str = "cp_end") -> DataFrame:
    """Consecutive intervals of the given lengths: a running sum within the key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(length).over(w)
    return df.withColumn(end, total).withColumn(start, F.col(end) - length)


def overlap_join(a: DataFrame, b: DataFrame, key: list[str], a_span: tuple[str, str], b_span: tuple[str, str], start: str = "cp_start", end: str = "cp_end") -> DataFrame:
    """Every non-empty intersection of an interval of ``a`` with one of ``b``."""
    (a0, a1), (b0, b1) = a_span, b_span
    on = [a[k] == b[k] for k in key] + [a[a0] < b[b1], b[b0] < a[a1]]
    joined = a.join(b, on)
    for k in key:
        joined = joined.drop(b[k])
    return joined.withColumn(start, F.greatest(a[a0], b[b0])).withColumn(end, F.least(a[a1], b[b1])).filter(F.col(start) < F.col(end))


def bucketed_overlap(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int, start: str = "cp_start", end: str = "cp_end") -> DataFrame:
    """``overlap_join`` without a key: both sides are spread over the buckets that they touch, and an intersection is
    given by the bucket in which it starts, so none is given twice."""
    (a0, a1), (b0, b1) = a_span, b_span

    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.filter(F.col(s) < F.col(e)).withColumn("bucket", F.explode(F.sequence(F.expr(f"`{s}` div {width}"), F.expr(f"(`{e}` - 1) div {width}"))))

    joined = spread(a, a0, a1).join(spread(b, b0, b1), "bucket").withColumn(start, F.greatest(a0, b0)).withColumn(end, F.least(a1, b1))
    return joined.filter((F.col(start) < F.col(end)) & (F.expr(f"`{start}` div {width}") == F.col("bucket"))).drop("bucket")


def contain_join(inner: DataFrame, outer: DataFrame, key: str, inner_span: tuple[str, str], outer_span: tuple[str, str], how: str = "inner") -> DataFrame:
    """Pairs in which the interval of ``inner`` lies within that of ``outer``."""
    on = (inner[key] == outer[key]) & (outer[outer_span[0]] <= inner[inner_span[0]]) & (inner[inner_span[1]] <= outer[outer_span[1]])
    return inner.join(outer, on, how)


def as_of(points: DataFrame, spans: DataFrame, key: str, at: list[str], value: str, tie: list[str]) -> DataFrame:
    """For each point, ``value`` of the last span that starts at or before it, within ``key``; null before the first.
    One sort of the union, no row per pair: spans come before points of the same place, and the last value is carried."""
    order = [f"__{i}" for i in range(len(at))]
    p = points.select("*", *[F.col(c).alias(o) for c, o in zip(at, order)], F.lit(1).alias("__kind"), F.lit(None).cast(spans.schema[value].dataType).alias("__value"))
    columns = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col(key) for f in points.schema]
    s = spans.select(*columns, *[F.col(c).alias(o) for c, o in zip(tie, order)], F.lit(0).alias("__kind"), F.col(value).alias("__value"))
    w = Window.partitionBy(key).orderBy(*order, "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(s).withColumn(f"last_{value}", F.last("__value", ignorenulls=True).over(w))
    return both.filter("__kind = 1").drop(*order, "__kind", "__value")


def elementary(a: DataFrame, b: DataFrame, key: str, start: str = "cp_start", end: str = "cp_end") -> DataFrame:
    """The intervals between neighbouring boundaries of both span sets, within ``key``."""
    edges = a.select(key, F.explode(F.array(start, end)).alias(start)).union(b.select(key, F.explode(F.array(start, end)).alias(start))).distinct()
    w = Window.partitionBy(key).orderBy(start)
    return edges.withColumn(end, F.lead(start).over(w)).filter(F.col(end).isNotNull())


def compose(a: DataFrame, b: DataFrame, key: str, a_value: str, b_value: str, start: str = "cp_start", end: str = "cp_end") -> DataFrame:
    """Both values on every elementary interval; null where a side has a gap. Sides must not overlap themselves. A span is
    a place where its value begins and one where it ends; places of one key are sorted once, and each carries the last
    state of either side, so that no span meets another."""

    def places(df: DataFrame, value: str, other: DataFrame, other_value: str, mine: int) -> DataFrame:
        held = df.filter(F.col(start) < F.col(end))
        none = F.lit(None).cast(f"struct<opens: int, v: {dict(other.dtypes)[other_value]}>")
        begins, ends = F.struct(F.lit(1).alias("opens"), F.col(value).alias("v")), F.struct(F.lit(0).alias("opens"), F.lit(None).cast(dict(df.dtypes)[value]).alias("v"))
        both = held.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), begins.alias("s")), F.struct(F.col(end).alias("at"), ends.alias("s")))).alias("p"))
        states = [F.col("p.s"), none] if mine == 0 else [none, F.col("p.s")]
        return both.select(key, F.col("p.at").alias(start), states[0].alias("__a"), states[1].alias("__b"))

    events = places(a, a_value, b, b_value, 0).union(places(b, b_value, a, a_value, 1)).repartition(key)
    at = events.groupBy(key, start).agg(F.max_by("__a", F.col("__a.opens")).alias("__a"), F.max_by("__b", F.col("__b.opens")).alias("__b"))  # what begins comes after what ends
    w = Window.partitionBy(key).orderBy(start)
    carried = at.withColumn(end, F.lead(start).over(w)).withColumn("__a", F.last("__a", ignorenulls=True).over(w)).withColumn("__b", F.last("__b", ignorenulls=True).over(w))
    out = carried.filter(F.col(end).isNotNull()).select(key, start, end, F.col("__a.v").alias(a_value), F.col("__b.v").alias(b_value))
    return out.filter(F.col(a_value).isNotNull() | F.col(b_value).isNotNull())


def islands(df: DataFrame, key: list[str], order: list[str], same: list[str], number: str = "island") -> DataFrame:
    """Numbers, from 0 within ``key``, the runs of neighbouring rows that agree in ``same``."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", F.when(first, 0).when(changed, 1).otherwise(0)).withColumn(number, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def coalesce(df: DataFrame, key: list[str], same: list[str], start: str = "cp_start", end: str = "cp_end") -> DataFrame:
    """Non-empty spans with touching neighbours of equal values merged."""
    w = Window.partitionBy(*key).orderBy(start)
    joins = F.lag(end).over(w) == F.col(start)
    for c in same:
        joins = joins & F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = df.filter(F.col(start) < F.col(end)).withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*key, *same, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")
