"""Folds, overlays, de-duplication, recursion and membership over relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut


def last_wins(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``value`` of the last row of each key: a fold of assignments, combined map-side."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def overlay(over: dict[str, Column], base: dict[str, Column]) -> list[Column]:
    """Fieldwise: what is set above wins over what is below; null means not set."""
    return [F.coalesce(over[c], base[c]).alias(c) if c in over and c in base else (over.get(c, base.get(c))).alias(c) for c in dict.fromkeys([*base, *over])]


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return _nth(df, key, [F.col(c) for c in order])


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return _nth(df, key, [F.col(c).desc() for c in order])


def _nth(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__nth = 1").drop("__nth")


def conflicts(df: DataFrame, key: list[str], signature: Column) -> DataFrame:
    """How many rows and different signatures each repeated key has."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(signature).alias("variants")).filter("n > 1")


def missing(df: DataFrame, known: DataFrame, on: Column) -> DataFrame:
    return df.join(known, on, "left_anti")


def full_outer(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str, side: str = "side") -> DataFrame:
    """Keys of either side, with ``both`` or the side that alone has it."""
    left, right = a.select(F.col(key), F.lit(True).alias("__a")), b.select(F.col(key), F.lit(True).alias("__b"))
    joined = left.join(right, key, "full_outer")
    return joined.select(key, F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), a_name).otherwise(b_name).alias(side))


def chain(spark: SparkSession, nodes: DataFrame, node: str, parent: str, values: list[str], depth_limit: int = 64) -> DataFrame:
    """Each node's values overlaid on its ancestors' along ``parent``, with its depth; nodes under a missing parent are
    roots, nodes on or under a cycle or deeper than the limit are left out. Distances double, so a depth of d takes log2(d)
    joins; each ends in a written table, else every step would double the plan."""
    up = {c: f"__up_{c}" for c in values}
    known = nodes.select(F.col(node).alias("__p"))
    state = nodes.join(known, F.col(parent) == F.col("__p"), "left").select(node, F.col("__p").alias("__at"), F.lit(0).alias("depth"), *values)
    state = cut(state)
    for _ in range(depth_limit.bit_length()):
        if state.filter("__at IS NOT NULL").isEmpty():
            break
        before = state
        above = state.select(F.col(node).alias("__n"), F.col("__at").alias("__next"), F.col("depth").alias("__d"), *[F.col(c).alias(u) for c, u in up.items()])
        state = state.join(above, F.col("__at") == F.col("__n"), "left").select(
            node,
            F.col("__next").alias("__at"),
            F.when(F.col("__n").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("__d") + 1).alias("depth"),
            *[F.coalesce(c, u).alias(c) for c, u in up.items()],
        )
        state = cut(state, after=before)
    return state.filter("__at IS NULL").drop("__at")


def bracket_depth(df: DataFrame, key: list[str], order: list[str], opens: Column, closes: Column, depth: str = "depth") -> DataFrame:
    """Nesting depth after each mark: a running sum of +1 and -1."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(depth, F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w))


def grid(df: DataFrame, key: str, row: str, left: str, right: str) -> DataFrame:
    """Columns of a table whose rows have cells at arbitrary boundaries: each boundary's rank among all of its table, and
    how many grid columns each cell spans. One shuffle by table: a cell is there with both its edges, these are ranked
    together, and the right one finds its cell's left one beside it."""
    cells = df.withColumn("__cell", F.monotonically_increasing_id())
    both = cells.withColumn("__edge", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(left).cast("bigint").alias("at")), F.struct(F.lit(1).alias("side"), F.col(right).cast("bigint").alias("at")))))
    ranked = both.withColumn("__rank", F.dense_rank().over(Window.partitionBy(key).orderBy("__edge.at")) - 1)
    pair = Window.partitionBy(key, "__cell")
    at = lambda side: F.max(F.when(F.col("__edge.side") == side, F.col("__rank"))).over(pair)
    return ranked.withColumn("first", at(0)).withColumn("span", at(1) - F.col("first")).filter("__edge.side = 0").drop("__cell", "__edge", "__rank")


def merged_cells(df: DataFrame, key: list[str], order: list[str], goes_on: Column, width: Column) -> DataFrame:
    """Cells that go on with the one before, added to it: ``cell`` counts those that begin, with their ``width`` and how many
    grid columns they ``span``. The first cell of a row begins one whatever it says."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.when(goes_on & (F.count(F.lit(1)).over(w) > 1), 0).otherwise(1)
    cells = df.withColumn("__width", width).withColumn("cell", F.sum(begins).over(w))
    return cells.groupBy(*key, "cell").agg(F.sum("__width").alias("width"), F.count("*").alias("span"))


def list_numbers(df: DataFrame, key: list[str], order: list[str], level: str, levels: int) -> DataFrame:
    """The number of each list item on every level, ``n1`` and so on: an item raises its own level's number, and the numbers
    of deeper levels start again after it."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    for k in range(1, levels + 1):
        if k > 1:  # an item of a level above begins a new stretch
            out = out.withColumn(f"__above{k}", F.sum((F.col(level) < k).cast("bigint")).over(w))
            own = Window.partitionBy(*key, f"__above{k}").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        else:
            own = w
        out = out.withColumn(f"n{k}", F.sum((F.col(level) == k).cast("bigint")).over(own))
    return out.drop(*(f"__above{k}" for k in range(2, levels + 1)))


def picture_differences(df: DataFrame, key: str, a: str, b: str, top: float = 255.0) -> DataFrame:
    """How far two pictures of one size, each an array of pixels, are from each other: mean absolute and root mean square
    error, and structural similarity over the whole."""
    pixels = df.select(key, F.explode(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))).alias("p")).select(key, F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    x, y, c1, c2 = F.avg("x"), F.avg("y"), F.lit((0.01 * top) ** 2), F.lit((0.03 * top) ** 2)
    alike = (2 * x * y + c1) * (2 * F.covar_pop("x", "y") + c2) / ((x * x + y * y + c1) * (F.var_pop("x") + F.var_pop("y") + c2))
    off = F.col("x") - F.col("y")
    return pixels.groupBy(key).agg(F.round(F.avg(F.abs(off)), 6).alias("mae"), F.round(F.sqrt(F.avg(off * off)), 6).alias("rmse"), F.round(alike, 6).alias("ssim"))


def positional(refs: DataFrame, texts: DataFrame, key: str, order: list[str], value: str, ref_name: str, text_name: str) -> DataFrame:
    """The i-th reference of a key beside its i-th text; what has no partner stands alone, so that counts can be compared."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint").alias("ord"), F.col(value).alias(name))

    return numbered(refs, ref_name).join(numbered(texts, text_name), [key, "ord"], "full_outer")


def bracket_match(df: DataFrame, key: list[str], order: list[str], opens: str, value: str) -> DataFrame:
    """Each opening mark with its level and the ``value`` of the mark that closes it: the next of the same level, if that
    closes; null for a mark that stays open."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levelled = df.withColumn("level", F.sum(F.when(F.col(opens), 1).otherwise(-1)).over(w) + F.when(F.col(opens), 0).otherwise(1))
    same = Window.partitionBy(*key, "level").orderBy(*order)
    nexts = levelled.withColumn("__next", F.lead(value).over(same)).withColumn("__opens", F.lead(opens).over(same))
    return nexts.filter(opens).withColumn("partner", F.when(~F.col("__opens"), F.col("__next"))).drop("__next", "__opens")


def contained_2d(inner: DataFrame, outer: DataFrame, key: str, ident: str, slack: int = 0, width: int = 256) -> DataFrame:
    """Rectangles (l, r, t, u) of ``inner`` that lie within another one of ``outer`` of the same key. An outer one is there
    once for each stretch of ``width`` that it covers, an inner one where its left edge is, so that a key with many
    rectangles meets by neighbourhood and not as a whole."""
    stretch = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
    o = outer.select(F.col(key).alias("__k"), F.col(ident).alias("__id"), *[F.col(c).alias(f"__{c}") for c in "lrtu"])
    o = o.withColumn("__at", F.explode(F.sequence(stretch(F.col("__l")), F.greatest(stretch(F.col("__l")), stretch(F.col("__r") + slack)))))
    within = (F.col("__l") <= F.col("l")) & (F.col("r") <= F.col("__r") + slack) & (F.col("__t") <= F.col("t")) & (F.col("u") <= F.col("__u"))
    on = (F.col(key) == F.col("__k")) & (stretch(F.col("l")) == F.col("__at")) & (F.col(ident) != F.col("__id")) & within
    return inner.join(o, on, "left_semi")


def range_overrides(cells: DataFrame, ranges: DataFrame, key: list[str], cell: str, low: str, high: str, order: str, value: str) -> DataFrame:
    """Each cell with the value of the last range that covers it; null where none does."""
    r = ranges.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(low).alias("__lo"), F.col(high).alias("__hi"), F.col(order).alias("__o"), F.col(value).alias("__v"))
    on = [F.col(k) == F.col(f"__{k}") for k in key] + [F.col("__lo") <= F.col(cell), F.col(cell) < F.col("__hi")]
    return cells.join(r, on, "left").groupBy(*key, cell).agg(F.max_by("__v", "__o").alias(value))
