"""Operator 6, best-fit packing: the plan is made on the length histogram, and documents take its slots by rank.

Pieces are at most ``capacity`` units long: a longer document is cut into full pieces and a rest. Best-fit decreasing
runs on the driver over (length, count) alone: pieces of a length fill the tightest open sequences first, the oldest
among equals, whole groups of like sequences at a time. Its work and its result depend on the capacity, never on the
number of documents. A row of the plan is a range of ranks within one length; pieces are ranked within their length and
joined to it on the length and a block of ranks. Only the narrow table of piece lengths is shuffled, never texts.

Defined results: the length of a text is its number of units and one for the separator that ends it. A unit is up to
``UNIT_CHARS`` characters between white space (as Java has it), so that a text without spaces is as long as its letters
make it. A null or empty text has no piece. Null and repeated ids are packed, a piece for each row; rows that agree in id and
length are interchangeable. Ranks go by (bucket of the id, id, piece). An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import parts, staged

CAPACITY = 2048
UNIT_CHARS = 16
PLAN = "length int, rank_from bigint, rank_to bigint, bin_from bigint, per_bin int, offset int, block bigint"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots of best-fit decreasing: (length, rank_from, rank_to, bin_from, per_bin, offset). The piece of a rank r in
    the range goes to sequence bin_from + (r - rank_from) // per_bin, at offset + (r - rank_from) % per_bin * length."""
    open_: dict[int, deque[tuple[int, int]]] = {}  # free space -> groups (first sequence, how many)
    spaces: list[int] = []
    slots, new = [], 0

    def put(space: int, first: int, n: int) -> None:
        if not space or not n:
            return
        if space not in open_:
            open_[space] = deque()
            insort(spaces, space)
        groups = open_[space]
        at = len(groups)  # groups stay in the order of their sequences, so that the oldest is taken first
        while at and groups[at - 1][0] > first:
            at -= 1
        groups.insert(at, (first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit {capacity}")
        while left:
            i = bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, n = open_[space].popleft()
                if not open_[space]:
                    del open_[space], spaces[i]
            else:
                space, first, n = capacity, new, -(-left // (capacity // length))
                new += n
            each = space // length
            full, more = divmod(min(left, n * each), each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - space))
                put(space - each * length, first, full)
            if more:
                slots.append((length, rank + full * each, rank + full * each + more, first + full, each, capacity - space))
                put(space - more * length, first + full, 1)
            rank, left = rank + full * each + more, left - full * each - more
            used = full + bool(more)
            put(space, first + used, n - used)
    return slots


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length`` of every piece of ``docs(doc_id, text)``."""
    units = F.regexp_count(F.col("text").cast("string"), F.lit(rf"\S{{1,{UNIT_CHARS}}}"))
    sized = docs.select("doc_id", F.when(units > 0, units + 1).alias("n")).filter("n > 0")
    cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {capacity}").cast("int"))).alias("piece"))
    start = F.col("piece") * capacity
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("length"))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, bin, offset`` of every piece; see the module."""
    spark = docs.sparkSession
    buckets = parts(docs, 1 << 30)
    # Ids that hash alike share a bucket; with it as part of the key no length is ranked by one task.
    cut = staged(pieces(docs, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pieces")
    tally = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = dict(tally.groupBy("length").agg(F.sum("n")).collect())
    slots, per_length = plan(counts, capacity), {}
    for s in slots:
        per_length[s[0]] = per_length.get(s[0], 0) + 1
    width = {length: max(1, counts[length] // per_length[length]) for length in counts}
    rows = [(*s, block) for s in slots for block in range(s[1] // width[s[0]], (s[2] - 1) // width[s[0]] + 1)]
    planned = F.broadcast(spark.createDataFrame(rows, PLAN))
    widths = F.broadcast(spark.createDataFrame(list(width.items()), "length int, width bigint"))

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = (
        cut.withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets, ["length", "bucket"])
        .join(widths, "length")
        .select("doc_id", "piece", "start", "length", (F.col("base") + F.col("nth")).alias("rank"), F.expr("(base + nth) div width").alias("block"))
    )
    nth = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(planned, ["length", "block"])
        .filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            (F.col("bin_from") + F.floor(nth / F.col("per_bin"))).alias("bin"),
            (F.col("offset") + nth % F.col("per_bin") * F.col("length")).cast("int").alias("offset"),
        )
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
