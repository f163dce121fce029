"""Half-open integer intervals: merging, binned overlap joins, intersection lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riboplan.session import within

#: Width of a join bin: about the length of a feature, so that most intervals have one or two.
BIN = 1024
#: Features up to which the feature side is sent to all tasks; beyond it both sides shuffle by (key, bin).
BROADCAST_FEATURES = 500_000


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", slack: int = 0, aggs: Sequence[Column] = ()) -> DataFrame:
    """keys, start, end of the unions; intervals that touch or lie within ``slack`` merge.

    ``aggs`` are further aggregates over the members of a union. Empty intervals are dropped first.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.filter(F.col(end) > F.col(start)).withColumn("_reach", F.max(end).over(before))
    opens = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + slack), 1).otherwise(0)
    rows = rows.withColumn("_island", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), *aggs)
    return merged.drop("_island")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], width: int = BIN, broadcast_rows: int = BROADCAST_FEATURES, parts: int | None = None) -> DataFrame:
    """Pairs of left (``start``, ``end``) and right (``r_start``, ``r_end``) that overlap, with ``overlap``.

    Both sides are cut into bins and joined on (on, bin); a pair is taken in the bin in which its overlap
    begins, and so once. A hot contig spreads over its bins. The right side is broadcast if it is small;
    otherwise both shuffle, into ``parts`` where the caller knows how many hold them.
    """
    a = left.filter("end > start").withColumn("_bin", _bins(F.col("start"), F.col("end"), width))
    b = right.filter("r_end > r_start").withColumn("_bin", _bins(F.col("r_start"), F.col("r_end"), width))
    if within(right, broadcast_rows):
        b = F.broadcast(b)
    elif parts:
        a, b = a.repartition(parts, *on, "_bin"), b.repartition(parts, *on, "_bin")
    begin = F.greatest("start", "r_start")
    return (
        a.join(b, [*on, "_bin"])
        .filter((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.floor(begin / width) == F.col("_bin")))
        .withColumn("overlap", F.least("end", "r_end") - begin)
        .drop("_bin")
    )


def intersection_length(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, overlap: the total overlap of two sets of disjoint intervals."""
    return overlap_join(left, right, keys).groupBy(*keys).agg(F.sum("overlap").alias("overlap"))
