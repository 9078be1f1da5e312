"""Places and exact percentiles in groups of any size: rows are parted by ranges, so that no task holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Rows up to which a plain window serves: what one task sorts at most. Beyond, ranges give the same places.
PLAIN = 1_000_000


def _ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], weight: Column) -> tuple[DataFrame, DataFrame]:
    """df in ranges of (keys, order) with the range's number __range, and for each range and key __before and __all: the weight in earlier ranges and in all."""
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    per = placed.groupBy(*keys, "__range").agg(F.sum(weight).alias("__own"))
    # a row for each range that a key reaches into
    w = Window.partitionBy(*keys)
    per = per.withColumn("__before", F.sum("__own").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__own")).withColumn("__all", F.sum("__own").over(w))
    return placed, per


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str = "pos", n: str = "n") -> DataFrame:
    """df with each row's place in its group, from 1, by the columns of `order`, and the group's number of rows. Rows without a key column are left out."""
    df = df.dropna(subset=list(keys))
    if df.count() <= PLAIN:
        w = Window.partitionBy(*keys)
        return df.withColumn(pos, F.row_number().over(w.orderBy(*order)).cast("long")).withColumn(n, F.count("*").over(w))
    # ids rise by one within a range that is sorted as it is written, so that places need no window over it
    placed = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    in_range = F.shiftright("__id", 33)
    per = placed.groupBy(*keys, in_range.alias("__range")).agg(F.count("*").alias("__own"), F.min("__id").alias("__first"))
    w = Window.partitionBy(*keys)
    per = per.withColumn("__skip", F.sum("__own").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__own") - F.col("__first")).withColumn("__all", F.sum("__own").over(w))
    # a row for each range that a key reaches into, written so that its size is known before it meets the rows
    both = placed.withColumn("__range", in_range).join(cut(per, "per"), [*keys, "__range"])
    return both.withColumn(pos, F.col("__id") + F.col("__skip") + 1).withColumn(n, F.col("__all")).select(*df.columns, pos, n)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], between: bool = False) -> DataFrame:
    """keys and a column for each name of `wanted`: the least value that so large a share of the group's values doesn't exceed; between: interpolated as in a median.

    Values are counted first, so that a range holds each distinct one once. Nulls don't count.
    """
    counted = cut(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n")), "counted")
    if counted.count() <= PLAIN:
        return _by_window(counted, keys, value, wanted, between)
    placed, per = _ranges(counted, keys, [value], F.col("__n"))
    spot = {k: F.col("__all").cast("double") * p for k, p in wanted.items()}
    if between:
        at = {k: (F.col("__all") - 1).cast("double") * p for k, p in wanted.items()}
        places = {(k, side): f(x).cast("long") + 1 for k, x in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    else:
        places = {(k, "lo"): F.greatest(F.ceil(x).cast("long"), F.lit(1).cast("long")) for k, x in spot.items()}
    each = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(side).alias("side"), x.alias("place")) for (k, side), x in places.items()))
    asked = per.select(*keys, "__range", "__before", "__own", "__all", F.explode(each).alias("x")).select("*", "x.*")
    asked = asked.filter((F.col("place") > F.col("__before")) & (F.col("place") <= F.col("__before") + F.col("__own"))).withColumn("local", F.col("place") - F.col("__before"))
    # of the ranges only those that hold a wanted place are summed up
    near = placed.join(asked.select(*keys, "__range").distinct(), [*keys, "__range"], "left_semi")
    w = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hit = near.withColumn("__upto", F.sum("__n").over(w)).join(asked.select(*keys, "__range", "name", "side", "local", "__all"), [*keys, "__range"])
    hit = hit.filter((F.col("__upto") >= F.col("local")) & (F.col("__upto") - F.col("__n") < F.col("local")))
    found = lambda k, side: F.max(F.when((F.col("name") == k) & (F.col("side") == side), F.col(value)))
    cols = []
    for k, p in wanted.items():
        lo = found(k, "lo")
        part = F.max((F.col("__all") - 1).cast("double") * p)
        cols.append((lo + (found(k, "hi") - lo) * (part - F.floor(part)) if between else lo).alias(k))
    return hit.groupBy(*keys).agg(*cols)


def _by_window(counted: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], between: bool) -> DataFrame:
    """percentiles of counted values by running sums in a window."""
    w = Window.partitionBy(*keys)
    v = counted.withColumn("__upto", F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(w))
    at = lambda place: F.min(F.when(F.col("__upto") >= place, F.col(value)))
    cols = []
    for name, p in wanted.items():
        if not between:
            cols.append(at(F.greatest(F.ceil(F.col("__all").cast("double") * p).cast("long"), F.lit(1).cast("long"))).alias(name))
            continue
        spot = (F.col("__all") - 1).cast("double") * p
        lo, part = at(F.floor(spot).cast("long") + 1), F.max(spot - F.floor(spot))
        cols.append((lo + (at(F.ceil(spot).cast("long") + 1) - lo) * part).alias(name))
    return v.groupBy(*keys).agg(*cols)
