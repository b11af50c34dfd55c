"""Dose-volume and confidence queries: samples of a field (k, r, c, v) under masks.

All work on ``samples``: mask_id, v (double) and vol (mm3) of each masked voxel, or of each part of
one. Sums are partial on the map side; only per-structure results meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.operators.grid import Grid
from voxelmill.operators.masks import KEY, NO_VOXELS, inside, linear_index, listed

#: Values are first cut into ranges, so many for each time that they grow by a factor of e; a
#: quantile needs to order one range only. Up to so many sought ranges (5 MB) are broadcast.
RANGES_PER_E, FEW_TARGETS = 4096, 100_000


def samples(field: DataFrame, masks: DataFrame, grid: Grid) -> DataFrame:
    """Voxels without a field value give no sample, nor do voxels off the grid. Grids of one plane
    have no volumes. The join is on the linear index: one long is hashed and sorted faster than
    three integers."""
    volume = grid.volume_of(F.col("k"))
    values = field.filter(inside(grid)).select(linear_index(grid).alias("i"), F.col("v").cast("double").alias("v"))
    return masks.filter(inside(grid)).select("mask_id", "k", linear_index(grid).alias("i")).join(values, "i").select("mask_id", "v", volume.alias("vol"))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    span = hi - lo
    return F.when(span == 0, 0).otherwise(F.least(F.greatest(F.floor((v - lo) / F.when(span != 0, span) * bins), F.lit(0)), F.lit(bins - 1))).cast("int")


def histogram(rows: DataFrame, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """mask_id, bin, lo, hi, cnt, vol for every bin, also empty ones. Values outside are clamped to
    the end bins; the last bin is closed; a range of no width has all in bin 0. The ends of the masks
    are one pass, the bins another; empty bins come in as rows of nothing, not by a join."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    ends = rows.groupBy("mask_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = ends.select("mask_id", F.lit(float(lo)).alias("lo") if lo is not None else "lo", F.lit(float(hi)).alias("hi") if hi is not None else "hi")
    got = rows.join(ends, "mask_id").select("mask_id", "lo", "hi", _bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"), F.lit(1).cast("long").alias("cnt"), "vol")
    none = ends.select("mask_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).cast("long").alias("cnt"), F.lit(0.0).alias("vol"))
    full = got.union(none).groupBy("mask_id", "lo", "hi", "bin").agg(F.sum("cnt").alias("cnt"), F.sum("vol").alias("vol"))
    width = (F.col("hi") - F.col("lo")) / bins
    return full.select("mask_id", "bin", (F.col("lo") + width * F.col("bin")).alias("lo"), (F.col("lo") + width * (F.col("bin") + 1)).alias("hi"), "cnt", "vol")


def sensitivity(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """mask_id, threshold, vol and fraction of the volume at or above each threshold; one pass,
    sorted by mask and threshold."""
    sums = rows.groupBy("mask_id").agg(F.sum("vol").alias("total"), *(F.sum(F.when(F.col("v") >= t, F.col("vol")).otherwise(0.0)).alias(f"t{i}") for i, t in enumerate(thresholds)))
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("vol")) for i, t in enumerate(thresholds)))
    out = sums.select("mask_id", "total", F.explode(pairs).alias("p"))
    return out.select("mask_id", "p.threshold", "p.vol", F.when(F.col("total") > 0, F.col("p.vol") / F.col("total")).otherwise(0.0).alias("fraction")).orderBy("mask_id", "threshold")


def volume_above(rows: DataFrame, threshold: float) -> DataFrame:
    """mask_id, vol: V(x), the volume whose value is at least ``threshold``."""
    return rows.groupBy("mask_id").agg(F.sum(F.when(F.col("v") >= threshold, F.col("vol")).otherwise(0.0)).alias("vol"))


def value_range(v: Column) -> Column:
    """The range of a value: rising with it, some 1/4,096 of its size wide, however far others lie."""
    return F.when(v != 0, F.signum(v) * F.floor(F.log1p(F.abs(v) * 1e6) * RANGES_PER_E)).otherwise(0.0).cast("long")


def value_at(rows: DataFrame, fractions: list[float], names: list[str] | DataFrame | None = None) -> DataFrame:
    """mask_id, fraction, value: D(x), the greatest value that at least the fraction of the volume
    reaches; the least value if sums fall short. Named masks without samples fail the job.

    Sums over value ranges find the range that holds each answer, and only that range is put in
    order: some 2,000 different floats at most, so no task orders a whole structure, nor do outliers
    widen the ranges. The samples are read twice. The sought ranges, a row for each mask and fraction,
    are kept (memory and disk), counted, and broadcast if they are few: so samples aren't shuffled.
    """
    if not all(0 <= f <= 1 for f in fractions):
        raise ValueError("fractions are between 0 and 1")
    ranged = rows.withColumn("range", value_range(F.col("v")))
    sums = ranged.groupBy("mask_id", "range").agg(F.sum("vol").alias("vol"), F.min("v").alias("least"))
    down = Window.partitionBy("mask_id").orderBy(F.desc("range"))
    sums = sums.withColumns({"upto": F.sum("vol").over(down), "total": F.sum("vol").over(Window.partitionBy("mask_id"))})
    asked = sums.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    reached = F.max(F.when(F.col("upto") >= F.col("fraction") * F.col("total"), F.struct("range", F.col("upto") - F.col("vol"))))
    target = asked.groupBy("mask_id", "fraction").agg(reached.alias("hit"), F.min("least").alias("least"), F.max("total").alias("total"))
    target = target.select("mask_id", "fraction", "least", "total", F.col("hit.range").alias("range"), F.col("hit.col2").alias("before"))
    target = target.persist()
    values = ranged.join(F.broadcast(target) if target.count() <= FEW_TARGETS else target, ["mask_id", "range"]).groupBy("mask_id", "fraction", "before", "total", "v").agg(F.sum("vol").alias("vol"))
    running = F.col("before") + F.sum("vol").over(Window.partitionBy("mask_id", "fraction").orderBy(F.desc("v")))
    found = values.withColumn("running", running).groupBy("mask_id", "fraction").agg(F.max(F.when(F.col("running") >= F.col("fraction") * F.col("total"), F.col("v"))).alias("value"), F.min("v").alias("low"))
    out = target.select("mask_id", "fraction", "least").join(found, ["mask_id", "fraction"], "left").select("mask_id", "fraction", F.coalesce("value", "low", "least").alias("value"))
    if names is None:
        return out
    every = listed(rows, names).withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    return every.join(out, ["mask_id", "fraction"], "left").withColumn("value", F.coalesce("value", F.raise_error(F.lit(NO_VOXELS)).cast("double")))


def mean_value(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mask_id").agg((F.sum(F.col("v") * F.col("vol")) / F.sum("vol")).alias("mean"))


def statistics(rows: DataFrame, parts: int = 1, names: list[str] | DataFrame | None = None) -> DataFrame:
    """mask_id, least, greatest and mean value, volume, and voxels (each of ``parts`` samples). Named
    masks without samples have no values and 0 voxels."""
    out = rows.groupBy("mask_id").agg(F.min("v").alias("min_value"), F.max("v").alias("max_value"), (F.sum(F.col("v") * F.col("vol")) / F.sum("vol")).alias("mean_value"), F.sum("vol").alias("volume_mm3"), (F.count("*") / parts).cast("long").alias("voxels"))
    if names is None:
        return out
    return listed(rows, names).join(out, "mask_id", "left").withColumn("voxels", F.coalesce("voxels", F.lit(0).cast("long")))


def cumulative_dvh(rows: DataFrame, bins: int = 256, *, by_width: bool = False) -> DataFrame:
    """mask_id, i, dose, vol, fraction at ``bins`` + 1 points from 0 to the greatest value: the
    volume in bins from i up. The last point is 0 by definition, and a greatest value of 0 or less
    counts as 1. ``by_width`` bins by v / width, as supersampled histograms do."""
    top = rows.groupBy("mask_id").agg(F.max("v").alias("top"), F.sum("vol").alias("total")).withColumn("top", F.when(F.col("top") > 0, F.col("top")).otherwise(1.0))
    width = F.col("top") / bins
    raw = F.floor(F.col("v") / width) if by_width else F.floor(F.col("v") / F.col("top") * bins)
    got = rows.join(top, "mask_id").select("mask_id", "top", "total", F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int").alias("i"), "vol")
    none = top.select("mask_id", "top", "total", F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("i"), F.lit(0.0).alias("vol"))
    every = got.union(none).groupBy("mask_id", "top", "total", "i").agg(F.sum("vol").alias("v"))
    suffix = F.sum("v").over(Window.partitionBy("mask_id").orderBy(F.desc("i")))
    return every.withColumn("vol", F.when(F.col("i") == bins, 0.0).otherwise(suffix)).select("mask_id", "i", (F.col("top") * F.col("i") / bins).alias("dose"), "vol", F.when(F.col("total") > 0, F.col("vol") / F.col("total")).otherwise(0.0).alias("fraction"))


def method_tag(mode: str, parts: int, sampled: bool) -> Column:
    """The way a result came about, as a struct on each of its rows."""
    return F.struct(F.lit(mode).alias("mode"), F.lit(parts).alias("supersample"), F.lit(sampled).alias("resampled"))


def threshold_mask(field: DataFrame, threshold: float, mask_id: str = "mask") -> DataFrame:
    return field.filter(F.col("v") >= threshold).select(F.lit(mask_id).alias("mask_id"), *KEY)


def support(field: DataFrame, mask_id: str = "support") -> DataFrame:
    return field.filter("v > 0").select(F.lit(mask_id).alias("mask_id"), *KEY)
