"""Relational forms of structure-set and segmentation work: joins, merges, decoding, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.operators.masks import KEY
from voxelmill.operators.sampling import from_dense, sample


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the one that comes last in ``order``."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*key, "_r.*")


def join_rois(rois: DataFrame, contours: DataFrame, observations: DataFrame, key: list[str]) -> DataFrame:
    """ROIs with ``n_contours`` (0 if none) and ``interpreted_type`` (ORGAN if not observed).
    contours: key, i, n_contours; observations: key, i, interpreted_type; the last row counts."""
    c, o = (last_wins(x, key, "i").drop("i") for x in (contours, observations))
    out = rois.join(c, key, "left").join(o, key, "left")
    return out.withColumns({"n_contours": F.coalesce("n_contours", F.lit(0)), "interpreted_type": F.coalesce("interpreted_type", F.lit("ORGAN"))})


def undeclared(frames: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """Frames whose segment is not declared."""
    return frames.join(segments.select(*key).distinct(), key, "left_anti")


def frames_per_segment(frames: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    return segments.select(*key).distinct().join(frames.groupBy(*key).agg(F.count("*").alias("frames")), key, "left").withColumn("frames", F.coalesce("frames", F.lit(0)))


def merge_labels(masks: DataFrame, *, fail: bool = True) -> DataFrame:
    """k, r, c, label of masks whose ids are segment numbers. A voxel of two segments fails the
    job, or with ``fail`` off has a null label."""
    merged = masks.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.col("mask_id").cast("int")).alias("label"))
    clash = F.raise_error(F.lit("two segments claim one voxel")).cast("int") if fail else F.lit(None).cast("int")
    return merged.select(*KEY, F.when(F.col("n") == 1, F.col("label")).otherwise(clash).alias("label"))


def unpack_bits(frames: DataFrame, pixels: int, column: str = "pixels") -> DataFrame:
    """One row per set pixel ``i`` of packed frames; the first pixel is a byte's lowest bit."""
    kept = [c for c in frames.columns if c != column]
    numbered = frames.select(*kept, column, F.explode(F.sequence(F.lit(0), F.least(F.lit(pixels), F.length(column) * 8) - 1)).alias("i"))
    byte = F.conv(F.hex(F.substring(column, F.floor(F.col("i") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return numbered.filter(F.getbit(byte, F.col("i") % 8) == 1).select(*kept, "i")


def pack_bits(bits: DataFrame, key: list[str], index: str = "i") -> DataFrame:
    """key, hexed: set pixels packed into bytes, as hex text up to the last byte that has any."""
    bytes_ = bits.groupBy(*key, F.floor(F.col(index) / 8).cast("int").alias("b")).agg(F.bit_or(F.expr(f"shiftleft(1, cast({index} % 8 as int))")).alias("v"))
    per = bytes_.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"), F.max("b").alias("last"))
    digits = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.lower(F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0))), 2, "0")))
    return per.select(*key, F.array_join(digits, "").alias("hexed"))


def looks_binary(values: DataFrame, key: str, maximum: int, column: str = "v") -> DataFrame:
    """key, binary: whether 98 % of the values that are not 0 are within 2 % of the maximum."""
    near = maximum - max(1, int(maximum * 0.02))
    occupied, extreme = F.count_if(F.col(column) != 0), F.count_if((F.col(column) != 0) & (F.col(column) >= near))
    return values.groupBy(key).agg(((occupied > 0) & (extreme >= 0.98 * occupied)).alias("binary"))


def inconsistent(instances: DataFrame, series: str, order: str, values: dict[str, float]) -> DataFrame:
    """Instances of which a value differs from the first one's of their series by over its
    tolerance. ``values``: column to tolerance."""
    first = Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = instances.withColumns({f"_{c}": F.first(c).over(first) for c in values})
    bad: Column = F.lit(False)
    for c, tolerance in values.items():
        bad = bad | (F.abs(F.col(c) - F.col(f"_{c}")) > tolerance)
    return out.filter(bad).drop(*(f"_{c}" for c in values))


def sample_confidence(points: DataFrame, seg, number: int, *, method: str = "trilinear") -> DataFrame:
    """The points (point_id, x, y, z) with ``value``: the fraction of a FRACTIONAL segment there, 0
    outside. ``seg``: a parsed segmentation; a segment of another type is refused."""
    return sample(points, from_dense(points.sparkSession, seg.grid, seg.field(number)), seg.grid, method=method)
