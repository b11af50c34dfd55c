"""Masks as sets of occupied voxels (mask_id, k, r, c): set algebra, boxes, counts, overlap.

Every operator takes any number of masks at once; ``mask_id`` is the grouping key throughout. A
mask without voxels has no rows, so operators that have an answer for it take ``names``: the masks
that are asked for (a list, or a table with mask_id); by default those that have voxels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill import errors
from voxelmill.operators.grid import Grid, Tolerance

KEY = ["k", "r", "c"]
ID = ["mask_id", *KEY]


def listed(masks: DataFrame, names: list[str] | DataFrame | None = None) -> DataFrame:
    """mask_id of the masks that are asked for, each once."""
    if names is None:
        return masks.select("mask_id").distinct()
    if isinstance(names, DataFrame):
        return names.select("mask_id").distinct()
    return masks.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "mask_id string")


def empty(spark: SparkSession) -> DataFrame:
    """Masks without any voxel."""
    return spark.createDataFrame([], "mask_id string, k int, r int, c int")


def from_dense(spark: SparkSession, grid: Grid, values: list[int], mask_id: str = "mask") -> DataFrame:
    """A mask from one value per voxel in plane, row, column order."""
    if len(values) != grid.voxels:
        raise ValueError("one value for each voxel is needed")
    grid.require_budget()
    flat = spark.createDataFrame([(list(values),)], "v array<int>").select(F.posexplode("v").alias("i", "v")).filter("v <> 0")
    return at_index(flat, grid).select(F.lit(mask_id).alias("mask_id"), *KEY)


def at_index(rows: DataFrame, grid: Grid, index: str = "i") -> DataFrame:
    """Adds k, r, c of a linear index."""
    area = grid.rows * grid.cols
    return rows.withColumns({"k": F.expr(f"cast({index} div {area} as int)"), "r": F.expr(f"cast(({index} % {area}) div {grid.cols} as int)"), "c": F.expr(f"cast({index} % {grid.cols} as int)")})


def linear_index(grid: Grid) -> Column:
    return ((F.col("k").cast("long") * grid.rows + F.col("r")) * grid.cols + F.col("c")).cast("long")


def inside(grid: Grid) -> Column:
    return F.col("k").between(0, len(grid.planes) - 1) & F.col("r").between(0, grid.rows - 1) & F.col("c").between(0, grid.cols - 1)


# --- phantoms --------------------------------------------------------------------------------


def _offsets(spark: SparkSession, grid: Grid) -> tuple[DataFrame, tuple[Column, Column, Column]]:
    centre, n = grid.centre(), grid.normal
    d = [F.col(v) - F.lit(float(centre[i])) for i, v in enumerate("xyz")]
    along = lambda v: d[0] * float(v[0]) + d[1] * float(v[1]) + d[2] * float(v[2])
    return grid.placed_voxels(spark), (along(grid.row_dir), along(grid.col_dir), along(n))


def _phantom(rows: DataFrame, keep: Column, mask_id: str) -> DataFrame:
    return rows.filter(keep).select(F.lit(mask_id).alias("mask_id"), *KEY)


def cube(spark: SparkSession, grid: Grid, side: float, mask_id: str = "cube") -> DataFrame:
    rows, d = _offsets(spark, grid)
    return _phantom(rows, (F.abs(d[0]) <= side / 2) & (F.abs(d[1]) <= side / 2) & (F.abs(d[2]) <= side / 2), mask_id)


def sphere(spark: SparkSession, grid: Grid, radius: float, mask_id: str = "sphere") -> DataFrame:
    rows, d = _offsets(spark, grid)
    return _phantom(rows, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= radius, mask_id)


def torus(spark: SparkSession, grid: Grid, major: float, minor: float, mask_id: str = "torus") -> DataFrame:
    if not major > minor:
        raise ValueError("the major radius must be the greater one")
    rows, d = _offsets(spark, grid)
    ring = F.sqrt(d[0] * d[0] + d[1] * d[1]) - major
    return _phantom(rows, ring * ring + d[2] * d[2] <= minor * minor, mask_id)


def analytic_volume(kind: str, *sizes: float) -> float:
    """Volume in mm3 of a cube (side), sphere (radius) or torus (major, minor)."""
    from math import pi

    return {"cube": lambda s: s**3, "sphere": lambda r: 4 / 3 * pi * r**3, "torus": lambda a, b: 2 * pi**2 * a * b**2}[kind](*sizes)


# --- set algebra -----------------------------------------------------------------------------


def union(a: DataFrame, grid_a: Grid, b: DataFrame, grid_b: Grid, tolerance: Tolerance = Tolerance()) -> DataFrame:
    grid_a.require_same(grid_b, tolerance)
    return a.select(*ID).union(b.select(*ID)).distinct()


def intersection(a: DataFrame, grid_a: Grid, b: DataFrame, grid_b: Grid, tolerance: Tolerance = Tolerance()) -> DataFrame:
    grid_a.require_same(grid_b, tolerance)
    return a.select(*ID).join(b.select(*ID), ID, "left_semi")


def subtract(a: DataFrame, grid_a: Grid, b: DataFrame, grid_b: Grid, tolerance: Tolerance = Tolerance()) -> DataFrame:
    grid_a.require_same(grid_b, tolerance)
    return a.select(*ID).join(b.select(*ID), ID, "left_anti")


def xor(a: DataFrame, grid_a: Grid, b: DataFrame, grid_b: Grid, tolerance: Tolerance = Tolerance()) -> DataFrame:
    """One aggregation: voxels that are in just one of the sets."""
    grid_a.require_same(grid_b, tolerance)
    both = a.select(*ID, F.lit(1).alias("side")).union(b.select(*ID, F.lit(2).alias("side")))
    return both.groupBy(*ID).agg(F.sum("side").alias("s")).filter("s < 3").select(*ID)


def complement(masks: DataFrame, grid: Grid, names: list[str] | DataFrame | None = None) -> DataFrame:
    """The voxels of the grid outside each mask; for a named one without voxels, the whole grid. The
    dense grid is made on the way, never stored."""
    grid.require_budget()
    return every_voxel(listed(masks, names), grid).select(*ID).join(masks.select(*ID), ID, "left_anti")


def every_voxel(names: DataFrame, grid: Grid) -> DataFrame:
    """All voxels of a grid for each mask, plane by plane, without a cross join."""
    planes = names.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(grid.planes) - 1)))).repartition("mask_id", "k")
    rows = planes.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1))))
    return rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(grid.cols - 1))))


# --- boxes -----------------------------------------------------------------------------------


def bounding_box(masks: DataFrame, names: list[str] | DataFrame | None = None) -> DataFrame:
    """Inclusive index bounds of each mask; null for named ones without voxels."""
    boxes = masks.groupBy("mask_id").agg(*(f(x).alias(f"{x}_{n}") for x in KEY for n, f in (("min", F.min), ("max", F.max))))
    return boxes if names is None else listed(masks, names).join(boxes, "mask_id", "left")


def value(masks: DataFrame, grid: Grid, k: int, r: int, c: int, names: list[str] | DataFrame | None = None) -> DataFrame:
    """mask_id, value: 1 if the voxel is in the mask, else 0. Indices off the grid are refused."""
    grid.require_index(k=k, r=r, c=c)
    here = masks.filter((F.col("k") == k) & (F.col("r") == r) & (F.col("c") == c)).select("mask_id", F.lit(1).alias("value")).distinct()
    return listed(masks, names).join(here, "mask_id", "left").select("mask_id", F.coalesce("value", F.lit(0)).alias("value"))


def plane(masks: DataFrame, grid: Grid, k: int) -> DataFrame:
    """The voxels of one plane; an index off the grid is refused."""
    grid.require_index(k=k)
    return masks.filter(F.col("k") == k).select(*ID)


def crop(masks: DataFrame, grid: Grid, box: tuple[int, int, int, int, int, int] | None = None) -> tuple[DataFrame, Grid]:
    """Masks on the sub-grid of an inclusive box (k0, k1, r0, r1, c0, c1); places stay put. By
    default it is the box around all of them (six numbers on the driver); without any voxel there
    is none."""
    if box is None:
        box = tuple(masks.agg(*(f(x) for x in KEY for f in (F.min, F.max))).first())
        if None in box:
            raise ValueError("masks without voxels have no box to crop to")
    k0, k1, r0, r1, c0, c1 = box
    if not all(isinstance(x, int) for x in box) or not (0 <= k0 <= k1 < len(grid.planes) and 0 <= r0 <= r1 < grid.rows and 0 <= c0 <= c1 < grid.cols):
        raise ValueError(f"box {box} is not inside the grid")
    shift = grid.to_patient(c0, r0, 0)
    moved = tuple(s - o for s, o in zip(shift, grid.planes[0], strict=True))
    planes = tuple(tuple(p + m for p, m in zip(q, moved, strict=True)) for q in grid.planes[k0 : k1 + 1])
    sub = Grid(r1 - r0 + 1, c1 - c0 + 1, grid.row_dir, grid.col_dir, grid.spacing, planes, grid.frame_uid)
    kept = masks.filter(F.col("k").between(k0, k1) & F.col("r").between(r0, r1) & F.col("c").between(c0, c1))
    return kept.select("mask_id", (F.col("k") - k0).alias("k"), (F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c")), sub


def pad(masks: DataFrame, grid: Grid, margin) -> tuple[DataFrame, Grid]:
    """Masks on the grid grown by ``margin`` (one number, or columns, rows, planes) on each side.
    New planes need at least two planes at equal distances."""
    mc, mr, mk = (margin,) * 3 if isinstance(margin, int) else margin
    if not all(isinstance(m, int) and m >= 0 for m in (mc, mr, mk)):
        raise ValueError("margins are integers from zero")
    if mk and (len(grid.planes) < 2 or not grid.uniform()):
        raise ValueError("planes can be added to uniform stacks of at least two only")
    n, step = grid.normal, grid.mean_spacing or 0.0
    first, last = grid.planes[0], grid.planes[-1]
    planes = [tuple(x - n[i] * step * j for i, x in enumerate(first)) for j in range(mk, 0, -1)] + list(grid.planes) + [tuple(x + n[i] * step * j for i, x in enumerate(last)) for j in range(1, mk + 1)]
    back = Grid(grid.rows, grid.cols, grid.row_dir, grid.col_dir, grid.spacing, tuple(planes), grid.frame_uid)
    corner = back.to_patient(-mc, -mr, 0)
    moved = tuple(a - b for a, b in zip(corner, back.planes[0], strict=True))
    grown = Grid(grid.rows + 2 * mr, grid.cols + 2 * mc, grid.row_dir, grid.col_dir, grid.spacing, tuple(tuple(p + m for p, m in zip(q, moved, strict=True)) for q in planes), grid.frame_uid)
    grown.require_budget()
    return masks.select("mask_id", (F.col("k") + mk).alias("k"), (F.col("r") + mr).alias("r"), (F.col("c") + mc).alias("c")), grown


# --- measures --------------------------------------------------------------------------------


def count(masks: DataFrame) -> DataFrame:
    return masks.groupBy("mask_id").agg(F.count("*").alias("voxels"))


def volume(masks: DataFrame, grid: Grid, method: str = "voxel") -> DataFrame:
    """mask_id, volume_mm3: voxels times the thickness of their planes."""
    if method != "voxel":
        raise errors.NotImplementedMethodError("volumes are by voxels only")
    per = masks.groupBy("mask_id", "k").agg(F.count("*").alias("n"))
    return per.groupBy("mask_id").agg(F.sum(F.col("n") * grid.volume_of(F.col("k"))).alias("volume_mm3"))


def overlap(a: DataFrame, grid_a: Grid, b: DataFrame, grid_b: Grid, on: list[str] | None = None, *, names: list[str] | DataFrame | None = None, tolerance: Tolerance = Tolerance()) -> DataFrame:
    """Counts, Dice and disagreement of masks a and b that share a mask_id, in one aggregation. Two
    masks without voxels are alike: Dice 1, for those that are named."""
    grid_a.require_same(grid_b, tolerance)
    on = on or ["mask_id"]
    both = a.select(*on, *KEY, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).union(b.select(*on, *KEY, F.lit(0), F.lit(1)))
    per = both.groupBy(*on, *KEY).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    out = per.groupBy(*on).agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"), F.sum(F.col("in_a") * F.col("in_b")).alias("n_both"))
    if names is not None:
        out = listed(a, names).join(out, on, "left").select(*on, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_a", "n_b", "n_both")))
    total = F.col("n_a") + F.col("n_b")
    return out.withColumns({"dice": F.when(total == 0, 1.0).otherwise(2.0 * F.col("n_both") / F.when(total != 0, total)), "disagreement": total - 2 * F.col("n_both")})


#: What asking an empty mask for a place or a quantile fails with.
NO_VOXELS = "INDETERMINATE: a mask without voxels"


def centroid(masks: DataFrame, grid: Grid, names: list[str] | DataFrame | None = None) -> DataFrame:
    """mask_id, index means ic, ir, ik and patient means x, y, z, weighted by plane thickness
    (weight 1 on a grid of one plane). Named masks without voxels fail the job."""
    weight = grid.thickness_of(F.col("k")) if len(grid.planes) > 1 else F.lit(1.0)
    p = grid.patient(F.col("k"), F.col("r"), F.col("c"))
    means = ("ic", "ir", "ik", "x", "y", "z")
    rows = masks.select("mask_id", weight.alias("w"), F.col("c").alias("ic"), F.col("r").alias("ir"), F.col("k").alias("ik"), p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))
    out = rows.groupBy("mask_id").agg(*((F.sum(F.col(v) * F.col("w")) / F.sum("w")).alias(v) for v in means))
    if names is None:
        return out
    return listed(masks, names).join(out, "mask_id", "left").withColumns({v: F.coalesce(v, F.raise_error(F.lit(NO_VOXELS)).cast("double")) for v in means})


def displacement(a: DataFrame, grid_a: Grid, b: DataFrame, grid_b: Grid) -> DataFrame:
    """mask_id, displacement_mm between the patient centroids; the grids may differ, their known
    frames of reference may not."""
    grid_a.require_frame(grid_b)
    other = centroid(b, grid_b).select("mask_id", *(F.col(v).alias(f"{v}_b") for v in "xyz"))
    far = F.sqrt(sum(((F.col(v) - F.col(f"{v}_b")) * (F.col(v) - F.col(f"{v}_b")) for v in "xyz"), F.lit(0.0)))
    return centroid(a, grid_a).join(other, "mask_id").select("mask_id", far.alias("displacement_mm"))
