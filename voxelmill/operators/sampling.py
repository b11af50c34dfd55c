"""Point sampling and resampling of fields between grids.

The source is read by joins on its voxel keys, whatever its size; a source of at most
``KERNEL_VOXELS`` may instead travel with the task (at most 8 bytes a voxel, so 64 MB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.columns import lerp, round_half_up
from voxelmill.operators.grid import Grid
from voxelmill.operators.masks import ID, KEY

KERNEL_VOXELS = 8_000_000
EDGE = 1e-9


def from_dense(spark: SparkSession, grid: Grid, values) -> DataFrame:
    """k, r, c, v (float) of one value for each voxel in plane, row, column order; a list or an array.
    The plan holds a row for each plane, which tasks take apart."""
    import numpy as np

    grid.require_budget()
    flat = np.asarray(values, dtype="<f4").ravel()
    if len(flat) != grid.voxels:
        raise ValueError("one value for each voxel is needed")
    area, cols = grid.rows * grid.cols, grid.cols

    def fill(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r, c = np.divmod(np.arange(area, dtype=np.int32), np.int32(cols))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(area, k, np.int32)), pa.array(r), pa.array(c), pa.array(np.frombuffer(data, "<f4"))], [*KEY, "v"])

    planes = [(k, bytearray(flat[k * area : (k + 1) * area].tobytes())) for k in range(len(grid.planes))]
    return spark.createDataFrame(planes, "k int, data binary").mapInArrow(fill, "k int, r int, c int, v float")


def generated(spark: SparkSession, grid: Grid, make) -> DataFrame:
    """k, r, c, v (float) of a column expression ``make(c, r, k)`` of the voxel's index columns, or of a
    function of index arrays that is marked with ``vectorised`` and runs plane by plane on executors."""
    grid.require_budget()
    if not getattr(make, "vectorised", False):
        return grid.voxel_table(spark).select(*KEY, make(F.col("c"), F.col("r"), F.col("k")).cast("float").alias("v"))
    rows, cols = grid.rows, grid.cols

    def fill(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                r, c = np.divmod(np.arange(rows * cols, dtype=np.int32), np.int32(cols))
                v = np.broadcast_to(np.asarray(make(c, r, np.full(len(c), k, np.int32)), dtype=np.float32), c.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k, np.int32)), pa.array(r), pa.array(c), pa.array(v)], [*KEY, "v"])

    planes = spark.range(len(grid.planes), numPartitions=min(len(grid.planes), 256)).select(F.col("id").cast("int").alias("k"))
    return planes.mapInArrow(fill, "k int, r int, c int, v float")


def vectorised(make):
    """Marks a callback of ``generated`` that takes and gives arrays."""
    make.vectorised = True
    return make


def value(field: DataFrame, grid: Grid, k: int, r: int, c: int) -> DataFrame:
    """v of one voxel; indices off the grid are refused."""
    grid.require_index(k=k, r=r, c=c)
    return field.filter((F.col("k") == k) & (F.col("r") == r) & (F.col("c") == c)).select("v")


def plane(field: DataFrame, grid: Grid, k: int) -> DataFrame:
    """The voxels of one plane; an index off the grid is refused."""
    grid.require_index(k=k)
    return field.filter(F.col("k") == k).select(*KEY, "v")


def continuous_index(points: DataFrame, grid: Grid) -> DataFrame:
    """Adds fx, fy, fz of the points x, y, z; fz is null outside the plane stack. On a single plane
    fz is 0, however far the point."""
    p = (F.col("x"), F.col("y"), F.col("z"))
    fx, fy = grid.pixel(p)
    out = points.withColumns({"fx": fx, "fy": fy})
    s = grid.projections
    if len(s) == 1:
        return out.withColumn("fz", F.lit(0.0))
    at = F.array(*map(F.lit, s))
    out = out.withColumn("_s", grid.projection(p))
    # the greatest k <= n - 2 whose projection is below the point's, else 0
    below = F.size(F.filter(F.array(*map(F.lit, s[:-1])), lambda q: q < F.col("_s")))
    out = out.withColumn("_k", F.greatest(below - 1, F.lit(0)))
    part = (F.col("_s") - at[F.col("_k")]) / (at[F.col("_k") + 1] - at[F.col("_k")])
    out = out.withColumn("fz", F.when((F.col("_s") >= s[0] - EDGE) & (F.col("_s") <= s[-1] + EDGE), F.col("_k") + part))
    return out.drop("_s", "_k")


def _clamp(x: Column, n: int) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(n - 1)).cast("int")


def _within(grid: Grid) -> Column:
    return F.col("fz").isNotNull() & F.col("fx").between(-0.5, grid.cols - 0.5) & F.col("fy").between(-0.5, grid.rows - 0.5)


def sample(points: DataFrame, field: DataFrame, grid: Grid, *, method: str = "trilinear", outside: float = 0.0) -> DataFrame:
    """The points (point_id, x, y, z) with ``value``: trilinear between the eight voxels around, or
    the nearest one; ``outside`` over half a voxel off in the plane, outside the plane stack, or where
    a voxel that it needs has no value."""
    if method not in ("trilinear", "nearest"):
        raise ValueError(f"unknown method {method}")
    at = continuous_index(points, grid).withColumn("inside", _within(grid))
    values = field.select(*(F.col(x).alias(f"_{x}") for x in KEY), F.col("v").cast("double").alias("_v"))
    on = [F.col(x) == F.col(f"_{x}") for x in KEY]
    planes = len(grid.planes)
    if method == "nearest":
        key = at.withColumns({"k": round_half_up(F.col("fz")), "r": round_half_up(F.col("fy")), "c": round_half_up(F.col("fx"))})
        ok = F.col("inside") & F.col("c").between(0, grid.cols - 1) & F.col("r").between(0, grid.rows - 1) & F.col("k").between(0, planes - 1)
        found = key.filter(ok).join(values, on).select("point_id", "_v")
    else:
        base = at.filter("inside").withColumns({"x0": F.floor("fx"), "y0": F.floor("fy"), "z0": F.floor("fz")})
        corner = base.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
        bit = lambda b: F.col("corner").bitwiseAND(1 << b) / (1 << b)
        corner = corner.withColumns({"c": _clamp(F.col("x0") + bit(0), grid.cols), "r": _clamp(F.col("y0") + bit(1), grid.rows), "k": _clamp(F.col("z0") + bit(2), planes)})
        got = corner.join(values, on).groupBy("point_id", "fx", "fy", "fz", "x0", "y0", "z0").agg(*(F.max(F.when(F.col("corner") == i, F.col("_v"))).alias(f"v{i}") for i in range(8)))
        tx, ty, tz = F.col("fx") - F.col("x0"), F.col("fy") - F.col("y0"), F.col("fz") - F.col("z0")
        row = [lerp(F.col(f"v{i}"), F.col(f"v{i + 1}"), tx) for i in (0, 2, 4, 6)]
        plane = [lerp(row[0], row[1], ty), lerp(row[2], row[3], ty)]
        found = got.select("point_id", (plane[0] if planes == 1 else lerp(plane[0], plane[1], tz)).alias("_v"))
    named = found.withColumnRenamed("point_id", "_id")
    return points.join(named, F.col("point_id") == F.col("_id"), "left").select("point_id", *(c for c in points.columns if c != "point_id"), F.coalesce("_v", F.lit(float(outside))).alias("value"))


def _targets(field: DataFrame, target: Grid) -> DataFrame:
    i = (F.col("k").cast("long") * target.rows + F.col("r")) * target.cols + F.col("c")
    return target.placed_voxels(field.sparkSession).select(i.alias("point_id"), "x", "y", "z")


def resample_field(field: DataFrame, grid: Grid, target: Grid, *, method: str = "trilinear", outside: float = 0.0, kernel: bool | None = None) -> DataFrame:
    """k, r, c, v (float) of the field on ``target``. ``kernel``: whether the source travels with
    the tasks; by default if it is small enough. Both ways give the same values."""
    grid.require_frame(target)
    target.require_budget()
    if kernel is None:
        kernel = grid.voxels <= KERNEL_VOXELS
    if kernel and grid.voxels > KERNEL_VOXELS:
        raise ValueError("the source is too large to travel with the tasks")
    if not kernel:
        from voxelmill.operators.masks import at_index

        out = sample(_targets(field, target), field, grid, method=method, outside=outside)
        return at_index(out.select(F.col("point_id").alias("i"), F.col("value").cast("float").alias("v")), target).select(*KEY, "v")
    import numpy as np

    rows = field.select(*KEY, "v").toArrow()
    dense = np.full((len(grid.planes), grid.rows, grid.cols), np.nan, rows.column("v").to_numpy().dtype)
    dense[tuple(rows.column(x).to_numpy() for x in KEY)] = rows.column("v").to_numpy()
    shared = field.sparkSession.sparkContext.broadcast(dense)

    def fill(batches):
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                v = sample_plane(shared.value, grid, target, k, method, outside)
                r, c = np.divmod(np.arange(len(v), dtype=np.int32), target.cols)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(v)], ["k", "r", "c", "v"])

    planes = field.sparkSession.range(len(target.planes), numPartitions=min(len(target.planes), 256)).select(F.col("id").cast("int").alias("k"))
    return planes.mapInArrow(fill, "k int, r int, c int, v float")


def sample_plane(dense, grid: Grid, target: Grid, k: int, method: str, outside: float):
    """Values on plane ``k`` of ``target`` from a dense source, as floats."""
    import numpy as np

    r, c = np.divmod(np.arange(target.rows * target.cols), target.cols)
    p = np.stack([target.planes[k][i] + target.row_dir[i] * c * target.spacing[1] + target.col_dir[i] * r * target.spacing[0] for i in range(3)])
    d = p - np.array(grid.planes[0])[:, None]
    fx, fy = (np.array(grid.row_dir) @ d) / grid.spacing[1], (np.array(grid.col_dir) @ d) / grid.spacing[0]
    s, n = np.array(grid.projections), len(grid.planes)
    if n == 1:
        fz, good = np.zeros(len(fx)), np.ones(len(fx), bool)
    else:
        at = np.array(grid.normal) @ p
        low = np.clip(np.searchsorted(s[:-1], at, side="left") - 1, 0, n - 2)
        fz, good = low + (at - s[low]) / (s[low + 1] - s[low]), (at >= s[0] - EDGE) & (at <= s[-1] + EDGE)
    good &= (fx >= -0.5) & (fx <= grid.cols - 0.5) & (fy >= -0.5) & (fy <= grid.rows - 0.5)
    if method == "nearest":
        i, j, m = (np.floor(f + 0.5).astype(np.int64) for f in (fx, fy, fz))
        good &= (i >= 0) & (i < grid.cols) & (j >= 0) & (j < grid.rows) & (m >= 0) & (m < n)
        v = dense[np.where(good, m, 0), np.where(good, j, 0), np.where(good, i, 0)].astype(np.float64)
    else:
        x0, y0, z0 = (np.floor(f).astype(np.int64) for f in (fx, fy, fz))
        cut = lambda a, m: np.clip(a, 0, m - 1)
        at = lambda a, b, e: dense[cut(z0 + e, n), cut(y0 + b, grid.rows), cut(x0 + a, grid.cols)].astype(np.float64)
        mix = lambda a, b, t: a + (b - a) * t
        plane = [mix(mix(at(0, 0, e), at(1, 0, e), fx - x0), mix(at(0, 1, e), at(1, 1, e), fx - x0), fy - y0) for e in ((0,) if n == 1 else (0, 1))]
        v = plane[0] if n == 1 else mix(plane[0], plane[1], fz - z0)
    return np.where(good & ~np.isnan(v), v, outside).astype(np.float32)


def resample_mask(masks: DataFrame, grid: Grid, target: Grid) -> DataFrame:
    """Masks on ``target``: voxels whose nearest source voxel is in the mask. Only the target's
    keys are mapped to source keys, and those meet the masks in one equi-join."""
    grid.require_frame(target)
    at = continuous_index(_targets(masks, target), grid).filter(_within(grid))
    key = at.select("point_id", round_half_up(F.col("fz")).cast("int").alias("k"), round_half_up(F.col("fy")).cast("int").alias("r"), round_half_up(F.col("fx")).cast("int").alias("c"))
    from voxelmill.operators.masks import at_index

    met = key.join(masks.select(*ID), KEY).select("mask_id", F.col("point_id").alias("i"))
    return at_index(met, target).select(*ID)


def supersample(field: DataFrame, field_grid: Grid, masks: DataFrame, grid: Grid, parts: int) -> DataFrame:
    """Samples of ``parts``^3 sub-centres of each masked voxel, each of an equal share of its
    volume; values are doubles, never rounded to floats."""
    field_grid.require_frame(grid)
    step = F.sequence(F.lit(0), F.lit(parts - 1))
    fine = masks.select(*ID).withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).withColumn("m", F.explode(step))
    shift = lambda x: (F.col(x) + 0.5) / parts - 0.5
    x, y, z = grid.patient(F.col("k"), F.col("r") + shift("j"), F.col("c") + shift("i"))
    n, deep = grid.normal, grid.thickness_of(F.col("k")) * shift("m")
    p = fine.select("mask_id", F.struct(*ID, "i", "j", "m").alias("point_id"), (x + deep * n[0]).alias("x"), (y + deep * n[1]).alias("y"), (z + deep * n[2]).alias("z"), (grid.volume_of(F.col("k")) / parts**3).alias("vol"))
    return sample(p, field, field_grid).select("mask_id", F.col("value").alias("v"), "vol")


def field_on(field: DataFrame, grid: Grid, target: Grid, **options) -> tuple[DataFrame, bool]:
    """The field on ``target`` and whether it had to be resampled: equal grids need no work."""
    return (field, False) if grid.same(target) else (resample_field(field, grid, target, **options), True)
