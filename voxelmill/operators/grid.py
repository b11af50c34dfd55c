"""Sampling grids: small, immutable, on the driver; their planes are a table of a row each."""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelmill import errors

Vec3 = tuple[float, float, float]

#: Sameness of grids, and the limits of grid construction.
POSITION_MM, SPACING_MM, ANGLE_RAD = 0.5, 0.01, 1e-3
DUPLICATE_MM, OFF_AXIS_MM, BASIS_RAD = 1e-3, 0.5, 1e-3
UNIFORM_MM = 1e-3
MAX_VOXELS = 256 * 1024 * 1024


def v_sub(a: Vec3, b: Vec3) -> Vec3:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def v_dot(a: Vec3, b: Vec3) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def v_cross(a: Vec3, b: Vec3) -> Vec3:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def v_unit(a: Vec3) -> Vec3:
    size = math.sqrt(v_dot(a, a))
    if not math.isfinite(size) or size < 1e-9:
        raise ValueError(f"cannot normalize {a}")
    return a[0] / size, a[1] / size, a[2] / size


def v_angle(a: Vec3, b: Vec3) -> float:
    return math.acos(max(-1.0, min(1.0, v_dot(a, b) / math.sqrt(v_dot(a, a) * v_dot(b, b)))))


@dataclass(frozen=True)
class Tolerance:
    position_mm: float = POSITION_MM
    spacing_mm: float = SPACING_MM
    angle_rad: float = ANGLE_RAD


@dataclass(frozen=True)
class Diagnostic:
    code: str
    severity: str
    message: str
    detail: dict = field(default_factory=dict)


def sort_planes(positions: list[Vec3], normal: Vec3) -> tuple[list[Vec3], list[Diagnostic]]:
    """Positions by their projection. One within 1e-3 mm of the last kept one is dropped and
    reported; one that is not finite or lies over 0.5 mm off the first one's axis is refused."""
    n = v_unit(normal)
    for p in positions:
        if not all(map(math.isfinite, p)):
            raise ValueError(f"plane position {p} is not finite")
        d = v_sub(p, positions[0])
        along = v_dot(d, n)
        off = v_sub(d, (n[0] * along, n[1] * along, n[2] * along))
        if math.sqrt(v_dot(off, off)) > OFF_AXIS_MM:
            raise errors.NonParallelPlanesError(f"plane at {p} is off the grid's axis")
    kept: list[Vec3] = []
    notes = []
    for p in sorted(positions, key=lambda p: v_dot(p, n)):
        if kept and abs(v_dot(p, n) - v_dot(kept[-1], n)) <= DUPLICATE_MM:
            notes.append(Diagnostic("DUPLICATE_PLANE_POSITION", "info", "a plane position occurs twice", {"projection": v_dot(p, n)}))
        else:
            kept.append(p)
    return kept, notes


@dataclass(frozen=True)
class Grid:
    """rows x columns pixels on sorted planes. ``spacing`` is (between rows, between columns)."""

    rows: int
    cols: int
    row_dir: Vec3
    col_dir: Vec3
    spacing: tuple[float, float]
    planes: tuple[Vec3, ...]
    frame_uid: str | None = None

    @cached_property
    def normal(self) -> Vec3:
        return v_unit(v_cross(self.row_dir, self.col_dir))

    @cached_property
    def projections(self) -> list[float]:
        return [v_dot(p, self.normal) for p in self.planes]

    @property
    def voxels(self) -> int:
        return self.rows * self.cols * len(self.planes)

    def thickness(self, k: int) -> float:
        """Half the distance between the neighbours of a plane; at an end, that to the only one."""
        s = self.projections
        if len(s) < 2:
            raise errors.IndeterminateVolumeError("a single plane has no thickness")
        return (s[min(k + 1, len(s) - 1)] - s[max(k - 1, 0)]) / (2 if 0 < k < len(s) - 1 else 1)

    @property
    def mean_spacing(self) -> float | None:
        s = self.projections
        return (s[-1] - s[0]) / (len(s) - 1) if len(s) > 1 else None

    def uniform(self, tolerance: float = UNIFORM_MM) -> bool:
        s = self.projections
        return all(abs((b - a) - (s[1] - s[0])) <= tolerance for a, b in zip(s[1:], s[2:], strict=False))

    def same(self, other: Grid, tol: Tolerance = Tolerance()) -> bool:
        """Equality within tolerances: symmetric, but not transitive, so never a join key."""
        if None not in (self.frame_uid, other.frame_uid) and self.frame_uid != other.frame_uid:
            return False
        if (self.rows, self.cols, len(self.planes)) != (other.rows, other.cols, len(other.planes)):
            return False
        if any(abs(a - b) > tol.spacing_mm for a, b in zip(self.spacing, other.spacing, strict=True)):
            return False
        if v_angle(self.row_dir, other.row_dir) > tol.angle_rad or v_angle(self.col_dir, other.col_dir) > tol.angle_rad:
            return False
        return all(math.dist(a, b) <= tol.position_mm for a, b in zip(self.planes, other.planes, strict=True))

    def require_same(self, other: Grid, tol: Tolerance = Tolerance()) -> None:
        if not self.same(other, tol):
            raise errors.GridMismatchError("the inputs are on different grids; resample one first")

    def require_frame(self, other: Grid) -> None:
        if None not in (self.frame_uid, other.frame_uid) and self.frame_uid != other.frame_uid:
            raise errors.FrameOfReferenceMismatchError("the inputs are in different frames of reference")

    def require_budget(self, most: int = MAX_VOXELS) -> None:
        if self.voxels > most:
            raise errors.ResourceLimitError(f"{self.voxels} voxels, {most} allowed")

    def require_index(self, *, k: int | None = None, r: int | None = None, c: int | None = None) -> None:
        """Integers within the grid; what is None isn't looked at."""
        for name, i, n in (("plane", k, len(self.planes)), ("row", r, self.rows), ("column", c, self.cols)):
            if i is not None and (not isinstance(i, int) or not 0 <= i < n):
                raise IndexError(f"{name} {i!r} is not in 0..{n - 1}")

    def fingerprint(self) -> str:
        """Equal fingerprints hint at equal grids; different ones prove nothing."""
        three = lambda xs: ",".join(f"{x:.3f}" for x in xs)
        return "|".join([str(self.rows), str(self.cols), three(self.spacing), three(self.row_dir), three(self.col_dir), ";".join(map(three, self.planes)), self.frame_uid or ""])

    def nearest_plane(self, p: Vec3) -> tuple[int, float]:
        s, all_ = v_dot(p, self.normal), self.projections
        at = bisect_left(all_, s)
        k = min(range(max(at - 1, 0), min(at + 1, len(all_))), key=lambda i: abs(all_[i] - s))
        return k, abs(all_[k] - s)

    def to_patient(self, c: float, r: float, k: int) -> Vec3:
        o, (pr, pc) = self.planes[k], self.spacing
        return tuple(o[i] + self.row_dir[i] * c * pc + self.col_dir[i] * r * pr for i in range(3))

    def centre(self) -> Vec3:
        """The middle of the middle pixels and of the first and last plane."""
        a, b = (self.to_patient((self.cols - 1) / 2, (self.rows - 1) / 2, k) for k in (0, len(self.planes) - 1))
        return tuple((x + y) / 2 for x, y in zip(a, b, strict=True))

    def plane_table(self, spark: SparkSession) -> DataFrame:
        """k, x, y, z, proj and thickness of each plane (null for a single one)."""
        rows = [(k, *p, s, self.thickness(k) if len(self.planes) > 1 else None) for k, (p, s) in enumerate(zip(self.planes, self.projections, strict=True))]
        return spark.createDataFrame(rows, "k int, x double, y double, z double, proj double, thickness double")

    def thickness_of(self, k: Column) -> Column:
        """The thickness as a look-up in a literal array: no join for so few values."""
        if len(self.planes) < 2:
            raise errors.IndeterminateVolumeError("a single plane has no thickness")
        return F.array(*(F.lit(float(self.thickness(i))) for i in range(len(self.planes))))[k]

    def volume_of(self, k: Column) -> Column:
        """The volume of a voxel on plane ``k`` in mm3."""
        return self.thickness_of(k) * (self.spacing[0] * self.spacing[1])

    def voxel_table(self, spark: SparkSession) -> DataFrame:
        """All voxels k, r, c, made from a range."""
        self.require_budget()
        i, area = F.col("id"), self.rows * self.cols
        return spark.range(self.voxels).select(F.expr(f"cast(id div {area} as int)").alias("k"), F.expr(f"cast((id % {area}) div {self.cols} as int)").alias("r"), (i % self.cols).cast("int").alias("c"))

    def placed_voxels(self, spark: SparkSession) -> DataFrame:
        """All voxels k, r, c with their patient coordinates x, y, z. Starts from the planes, so that a
        plane's origin is an attribute of its rows and not looked up for each of them."""
        self.require_budget()
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        origins = spark.createDataFrame([(k, *p) for k, p in enumerate(self.planes)], "k int, ox double, oy double, oz double").repartition(min(len(self.planes), 256), "k")
        rows = origins.withColumn("r", every(self.rows)).withColumn("c", every(self.cols))
        at = lambda i, o: F.col(o) + F.lit(float(self.row_dir[i])) * F.col("c") * F.lit(float(self.spacing[1])) + F.lit(float(self.col_dir[i])) * F.col("r") * F.lit(float(self.spacing[0]))
        return rows.select("k", "r", "c", *(at(i, o).alias(o[1]) for i, o in enumerate(("ox", "oy", "oz"))))

    def patient(self, k: Column, r: Column, c: Column) -> tuple[Column, Column, Column]:
        """Patient coordinates of index columns."""
        origin = [F.array(*(F.lit(float(p[i])) for p in self.planes))[k] for i in range(3)]
        return tuple(origin[i] + F.lit(float(self.row_dir[i])) * c * F.lit(float(self.spacing[1])) + F.lit(float(self.col_dir[i])) * r * F.lit(float(self.spacing[0])) for i in range(3))

    def pixel(self, p, k: Column | None = None) -> tuple[Column, Column]:
        """Fractional (column, row) of a patient point, seen along the normal from plane ``k`` (default: the first)."""
        origin = [F.array(*(F.lit(float(q[i])) for q in self.planes))[F.lit(0) if k is None else k] for i in range(3)]
        d = [p[i] - origin[i] for i in range(3)]
        along = lambda v: d[0] * float(v[0]) + d[1] * float(v[1]) + d[2] * float(v[2])
        return along(self.row_dir) / float(self.spacing[1]), along(self.col_dir) / float(self.spacing[0])

    def projection(self, p) -> Column:
        n = self.normal
        return p[0] * n[0] + p[1] * n[1] + p[2] * n[2]

    def nearest(self, s: Column) -> Column:
        """The plane nearest to a projection, ties to the lower index."""
        away = F.transform(F.array(*map(F.lit, self.projections)), lambda q: F.abs(q - s))
        return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def create_grid(rows: int, cols: int, *, planes: list[Vec3], spacing=(1.0, 1.0), row_dir: Vec3 = (1.0, 0.0, 0.0), col_dir: Vec3 = (0.0, 1.0, 0.0), frame_uid: str | None = None) -> Grid:
    """A checked grid; duplicate planes are dropped silently (see ``sort_planes`` for the report)."""
    if not (isinstance(rows, int) and isinstance(cols, int) and rows > 0 and cols > 0):
        raise ValueError("rows and columns must be positive integers")
    if not all(math.isfinite(x) and x > 0 for x in spacing):
        raise ValueError("pixel spacing must be positive")
    if not planes:
        raise ValueError("a grid needs a plane")
    row, col = v_unit(row_dir), v_unit(col_dir)
    if abs(v_angle(row, col) - math.pi / 2) > BASIS_RAD:
        raise errors.NonOrthogonalBasisError("row and column direction must be orthogonal")
    kept, _ = sort_planes([tuple(map(float, p)) for p in planes], v_cross(row, col))
    return Grid(rows, cols, row, col, (float(spacing[0]), float(spacing[1])), tuple(kept), frame_uid)


def uniform_grid(rows: int, cols: int, count: int, *, spacing=(1.0, 1.0), step: float = 1.0, origin: Vec3 = (0.0, 0.0, 0.0), row_dir: Vec3 = (1.0, 0.0, 0.0), col_dir: Vec3 = (0.0, 1.0, 0.0), frame_uid: str | None = None) -> Grid:
    if not step > 0:
        raise ValueError("slice spacing must be positive")
    n = v_unit(v_cross(v_unit(row_dir), v_unit(col_dir)))
    planes = [tuple(origin[i] + n[i] * step * k for i in range(3)) for k in range(count)]
    return create_grid(rows, cols, planes=planes, spacing=spacing, row_dir=row_dir, col_dir=col_dir, frame_uid=frame_uid)


# --- the same on tables of many grids -------------------------------------------------------


def plane_thickness(planes: DataFrame, key: str = "grid_id") -> DataFrame:
    """Adds ``thickness`` (null for a single plane) to planes of many grids (key, k, proj)."""
    w = Window.partitionBy(key).orderBy("proj")
    before, after = F.lag("proj").over(w), F.lead("proj").over(w)
    return planes.withColumn("thickness", F.coalesce((after - before) / 2, after - F.col("proj"), F.col("proj") - before))


GRID_TYPE = "struct<rows:int,cols:int,row_dir:array<double>,col_dir:array<double>,spacing:array<double>,planes:array<array<double>>,frame_uid:string>"


def same_column(a: Column, b: Column, tol: Tolerance = Tolerance()) -> Column:
    """``Grid.same`` of two grids that are columns of ``GRID_TYPE``, planes sorted. Symmetric, but not
    transitive: a test for pairs that are given, not a key to join on."""
    apart = lambda p, q: F.sqrt(sum(((p[i] - q[i]) * (p[i] - q[i]) for i in range(3)), F.lit(0.0)))
    size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    cosine = lambda p, q: (p[0] * q[0] + p[1] * q[1] + p[2] * q[2]) / (size(p) * size(q))
    angle = lambda n: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a[n], b[n]))))
    frames = a["frame_uid"].isNull() | b["frame_uid"].isNull() | (a["frame_uid"] == b["frame_uid"])
    sizes = (a["rows"] == b["rows"]) & (a["cols"] == b["cols"]) & (F.size(a["planes"]) == F.size(b["planes"]))
    spacing = (F.abs(a["spacing"][0] - b["spacing"][0]) <= tol.spacing_mm) & (F.abs(a["spacing"][1] - b["spacing"][1]) <= tol.spacing_mm)
    near = F.forall(F.zip_with(a["planes"], b["planes"], apart), lambda d: d <= tol.position_mm)
    return frames & sizes & F.when(sizes, spacing & (angle("row_dir") <= tol.angle_rad) & (angle("col_dir") <= tol.angle_rad) & near).otherwise(False)


def uniform_flags(planes: DataFrame, key: str = "grid_id", tolerance: float = UNIFORM_MM) -> DataFrame:
    """key, uniform: every gap within ``tolerance`` of the first one; under three planes: true."""
    w = Window.partitionBy(key).orderBy("proj")
    gaps = planes.select(key, F.row_number().over(w).alias("i"), (F.col("proj") - F.lag("proj").over(w)).alias("gap"))
    gaps = gaps.withColumn("first", F.min(F.when(F.col("i") == 2, F.col("gap"))).over(Window.partitionBy(key)))
    return gaps.groupBy(key).agg(F.coalesce(F.bool_and(F.abs(F.col("gap") - F.col("first")) <= tolerance), F.lit(True)).alias("uniform"))


def sorted_planes(planes: DataFrame, key: str = "grid_id", tolerance: float = DUPLICATE_MM) -> DataFrame:
    """key, k, proj: planes by projection, each over ``tolerance`` from the last kept one. A fold
    over each grid's sorted projections: comparing neighbours would be wrong on chains."""
    sorted_ = planes.groupBy(key).agg(F.array_sort(F.collect_list("proj")).alias("all"))

    def step(kept, p):
        return F.when((F.size(kept) > 0) & (F.abs(p - F.element_at(kept, -1)) <= tolerance), kept).otherwise(F.concat(kept, F.array(p)))

    kept = F.aggregate("all", F.array().cast("array<double>"), lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(step(a, p)))
    return sorted_.select(key, F.posexplode(kept).alias("k", "proj"))


def reversed_flags(planes: DataFrame, key: str = "grid_id", order: str = "i") -> DataFrame:
    """key, reversed: every projection lies over 1e-6 below the one before in input order."""
    step = F.col("proj") - F.lag("proj").over(Window.partitionBy(key).orderBy(order))
    return planes.select(key, step.alias("step")).groupBy(key).agg(F.coalesce(F.bool_and(F.col("step") < -1e-6), F.lit(False)).alias("reversed"))


def ordered_frames(frames: DataFrame, key: str, offset: str = "offset", frame: str = "frame") -> DataFrame:
    """Adds ``place``: the position of each frame by offset (then as stored), and ``reordered``:
    whether any frame of its document moves."""
    w = Window.partitionBy(key)
    out = frames.withColumn("place", F.row_number().over(w.orderBy(offset, frame)) - 1).withColumn("_stored", F.row_number().over(w.orderBy(frame)) - 1)
    return out.withColumn("reordered", F.bool_or(F.col("place") != F.col("_stored")).over(w)).drop("_stored")
