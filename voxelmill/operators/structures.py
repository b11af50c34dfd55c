"""Whole structure sets on a grid: all ROIs in one plan, with what was noticed on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill import errors
from voxelmill.operators import contours, masks
from voxelmill.operators.grid import Diagnostic, Grid
from voxelmill.sources import dicom

DIAGNOSTICS = "mask_id string, contour_no int, code string, severity string, k int, distance_mm double"


@dataclass
class Structures:
    """``masks`` (mask_id, k, r, c), ``rois`` (one row each: name, type, counts, association, hole
    interpretation), ``diagnostics`` of contours, and ``notes`` on the document and its ROIs.
    ``mask_id`` is the ROI number."""

    masks: DataFrame
    rois: DataFrame
    diagnostics: DataFrame
    notes: list[Diagnostic]
    grid: Grid | None = None

    def mask(self, number: int | str) -> DataFrame:
        """The voxels of one ROI, by its number (in ``load_tables`` by its mask_id)."""
        return self.masks.filter(F.col("mask_id") == str(number))

    def mask_plane(self, number: int | str, k: int) -> DataFrame:
        """The voxels of one ROI on one plane; an index off the grid is refused."""
        return masks.plane(self.mask(number), self.grid, k)


def contour_table(spark: SparkSession, structures: dicom.StructureSet) -> DataFrame:
    rows = [(str(r.number), i, c.geometric_type, c.points, c.sop_refs) for r in structures.rois for i, c in enumerate(r.contours)]
    return spark.createDataFrame(rows, "mask_id string, contour_no int, geometric_type string, points array<struct<x:double,y:double,z:double>>, sop_refs array<string>")


def contour_diagnostics(placed: DataFrame, nested: DataFrame, grid: Grid) -> DataFrame:
    """What is odd about single contours (see ``DIAGNOSTICS``): types that are skipped, references
    that are unknown or point elsewhere, points far from their plane, nesting."""
    shapes = placed.filter(contours.fillable())
    at = F.array(*map(F.lit, grid.projections))[F.col("k")]
    off = F.transform("points", lambda p: F.abs(grid.projection((p["x"], p["y"], p["z"])) - at))
    far = F.when(F.col("distance_mm") > F.col("tolerance_mm"), F.col("distance_mm")).otherwise(F.get(F.filter(off, lambda d: d > F.col("tolerance_mm")), F.lit(0)))

    def note(rows: DataFrame, code: str, severity: str, distance="distance_mm") -> DataFrame:
        return rows.select("mask_id", "contour_no", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "k", F.col(distance).cast("double").alias("distance_mm"))

    out = note(placed.filter(~contours.fillable()), "UNSUPPORTED_CONTOUR_GEOMETRY", "warning")
    out = out.union(note(shapes.filter(F.col("via_sop") & (F.col("k") != F.col("k_geo"))), "SOP_REFERENCE_PLANE_MISMATCH", "info"))
    out = out.union(note(shapes.filter("unresolved"), "SOP_REFERENCE_UNRESOLVED", "info"))
    out = out.union(note(shapes.withColumn("_far", far).filter("_far is not null"), "CONTOUR_PLANE_DISTANCE", "warning", "_far"))
    return out.union(note(nested.filter("inside").withColumn("distance_mm", F.lit(None)), "NESTED_CLOSED_PLANAR_INTERPRETED", "info"))


def load(spark: SparkSession, structures: dicom.StructureSet, grid: Grid, *, slices: list[tuple[str, int]] | None = None, strictness: str = "warn") -> Structures:
    """All ROIs of a structure set as masks. ``slices`` (UID, plane; see ``dicom.parse_series``) lets
    references decide planes. ``strictness`` says what a differing frame of reference does: warn,
    strict (fail) or silent."""
    _known_strictness(strictness)
    grid.require_budget()
    notes = [n for n in structures.diagnostics if n.code != "MISSING_CONTOUR_IMAGE_SEQUENCE" or slices is not None]
    notes += _other_frames([(r.number, r.name, r.frame_uid) for r in structures.rois], grid, strictness)
    for r in structures.rois:
        xor = sum(c.geometric_type == "CLOSEDPLANAR_XOR" for c in r.contours)
        if 0 < xor < len(r.contours):
            raise errors.XorHomogeneityError(f"ROI {r.name!r} mixes XOR contours with other types")
    known = None if slices is None else spark.createDataFrame(slices, "sop_uid string, k int")
    base = spark.createDataFrame([(str(r.number), r.name, r.interpreted_type, r.volume_cm3, r.frame_uid, len(r.contours)) for r in structures.rois], "mask_id string, name string, interpreted_type string, volume_cm3 double, frame_uid string, n_contours int")
    return _loaded(contour_table(spark, structures), base, grid, known, notes)


def load_tables(table: DataFrame, rois: DataFrame, grid: Grid, *, slices: DataFrame | None = None, strictness: str = "warn") -> Structures:
    """``load`` for structure sets of any size and number: ``table`` and ``rois`` as
    ``dicom.read_contours`` and ``dicom.read_rois`` give them, ``slices`` (sop_uid, k). ``mask_id`` is
    doc#number. Only ROIs that something is wrong with come to the driver. ``table`` is read once for
    that and once for each result."""
    _known_strictness(strictness)
    grid.require_budget()
    notes = []
    if strictness != "silent" and grid.frame_uid is not None:
        other = rois.filter(F.col("frame_uid") != grid.frame_uid).orderBy("mask_id")
        notes = _other_frames([(r.mask_id, r.name, r.frame_uid) for r in other.select("mask_id", "name", "frame_uid").collect()], grid, strictness)
    mixed = contours.homogeneous(table).filter("mixed").join(rois, "mask_id").select("name").first()
    if mixed:
        raise errors.XorHomogeneityError(f"ROI {mixed.name!r} mixes XOR contours with other types")
    counts = table.groupBy("mask_id").agg(F.count("*").cast("int").alias("n_contours"))
    base = rois.join(counts, "mask_id", "left").select("mask_id", "name", "interpreted_type", "volume_cm3", "frame_uid", F.coalesce("n_contours", F.lit(0)).alias("n_contours"))
    return _loaded(table.select("mask_id", "contour_no", "geometric_type", "points", "sop_refs"), base, grid, slices, notes)


def _known_strictness(strictness: str) -> None:
    if strictness not in ("warn", "strict", "silent"):
        raise ValueError(f"unknown strictness {strictness}")


def _other_frames(rois: list[tuple], grid: Grid, strictness: str) -> list[Diagnostic]:
    """Notes on the ROIs (number, name, frame of reference) that are in another frame than the grid."""
    notes = []
    for number, name, frame in rois:
        if strictness != "silent" and None not in (frame, grid.frame_uid) and frame != grid.frame_uid:
            message = f"ROI {name!r} is in another frame of reference than the grid"
            if strictness == "strict":
                raise errors.FrameOfReferenceMismatchError(message)
            notes.append(Diagnostic("FRAME_OF_REFERENCE_MISMATCH", "warning", message, {"roi": number}))
    return notes


def _loaded(table: DataFrame, base: DataFrame, grid: Grid, known: DataFrame | None, notes: list[Diagnostic]) -> Structures:
    placed = contours.associate(contours.checked(table), grid, known)
    shapes = placed.filter(contours.fillable())
    rois = base.join(contours.association_summary(shapes), "mask_id", "left").join(contours.hole_interpretation(shapes, grid), "mask_id", "left")
    nested = contours.nesting(placed.filter(F.col("geometric_type") == "CLOSED_PLANAR"), grid)
    return Structures(contours.rasterize(placed, grid), rois, contour_diagnostics(placed, nested, grid), notes, grid)


def from_mask(mask: DataFrame, grid: Grid, name: str, *, interpreted_type: str = "ORGAN", frame_uid: str | None = None) -> bytes:
    """A structure set of one ROI, traced around a mask."""
    rows = contours.vectorize(mask, grid).orderBy("contour_no").collect()
    made = [dicom.Contour(r.geometric_type, [(p.x, p.y, p.z) for p in r.points]) for r in rows]
    return dicom.write_structures([dicom.Roi(1, name, made, interpreted_type, frame_uid=frame_uid or grid.frame_uid)])
