"""Structure sets to segmentations and back, with provenance that is measured, not assumed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill import errors
from voxelmill.operators import contours, masks
from voxelmill.operators.grid import Grid
from voxelmill.sources import dicom

VERSION = "0.1.0"


@dataclass
class Provenance:
    direction: str
    grid: dict
    lossy_steps: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    software: str = f"voxelmill {VERSION}"


def summary(grid: Grid) -> dict:
    return {"rows": grid.rows, "columns": grid.cols, "planes": len(grid.planes), "frame_uid": grid.frame_uid}


def contour_table(spark: SparkSession, roi: dicom.Roi, mask_id: str) -> DataFrame:
    rows = [(mask_id, i, c.geometric_type, c.points, c.sop_refs) for i, c in enumerate(roi.contours)]
    return spark.createDataFrame(rows, "mask_id string, contour_no int, geometric_type string, points array<struct<x:double,y:double,z:double>>, sop_refs array<string>")


def roi_mask(spark: SparkSession, roi: dicom.Roi, grid: Grid, slices: DataFrame | None = None) -> DataFrame:
    """The voxels of a ROI on a grid."""
    table = contours.checked(contour_table(spark, roi, roi.name))
    if any(r.mixed for r in contours.homogeneous(table).collect()):
        raise errors.XorHomogeneityError(f"ROI {roi.name!r} mixes XOR contours with other types")
    return contours.rasterize(contours.associate(table, grid, slices), grid)


def dense(mask: DataFrame, grid: Grid):
    """A mask as booleans (plane, row, column), for a writer."""
    import numpy as np

    grid.require_budget()
    rows = mask.select(*masks.KEY).toArrow()
    out = np.zeros((len(grid.planes), grid.rows, grid.cols), bool)
    out[tuple(rows.column(x).to_numpy() for x in masks.KEY)] = True
    return out


def sparse(spark: SparkSession, values, name: str) -> DataFrame:
    """An array (plane, row, column) of booleans as a mask. The plan holds a row for each plane that
    has voxels, which tasks take apart."""
    import numpy as np

    cols, area = values.shape[2], values.shape[1] * values.shape[2]

    def fill(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r, c = np.divmod(np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), count=area)).astype(np.int32), np.int32(cols))
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(r)), pa.array(np.full(len(r), k, np.int32)), pa.array(r), pa.array(c)], masks.ID)

    planes = [(k, bytearray(np.packbits(values[k]).tobytes())) for k in range(len(values)) if values[k].any()]
    return spark.createDataFrame(planes, "k int, data binary").mapInArrow(fill, "mask_id string, k int, r int, c int")


def structure_to_segmentation(spark: SparkSession, structures: dicom.StructureSet, roi: int | str, grid: Grid, *, number: int = 1, label: str | None = None) -> tuple[bytes, Provenance]:
    """A ROI as a BINARY segmentation: the voxels are copied, so no step loses anything."""
    found = structures.roi(roi)
    values = dense(roi_mask(spark, found, grid), grid)
    record = Provenance("structure-to-segmentation", summary(grid), notes=[] if values.any() else ["the ROI has no voxels"])
    segment = dicom.Segment(number, label or found.name, "SEMIAUTOMATIC")
    return dicom.write_segmentation("BINARY", grid, [(segment, values)]), record


def segmentation_to_structure(spark: SparkSession, seg: dicom.Segmentation, number: int, *, threshold: float | None = None, scale: str = "unit", name: str | None = None) -> tuple[bytes, Provenance]:
    """A segment as closed contours. A fractional one is cut at ``threshold``, a fraction in (0, 1]
    or, with scale ``raw``, a stored value; what the outlines lose is measured by filling them."""
    if not seg.has(number):
        raise errors.SegmentNotFoundError(f"there is no segment {number}")
    record = Provenance("segmentation-to-structure", summary(seg.grid))
    if seg.kind == "BINARY":
        values = seg.mask(number)
        if threshold is not None:
            record.notes.append("the threshold was ignored: a binary segment needs none")
    else:
        if threshold is None:
            raise errors.MissingThresholdError("this segment is not binary: give a threshold")
        top = {"unit": 1, "raw": seg.maximum or 255}.get(scale)
        if top is None or not 0 < threshold <= top:
            raise ValueError(f"the threshold {threshold} ({scale}) is not in (0, {top}]")
        stored = seg.field(number) if scale == "unit" else seg.raw_field(number)
        values = stored >= threshold
        if seg.fractional_type is None:
            record.notes.append("whether the values are probabilities or occupancies is not declared")
        if not values.any():
            record.notes.append("no voxel reaches the threshold")
        record.lossy_steps.append({"kind": "threshold", "threshold": threshold, "scale": scale, "fractional_type": seg.fractional_type, "maximum": seg.maximum, "voxels_before": int((stored > 0).sum()), "voxels_after": int(values.sum())})
    label = name or next(s.label for s in seg.segments if s.number == number) or f"segment-{number}"
    mask = sparse(spark, values, "m")
    loops = contours.vectorize(mask, seg.grid)
    rows = loops.orderBy("contour_no").collect()
    made = [dicom.Contour(r.geometric_type, [(p.x, p.y, p.z) for p in r.points]) for r in rows]
    data = dicom.write_structures([dicom.Roi(1, label, made, frame_uid=seg.grid.frame_uid)])
    back = roi_mask(spark, dicom.parse_structures(data).rois[0], seg.grid).withColumn("mask_id", F.lit("m"))
    # named, so that a segment without voxels is measured too
    got = masks.overlap(mask, seg.grid, back, seg.grid, names=["m"]).first()
    record.lossy_steps.append({"kind": "vectorize", "voxels_before": int(got.n_a), "voxels_after": int(got.n_b), "disagreement": int(got.disagreement), "dice": float(got.dice)})
    if not made:
        record.notes.append("the segment has no voxels")
    return data, record
