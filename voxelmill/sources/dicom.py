"""Structure sets, doses, segmentations and image series: files to tables and back.

Files are scanned with the ``binaryFile`` source and parsed by Arrow kernels, one document per row,
so a folder of any number of documents is one job; each ``read_*`` gives long tables keyed by
``doc``. The ``parse_*`` and ``write_*`` functions work on single documents.
"""

from __future__ import annotations

import dataclasses
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill import errors
from voxelmill.operators.grid import POSITION_MM, Diagnostic, Grid, Tolerance, create_grid, v_cross, v_dot, v_sub, v_unit
from voxelmill.sources.codec import TAGS, Reader, View, decode_file, encode_file, encode_item, named

#: Storage classes.
STRUCTURE_CLASS, DOSE_CLASS, SEGMENTATION_CLASS, CT_CLASS = "1.2.840.10008.5.1.4.1.1.481.3", "1.2.840.10008.5.1.4.1.1.481.2", "1.2.840.10008.5.1.4.1.1.66.4", "1.2.840.10008.5.1.4.1.1.2"


def uid(*parts) -> str:
    """A UID that depends on ``parts`` only, so the same document is written the same way twice."""
    return "2.25." + str(uuid.uuid5(uuid.NAMESPACE_OID, "|".join(map(str, parts))).int)


def digest(*parts) -> str:
    """A hash of content: bytes and views of them as they are, all else as its text, each with its length."""
    from hashlib import sha256

    out = sha256()
    for part in parts:
        data = part if isinstance(part, (bytes, memoryview)) else repr(part).encode()
        out.update(f"{len(data)}:".encode())
        out.update(data)
    return out.hexdigest()


def classify(view: View) -> str:
    """structure, dose, segmentation or image."""
    if view.has("StructureSetROISequence"):
        return "structure"
    modality = view.text("Modality")
    if modality == "RTDOSE" or view.has("GridFrameOffsetVector"):
        return "dose"
    return "segmentation" if modality == "SEG" else "image"


def _vectors(view: View, refuse, where: View | None = None) -> tuple:
    orientation = view.numbers("ImageOrientationPatient")
    spacing = (where or view).numbers("PixelSpacing")
    if orientation is None or len(orientation) != 6:
        raise refuse("missing or malformed ImageOrientationPatient")
    if spacing is None or len(spacing) != 2:
        raise refuse("missing or malformed PixelSpacing")
    return tuple(orientation[:3]), tuple(orientation[3:]), tuple(spacing)


def _positive(view: View, name: str, refuse) -> int:
    x = view.integer(name)
    if x is None or x <= 0:
        raise refuse(f"missing or invalid {name}")
    return x


# --- structure sets --------------------------------------------------------------------------


@dataclass
class Contour:
    geometric_type: str
    points: list[tuple[float, float, float]]
    sop_refs: list[str] = field(default_factory=list)


@dataclass
class Roi:
    number: int
    name: str
    contours: list[Contour]
    interpreted_type: str = "ORGAN"
    volume_cm3: float | None = None
    frame_uid: str | None = None


@dataclass
class StructureSet:
    rois: list[Roi]
    diagnostics: list[Diagnostic]

    def roi(self, which: int | str) -> Roi:
        """By number, or by a name that only one has."""
        found = [r for r in self.rois if which in (r.number, r.name)]
        if not found:
            raise KeyError(which)
        if len(found) > 1:
            raise errors.AmbiguousRoiNameError(f"{len(found)} ROIs are named {which!r}; ask by number")
        return found[0]

    def names(self) -> list[str]:
        return [r.name for r in self.rois]

    def numbers(self) -> list[int]:
        return [r.number for r in self.rois]

    def by_name(self, name: str) -> list[Roi]:
        return [r for r in self.rois if r.name == name]


def chunk_points(flat: list[float]) -> list[tuple[float, float, float]]:
    if len(flat) % 3:
        raise errors.MalformedContourError(f"contour data of {len(flat)} numbers is not a list of points")
    return list(zip(*[iter(flat)] * 3, strict=True))


def outline(c: View) -> Contour:
    """The contour of an item."""
    refs = [u for u in (i.text("ReferencedSOPInstanceUID") for i in c.sequence("ContourImageSequence")) if u]
    return Contour(c.text("ContourGeometricType") or "", chunk_points(c.numbers("ContourData") or []), refs)


def listed_rois(view: View, outlines: dict) -> list[Roi]:
    """The ROIs that are named, with their ``outlines`` by number; of repeated numbers the last counts.
    A name keeps its blanks if its length is noted with it."""
    kinds = {o.integer("ReferencedROINumber"): o.text("RTROIInterpretedType") or "ORGAN" for o in view.sequence("RTROIObservationsSequence")}
    rois: dict[int, Roi] = {}
    for item in view.sequence("StructureSetROISequence"):
        number = item.integer("ROINumber")
        if number is None:
            continue
        raw, noted = (item.raw("ROIName") or [""])[0], item.integer("ROINameLength")
        name = raw[:noted] if noted is not None and len(raw) > noted else raw
        rois[number] = Roi(number, name, outlines.get(number, []), kinds.get(number, "ORGAN"), item.number("ROIVolume"), item.text("ReferencedFrameOfReferenceUID"))
    return list(rois.values())


def parse_structures(data: bytes) -> StructureSet:
    """Names, contours and observations joined on the ROI number; of repeated numbers the last
    counts."""
    view = View(decode_file(data))
    outlines = {item.integer("ReferencedROINumber"): [outline(c) for c in item.sequence("ContourSequence")] for item in view.sequence("ROIContourSequence")}
    rois = listed_rois(view, outlines)
    notes = [] if view.has("RTROIObservationsSequence") else [Diagnostic("MISSING_RT_ROI_OBSERVATIONS", "info", "no observations; types are ORGAN")]
    if rois and not any(c.sop_refs for r in rois for c in r.contours):
        notes.append(Diagnostic("MISSING_CONTOUR_IMAGE_SEQUENCE", "info", "no contour refers to an image"))
    notes += [Diagnostic("EMPTY_ROI", "warning", f"ROI {r.number} has no contours", {"roi": r.number}) for r in rois if not r.contours]
    return StructureSet(rois, notes)


def scan_rois(data: bytes) -> list[Roi]:
    """The ROIs of a structure set without their contours, which are not read."""
    return listed_rois(View(decode_file(data, frozenset([TAGS["ROIContourSequence"][0]]))), {})


def scan_contours(data: bytes):
    """(ROI number, index, contour) of ``parse_structures``, one contour at a time."""
    tag = TAGS["ContourSequence"][0]
    view = View(decode_file(data, frozenset([tag])))
    spans = {item.integer("ReferencedROINumber"): item.raw("ContourSequence") for item in view.sequence("ROIContourSequence")}
    for roi in listed_rois(view, {}):
        at, length = spans.get(roi.number) or (0, 0)
        for i, item in enumerate(Reader(data, at).each(length)):
            yield roi.number, i, outline(View(item))


def contour_item(geometric_type: str, flat: list[float], sop_refs: list[str]) -> dict:
    """A contour as keywords; ``flat`` has the coordinates of all points."""
    return {"ContourGeometricType": geometric_type, "NumberOfContourPoints": len(flat) // 3, "ContourData": flat, "ContourImageSequence": [{"ReferencedSOPClassUID": CT_CLASS, "ReferencedSOPInstanceUID": u} for u in sop_refs] or None}


def structure_file(instance: str, rois: list[Roi], outlines: list, shuffle: bool, observations: bool) -> bytes:
    """A structure set of ``rois``, numbered from 1, and the contours of each (keywords or encoded items)."""
    numbered = list(enumerate(rois, 1))
    order = numbered[::-1] if shuffle else numbered
    return encode_file({
        "SOPClassUID": STRUCTURE_CLASS, "SOPInstanceUID": instance, "Modality": "RTSTRUCT", "StructureSetLabel": "VOXELS",
        "StructureSetROISequence": [{"ROINumber": n, "ROIName": r.name, "ROINameLength": str(len(r.name)), "ROIGenerationAlgorithm": "AUTOMATIC", "ReferencedFrameOfReferenceUID": r.frame_uid, "ROIVolume": r.volume_cm3} for n, r in numbered],
        "ROIContourSequence": [{"ReferencedROINumber": n, "ContourSequence": outlines[n - 1] or None} for n, r in order],
        "RTROIObservationsSequence": [{"ObservationNumber": n, "ReferencedROINumber": n, "RTROIInterpretedType": r.interpreted_type} for n, r in order] if observations else None,
    })


def write_structures(rois: list[Roi], *, shuffle: bool = False, observations: bool = True) -> bytes:
    """A structure set; ROIs are numbered from 1, coordinates have six decimals. ``shuffle`` writes
    the contour and observation sequences in another order than the names."""
    instance = uid("structures", digest(*(dataclasses.astuple(r) for r in rois), shuffle, observations))
    return structure_file(instance, rois, [[contour_item(c.geometric_type, [x for p in c.points for x in p], c.sop_refs) for c in r.contours] for r in rois], shuffle, observations)


# --- doses -----------------------------------------------------------------------------------


@dataclass
class Dose:
    grid: Grid
    values: object
    units: str
    scaling: float
    dose_type: str | None
    summation: str | None
    diagnostics: list[Diagnostic]


def parse_dose(data: bytes) -> Dose:
    """A dose with its frames in order along the normal and its values scaled, as floats."""
    import numpy as np

    view, refuse = View(decode_file(data)), errors.MalformedDoseGridError
    if view.text("SOPClassUID") not in (None, DOSE_CLASS) and view.text("Modality") != "RTDOSE":
        raise errors.NotDoseError("neither the storage class nor the modality is a dose")
    rows, cols = _positive(view, "Rows", refuse), _positive(view, "Columns", refuse)
    row, col, spacing = _vectors(view, refuse)
    origin = view.numbers("ImagePositionPatient")
    if origin is None or len(origin) != 3:
        raise refuse("missing or malformed ImagePositionPatient")
    frames = _positive(view, "NumberOfFrames", refuse) if view.has("NumberOfFrames") else 1
    offsets = view.numbers("GridFrameOffsetVector") or []
    if frames > 1 and len(offsets) != frames:
        raise refuse(f"{len(offsets)} frame offsets for {frames} frames")
    offsets = offsets or [0.0]
    notes = []
    scaling = view.number("DoseGridScaling")
    if scaling is None or not math.isfinite(scaling) or scaling <= 0:
        notes.append(Diagnostic("MISSING_DOSE_GRID_SCALING", "warning", "stored values are taken as scaled"))
        scaling = 1.0
    units = (view.text("DoseUnits") or "UNKNOWN").upper()
    if units != "GY":
        notes.append(Diagnostic("DOSE_UNITS_NOT_GY", "warning", f"values are in {units}"))
    bits, signed = view.integer("BitsAllocated") or 16, view.integer("PixelRepresentation") == 1
    kind = ("<i" if signed else "<u") + ("4" if bits == 32 else "2")
    pixels = view.raw("PixelData")
    if not isinstance(pixels, bytes) or len(pixels) < frames * rows * cols * int(kind[2]):
        raise refuse("PixelData is absent or too short")
    stored = np.frombuffer(pixels, kind, frames * rows * cols).reshape(frames, rows, cols)
    order = sorted(range(frames), key=lambda f: offsets[f])
    if order != list(range(frames)):
        notes.append(Diagnostic("DOSE_FRAMES_REORDERED", "info", "frames were sorted along the normal"))
    if abs(offsets[0]) > 1e-6:
        notes.append(Diagnostic("GRID_FRAME_OFFSET_NONZERO_ORIGIN", "info", f"the first offset is {offsets[0]}"))
    if frames == 1:
        notes.append(Diagnostic("SINGLE_FRAME_DOSE_GRID", "info", "one frame: no thickness of its own"))
    n = v_unit(v_cross(row, col))
    planes = [tuple(origin[i] + n[i] * offsets[f] for i in range(3)) for f in order]
    grid = create_grid(rows, cols, planes=planes, spacing=spacing, row_dir=row, col_dir=col, frame_uid=view.text("FrameOfReferenceUID"))
    return Dose(grid, (stored[order].astype(np.float64) * scaling).astype(np.float32), units, scaling, view.text("DoseType"), view.text("DoseSummationType"), notes)


def write_dose(grid: Grid, stored, *, scaling: float | None = 1.0, units: str = "GY", offsets: list[float] | None = None, bits: int = 32, signed: bool = False) -> bytes:
    """A dose of stored integers (plane, row, column)."""
    import numpy as np

    stored = np.asarray(stored)
    steps = offsets if offsets is not None else [p - grid.projections[0] for p in grid.projections]
    kind = ("<i" if signed else "<u") + str(bits // 8)
    return encode_file({
        "SOPClassUID": DOSE_CLASS, "SOPInstanceUID": uid("dose", digest(dataclasses.astuple(grid), steps, scaling, units, kind, stored.astype(kind).tobytes())), "Modality": "RTDOSE", "FrameOfReferenceUID": grid.frame_uid, "Rows": grid.rows, "Columns": grid.cols, "NumberOfFrames": len(stored), "PixelSpacing": list(grid.spacing), "ImageOrientationPatient": [*grid.row_dir, *grid.col_dir], "ImagePositionPatient": list(grid.planes[0]),
        "GridFrameOffsetVector": steps, "DoseGridScaling": scaling, "DoseUnits": units, "DoseType": "PHYSICAL", "DoseSummationType": "PLAN", "SamplesPerPixel": 1, "PhotometricInterpretation": "MONOCHROME2", "BitsAllocated": bits, "BitsStored": bits, "HighBit": bits - 1, "PixelRepresentation": int(signed), "PixelData": stored.astype(kind).tobytes(),
    }, "OW")


# --- segmentations ---------------------------------------------------------------------------


@dataclass
class Code:
    value: str | None
    scheme: str | None
    meaning: str | None


@dataclass
class Segment:
    number: int
    label: str = ""
    algorithm_type: str = "AUTOMATIC"
    algorithm_name: str | None = "voxels"
    category: Code | None = None
    property_type: Code | None = None
    modifier: Code | None = None
    tracking_id: str | None = None
    tracking_uid: str | None = None
    frame_count: int = 0


@dataclass
class Segmentation:
    kind: str
    grid: Grid
    segments: list[Segment]
    #: (segment number, plane, pixels) of each frame; pixels as stored
    frames: list[tuple[int, int, object]]
    fractional_type: str | None
    maximum: int | None
    overlap: str
    diagnostics: list[Diagnostic]

    def has(self, number: int) -> bool:
        return any(s.number == number for s in self.segments)

    def _need(self, number: int) -> None:
        if not self.has(number):
            raise errors.SegmentNotFoundError(f"there is no segment {number}")

    def mask(self, number: int):
        """The occupied voxels (plane, row, column) as booleans."""
        import numpy as np

        self._need(number)
        if self.kind == "FRACTIONAL":
            raise errors.SegmentationTypeMismatchError("a fractional segment has no mask; cut its field at a threshold")
        out = np.zeros((len(self.grid.planes), self.grid.rows, self.grid.cols), bool)
        for n, k, pixels in self.frames:
            if self.kind == "LABELMAP" or n == number:
                out[k] |= pixels == (number if self.kind == "LABELMAP" else 1)
        return out

    def raw_field(self, number: int):
        """Stored values as floats."""
        import numpy as np

        self._need(number)
        if self.kind != "FRACTIONAL":
            raise errors.SegmentationTypeMismatchError("only a fractional segment has a field")
        out = np.zeros((len(self.grid.planes), self.grid.rows, self.grid.cols), np.float32)
        for n, k, pixels in self.frames:
            if n == number:
                out[k] = pixels
        return out

    def field(self, number: int):
        """Fractions from 0 to 1 as floats."""
        import numpy as np

        return (self.raw_field(number).astype(np.float64) / (self.maximum or 255)).astype(np.float32)

    def support(self, number: int):
        return self.field(number) > 0 if self.kind == "FRACTIONAL" else self.mask(number)


def _code(view: View, name: str) -> Code | None:
    found = view.sequence(name)[:1]
    code = Code(*(found[0].text(n) for n in ("CodeValue", "CodingSchemeDesignator", "CodeMeaning"))) if found else None
    return code if code and (code.value or code.meaning) else None


def _frames_of(view: View, kind: str, frames: int, rows: int, cols: int, notes: list[Diagnostic]):
    """Pixels of all frames (frame, row, column)."""
    import numpy as np

    pixels, area = view.raw("PixelData"), rows * cols
    if not isinstance(pixels, bytes):
        raise errors.MalformedSegmentationError("PixelData is absent")
    if kind == "BINARY":
        whole, each = -(-frames * area // 8), -(-area // 8)
        if len(pixels) >= whole:
            return np.unpackbits(np.frombuffer(pixels, np.uint8), count=frames * area, bitorder="little").reshape(frames, rows, cols)
        # whole bytes for each frame are never fewer, so frames that fill them are read as running on:
        # the order of these checks is fixed by the data model
        if len(pixels) >= frames * each:
            notes.append(Diagnostic("BINARY_FRAMES_BYTE_ALIGNED", "info", "each frame fills whole bytes"))
            return np.unpackbits(np.frombuffer(pixels, np.uint8, frames * each).reshape(frames, each), axis=1, count=area, bitorder="little").reshape(frames, rows, cols)
    else:
        bits = view.integer("BitsAllocated") if kind == "LABELMAP" else 8
        if bits not in (8, 16):
            raise errors.MalformedSegmentationError(f"a label map has 8 or 16 bits, not {bits}")
        if len(pixels) >= frames * area * bits // 8:
            return np.frombuffer(pixels, f"<u{bits // 8}", frames * area).reshape(frames, rows, cols)
    raise errors.MalformedSegmentationError(f"PixelData of {len(pixels)} bytes is too short")


def distinct_positions(positions: list, normal) -> list:
    """Positions in the order of their first one, without those within the tolerance of one kept
    before. Only kept positions whose projections round to the same or a neighbouring step are
    compared, so many frames of many planes don't meet all with all."""
    kept: list = []
    near: dict[int, list] = {}
    for p in positions:
        step = math.floor(v_dot(p, normal) / POSITION_MM)
        found = (q for s in (step - 1, step, step + 1) for q in near.get(s, ()))
        if not any(abs(v_dot(v_sub(q, p), normal)) <= POSITION_MM and math.dist(q, p) <= POSITION_MM for q in found):
            kept.append(p)
            near.setdefault(step, []).append(p)
    return kept


def parse_segmentation(data: bytes) -> Segmentation:
    view, refuse = View(decode_file(data)), errors.MalformedSegmentationError
    if view.text("SOPClassUID") not in (None, SEGMENTATION_CLASS) and view.text("Modality") != "SEG":
        raise errors.NotSegmentationError("neither the storage class nor the modality is a segmentation")
    kind = (view.text("SegmentationType") or "").upper()
    if not kind:
        raise refuse("SegmentationType is absent")
    if kind not in ("BINARY", "FRACTIONAL", "LABELMAP"):
        raise errors.UnsupportedSegmentationTypeError(f"segmentation type {kind}")
    rows, cols, frames = (_positive(view, n, refuse) for n in ("Rows", "Columns", "NumberOfFrames"))
    shared = (view.sequence("SharedFunctionalGroupsSequence") or [View({})])[0]
    plane = (shared.sequence("PlaneOrientationSequence") or [View({})])[0]
    row, col, spacing = _vectors(plane, refuse, (shared.sequence("PixelMeasuresSequence") or [View({})])[0])
    per, notes, placed = view.sequence("PerFrameFunctionalGroupsSequence"), [], []
    if len(per) != frames:
        raise refuse(f"{len(per)} per-frame groups for {frames} frames")
    for i, group in enumerate(per):
        number = next((s.integer("ReferencedSegmentNumber") for s in group.sequence("SegmentIdentificationSequence")), None)
        position = next((p.numbers("ImagePositionPatient") for p in group.sequence("PlanePositionSequence")), None)
        if kind == "LABELMAP":
            number = number if number and number > 0 else 0
        elif not number or number <= 0:
            raise refuse(f"frame {i} names no segment")
        if position is None or len(position) != 3:
            raise refuse(f"frame {i} has no position")
        own = next((o.numbers("ImageOrientationPatient") for o in group.sequence("PlaneOrientationSequence")), None)
        if own and any(abs(a - b) > 1e-6 for a, b in zip(own, (*row, *col), strict=False)):
            notes.append(Diagnostic("PER_FRAME_ORIENTATION_VARIES", "warning", f"frame {i} has another orientation; the shared one is used"))
        placed.append((number, tuple(position)))
    items = view.sequence("SegmentSequence")
    if not items:
        raise refuse("SegmentSequence is absent or empty")
    segments = []
    for s in items:
        number = s.integer("SegmentNumber")
        if number is None or number <= 0:
            raise refuse("a segment has no valid number")
        count = frames if kind == "LABELMAP" else sum(n == number for n, _ in placed)
        segments.append(Segment(number, s.text("SegmentLabel") or "", s.text("SegmentAlgorithmType") or "", s.text("SegmentAlgorithmName"), _code(s, "SegmentedPropertyCategoryCodeSequence"), _code(s, "SegmentedPropertyTypeCodeSequence"), _code(s, "SegmentedPropertyTypeModifierCodeSequence"), s.text("TrackingID"), s.text("TrackingUID"), count))
    declared = {s.number for s in segments}
    if kind != "LABELMAP" and (unknown := [n for n, _ in placed if n not in declared]):
        raise refuse(f"frames name segment {unknown[0]}, which is not declared")
    distinct = distinct_positions([p for _, p in placed], v_unit(v_cross(row, col)))
    grid = create_grid(rows, cols, planes=distinct, spacing=spacing, row_dir=row, col_dir=col, frame_uid=view.text("FrameOfReferenceUID"))
    pixels = _frames_of(view, kind, frames, rows, cols, notes)
    fractional, maximum = None, None
    if kind == "FRACTIONAL":
        fractional = (view.text("SegmentationFractionalType") or "").upper()
        if fractional not in ("PROBABILITY", "OCCUPANCY"):
            fractional = None
            notes.append(Diagnostic("FRACTIONAL_TYPE_ABSENT", "warning", "neither probability nor occupancy is declared"))
        maximum = view.integer("MaximumFractionalValue")
        if not maximum or maximum <= 0:
            maximum = 255
            notes.append(Diagnostic("MISSING_MAX_FRACTIONAL_VALUE", "warning", "255 is assumed"))
        if looks_binary(int((pixels > 0).sum()), int((pixels[pixels > 0] >= near_maximum(maximum)).sum())):
            notes.append(Diagnostic("FRACTIONAL_VALUES_LOOK_BINARY", "warning", "almost all values are the maximum"))
    overlap = (view.text("SegmentsOverlap") or "UNDEFINED").upper()
    if overlap == "YES":
        notes.append(Diagnostic("SEGMENTS_OVERLAP", "info", "segments may share voxels"))
    return Segmentation(kind, grid, segments, [(n, grid.nearest_plane(p)[0], pixels[i]) for i, (n, p) in enumerate(placed)], fractional, maximum, overlap, notes)


def near_maximum(maximum: int) -> int:
    """The least value that counts as the maximum (within 2 %)."""
    return maximum - max(1, int(maximum * 0.02))


def looks_binary(occupied: int, extreme: int) -> bool:
    return occupied > 0 and extreme / occupied >= 0.98


def write_segmentation(kind: str, grid: Grid, segments: list[tuple[Segment, object]], *, fractional_type: str | None = None, maximum: int = 255, raw: bool = False, overlap: str | None = None, sparse: bool = False) -> bytes:
    """A segmentation of arrays (plane, row, column): booleans, or fractions (``raw``: stored
    values) if it is FRACTIONAL. ``sparse`` leaves out frames without any value."""
    import numpy as np

    if kind not in ("BINARY", "FRACTIONAL", "LABELMAP"):
        raise TypeError(f"unknown segmentation type {kind}")
    if kind == "FRACTIONAL" and fractional_type is None:
        raise TypeError("a fractional segmentation needs its fractional type")
    numbers = [s.number for s, _ in segments]
    if not numbers or any(not isinstance(n, int) or n <= 0 for n in numbers) or len(set(numbers)) < len(numbers):
        raise ValueError("segments need distinct positive numbers")
    if not 1 <= maximum <= 255:
        raise ValueError("the maximum is from 1 to 255")
    shape = (len(grid.planes), grid.rows, grid.cols)
    if any(np.shape(a) != shape for _, a in segments):
        raise errors.GridMismatchError("a segment is not on the grid")
    frames, bits = [], 1 if kind == "BINARY" else 8
    if kind == "LABELMAP":
        bits = 16 if max(numbers) > 255 else 8
        labels = np.zeros(shape, np.uint16)
        for s, a in segments:
            if labels[np.asarray(a, bool)].any():
                raise errors.LabelmapOverlapError("two segments claim one voxel; write them as BINARY")
            labels[np.asarray(a, bool)] = s.number
        frames = [(0, k, labels[k]) for k in range(shape[0])]
    else:
        for s, a in segments:
            stored = np.asarray(a, bool) if kind == "BINARY" else np.clip(np.floor(np.asarray(a, np.float64) * (1 if raw else maximum) + 0.5), 0, maximum)
            frames += [(s.number, k, stored[k].astype(np.uint8)) for k in range(shape[0])]
    frames = [f for f in frames if not sparse or f[2].any()]
    if not frames:
        raise ValueError("every segment is empty")
    pixels = np.stack([p for *_, p in frames])
    body = np.packbits(pixels.ravel(), bitorder="little").tobytes() if bits == 1 else pixels.astype(f"<u{bits // 8}").tobytes()
    code = lambda c, default: [{"CodeValue": x.value, "CodingSchemeDesignator": x.scheme, "CodeMeaning": x.meaning} for x in [c or default] if x]
    thick = grid.thickness(0) if shape[0] > 1 else 1.0
    group = lambda n, k: {"PlanePositionSequence": [{"ImagePositionPatient": list(grid.planes[k])}], "SegmentIdentificationSequence": None if kind == "LABELMAP" else [{"ReferencedSegmentNumber": n}]}
    return encode_file({
        "SOPClassUID": SEGMENTATION_CLASS, "SOPInstanceUID": uid("segmentation", digest(kind, dataclasses.astuple(grid), [dataclasses.astuple(s) for s, _ in segments], [(n, k) for n, k, _ in frames], fractional_type, maximum, overlap, body)), "Modality": "SEG", "SamplesPerPixel": 1, "PhotometricInterpretation": "MONOCHROME2", "Rows": grid.rows, "Columns": grid.cols, "NumberOfFrames": len(frames), "BitsAllocated": bits, "BitsStored": bits, "HighBit": bits - 1, "PixelRepresentation": 0, "SegmentationType": kind,
        "SegmentsOverlap": "NO" if kind == "LABELMAP" else overlap or ("NO" if len(segments) == 1 else "UNDEFINED"), "FrameOfReferenceUID": grid.frame_uid or uid("frame", grid.fingerprint()), "ContentLabel": "SEG",
        "SegmentSequence": [{"SegmentNumber": s.number, "SegmentLabel": s.label or f"segment-{s.number}", "SegmentAlgorithmType": s.algorithm_type, "SegmentAlgorithmName": s.algorithm_name, "SegmentedPropertyCategoryCodeSequence": code(s.category, Code("T-D0050", "SRT", "Tissue")), "SegmentedPropertyTypeCodeSequence": code(s.property_type, Code("T-62000", "SRT", "Liver")), "SegmentedPropertyTypeModifierCodeSequence": code(s.modifier, None) or None, "TrackingID": s.tracking_id, "TrackingUID": s.tracking_uid} for s, _ in segments],
        "SharedFunctionalGroupsSequence": [{"PlaneOrientationSequence": [{"ImageOrientationPatient": [*grid.row_dir, *grid.col_dir]}], "PixelMeasuresSequence": [{"PixelSpacing": list(grid.spacing), "SliceThickness": thick, "SpacingBetweenSlices": thick}]}],
        "PerFrameFunctionalGroupsSequence": [group(n, k) for n, k, _ in frames], "SegmentationFractionalType": fractional_type if kind == "FRACTIONAL" else None, "MaximumFractionalValue": maximum if kind == "FRACTIONAL" else None, "PixelData": body,
    }, "OW" if bits == 16 else "OB")


# --- image series ----------------------------------------------------------------------------


def write_image(grid: Grid, k: int, sop_uid: str, series_uid: str = "2.25.7") -> bytes:
    """An image instance of plane ``k``: its geometry only."""
    return encode_file({"SOPClassUID": CT_CLASS, "SOPInstanceUID": sop_uid, "Modality": "CT", "SeriesInstanceUID": series_uid, "FrameOfReferenceUID": grid.frame_uid, "Rows": grid.rows, "Columns": grid.cols, "PixelSpacing": list(grid.spacing), "ImageOrientationPatient": [*grid.row_dir, *grid.col_dir], "ImagePositionPatient": list(grid.planes[k])})


def parse_series(files: list[bytes], tol: Tolerance = Tolerance()) -> tuple[Grid, list[tuple[str, int]], list[Diagnostic]]:
    """The grid of an image series, the plane of each instance's UID, and what was noticed."""
    rows = []
    for data in files:
        view = View(decode_file(data))
        row, col, spacing = _vectors(view, errors.InconsistentSeriesError)
        position, sop = view.numbers("ImagePositionPatient"), view.text("SOPInstanceUID")
        if sop is None or position is None or len(position) != 3:
            raise errors.InconsistentSeriesError("an instance lacks its UID or position")
        rows.append((sop, create_grid(_positive(view, "Rows", errors.InconsistentSeriesError), _positive(view, "Columns", errors.InconsistentSeriesError), planes=[tuple(position)], spacing=spacing, row_dir=row, col_dir=col, frame_uid=view.text("FrameOfReferenceUID"))))
    if not rows:
        raise ValueError("a series needs an instance")
    first = rows[0][1]
    for sop, g in rows[1:]:
        here = Grid(g.rows, g.cols, g.row_dir, g.col_dir, g.spacing, first.planes, g.frame_uid)
        if not first.same(here, tol):
            raise errors.InconsistentSeriesError(f"instance {sop} differs from the first one")
    s = [v_dot(g.planes[0], first.normal) for _, g in rows]
    notes = [Diagnostic("SLICE_ORDER_REVERSED", "info", "instances came in reverse order")] if len(s) > 1 and all(b - a < -1e-6 for a, b in zip(s, s[1:], strict=False)) else []
    grid = create_grid(first.rows, first.cols, planes=[g.planes[0] for _, g in rows], spacing=first.spacing, row_dir=first.row_dir, col_dir=first.col_dir, frame_uid=first.frame_uid)
    return grid, [(sop, grid.nearest_plane(g.planes[0])[0]) for sop, g in rows], notes


# --- many documents at once ------------------------------------------------------------------

ROIS = "doc string, mask_id string, roi_number int, name string, interpreted_type string, volume_cm3 double, frame_uid string"
CONTOURS = "doc string, mask_id string, contour_no int, geometric_type string, points array<struct<x:double,y:double,z:double>>, sop_refs array<string>"
FIELDS = "doc string, k int, r int, c int, v float"
MASKS = "doc string, mask_id string, k int, r int, c int"


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """doc (the file's path) and content of all files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc"), "content")


def _rows(files: DataFrame, schema: str, parse) -> DataFrame:
    """The rows that ``parse(doc, content)`` yields for each document, in batches of one document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(schema))

    def kernel(batches):
        import pyarrow as pa

        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                made = parse(doc, content.as_py())
                yield made if isinstance(made, pa.RecordBatch) else pa.RecordBatch.from_pylist(list(made), shape)

    return files.select("doc", "content").mapInArrow(kernel, schema)


def read_rois(files: DataFrame) -> DataFrame:
    """The ROIs of structure sets; ``mask_id`` is doc#number."""
    return _rows(files, ROIS, lambda doc, data: ({"doc": doc, "mask_id": f"{doc}#{r.number}", "roi_number": r.number, "name": r.name, "interpreted_type": r.interpreted_type, "volume_cm3": r.volume_cm3, "frame_uid": r.frame_uid} for r in scan_rois(data)))


#: So many points, or contours, make a batch of rows.
BATCH_POINTS, BATCH_CONTOURS = 50_000, 10_000


def read_contours(files: DataFrame) -> DataFrame:
    """The contours of structure sets, ready for ``contours.associate``. A task holds a document as it
    is stored and a batch of its contours."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(CONTOURS))

    def table(doc, rows):
        import numpy as np
        import pyarrow as pa

        flat = np.array([x for *_, c in rows for p in c.points for x in p], np.float64).reshape(-1, 3)
        ends = np.cumsum([0, *(len(c.points) for *_, c in rows)])
        points = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=list("xyz"))
        columns = [[doc] * len(rows), [f"{doc}#{n}" for n, *_ in rows], [i for _, i, _ in rows], [c.geometric_type for *_, c in rows], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points), [c.sop_refs for *_, c in rows]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    def kernel(batches):
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, points = [], 0
                for row in scan_contours(content.as_py()):
                    rows.append(row)
                    points += len(row[2].points)
                    if points >= BATCH_POINTS or len(rows) >= BATCH_CONTOURS:
                        yield table(doc, rows)
                        rows, points = [], 0
                if rows:
                    yield table(doc, rows)

    return files.select("doc", "content").mapInArrow(kernel, CONTOURS)


def _voxels(doc: str, values, name: str | None = None):
    import numpy as np
    import pyarrow as pa

    at = np.argwhere(values) if name is not None else np.stack(np.unravel_index(np.arange(values.size), values.shape), axis=1)
    columns = {"doc": pa.array([doc] * len(at), pa.string())} | ({"mask_id": pa.array([name] * len(at), pa.string())} if name is not None else {})
    columns |= {n: pa.array(at[:, i].astype(np.int32)) for i, n in enumerate("krc")} | ({} if name is not None else {"v": pa.array(values.ravel())})
    return pa.RecordBatch.from_pydict(columns)


def read_doses(files: DataFrame) -> DataFrame:
    """doc, k, r, c, v of doses (scaled, floats, in plane order)."""
    return _rows(files, FIELDS, lambda doc, data: _voxels(doc, parse_dose(data).values))


def read_masks(files: DataFrame) -> DataFrame:
    """The voxels of all segments of binary segmentations and label maps; ``mask_id`` is doc#number."""

    def parse(doc, data):
        import pyarrow as pa

        seg = parse_segmentation(data)
        parts = [_voxels(doc, seg.mask(s.number), f"{doc}#{s.number}") for s in seg.segments]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]

    return _rows(files, MASKS, parse)


# --- many documents written at once: each in a task of its own, nothing on the driver ----------

WRITTEN = "doc string, content binary"


def _document(doc: str, content: bytes):
    import pyarrow as pa

    return pa.table({"doc": pa.array([doc], pa.string()), "content": pa.array([content], pa.binary())})


def write_structure_sets(contours: DataFrame, *, shuffle: bool = False, observations: bool = True) -> DataFrame:
    """doc, content of one structure set for each doc of ``contours`` (doc, mask_id, contour_no,
    geometric_type, points, sop_refs): a ROI for each mask_id, in the order of their names, its
    contours by number. Contours are encoded where they are; a task holds the encoded contours of one
    document, which have to fit a cell (2 GB)."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            parts = b.column(4).flatten().flatten()
            flat = np.stack([p.to_numpy(zero_copy_only=False) for p in parts], axis=1)
            stops = np.cumsum(b.column(4).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            spans, kinds, refs = zip([0, *stops], stops, strict=False), b.column(3).to_pylist(), b.column(5).to_pylist()
            items = [b"".join(encode_item(named(contour_item(kind, flat[start:stop].ravel().tolist(), rs or [])))) for (start, stop), kind, rs in zip(spans, kinds, refs, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(items, pa.binary())], ["doc", "mask_id", "contour_no", "item"])

    def write(key, t):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = t.select(["mask_id", "contour_no", "item"])
        t = t.take(pc.sort_indices(t, [("mask_id", "ascending"), ("contour_no", "ascending")])).combine_chunks()
        items = t.column("item").chunk(0)  # in order, so a ROI's items are one stretch of its bytes
        ends, data = memoryview(items.buffers()[1]).cast("i")[items.offset :], memoryview(items.buffers()[2])
        runs = pc.run_end_encode(t.column("mask_id").chunk(0))
        stops = runs.run_ends.to_pylist()
        rois = [Roi(0, name, []) for name in runs.values.to_pylist()]
        outlines = [data[ends[a] : ends[b]] for a, b in zip([0, *stops], stops, strict=False)]
        instance = uid("structures", digest(*(x for r, o in zip(rois, outlines, strict=True) for x in (r.name, o)), shuffle, observations))
        return pa.table({"doc": pa.array([key[0].as_py()], pa.string()), "content": pa.array([structure_file(instance, rois, outlines, shuffle, observations)], pa.binary())})

    kinds = dict(contours.dtypes)
    points = F.transform("points", lambda p: F.struct(*(p[a].cast("double").alias(a) for a in "xyz")))
    columns = contours.select("doc", "mask_id", "contour_no", "geometric_type", points.alias("points"), "sop_refs")
    encoded = columns.mapInArrow(encode, f"doc string, mask_id string, contour_no {kinds['contour_no']}, item binary")
    return encoded.groupBy("doc").applyInArrow(write, WRITTEN)


def write_doses(fields: DataFrame, grid: Grid, *, scaling: float = 1.0, **options) -> DataFrame:
    """doc, content of one dose on ``grid`` for each doc of ``fields`` (doc, k, r, c, v): values are
    stored as multiples of ``scaling``, halves up, voxels without a row as 0. A task holds one dose."""
    grid.require_budget()

    def write(key, t):
        import numpy as np

        stored = np.zeros((len(grid.planes), grid.rows, grid.cols), np.int64)
        at = tuple(t.column(x).to_numpy() for x in ("k", "r", "c"))
        stored[at] = np.floor(t.column("v").to_numpy().astype(np.float64) / scaling + 0.5)
        return _document(key[0].as_py(), write_dose(grid, stored, scaling=scaling, **options))

    return fields.select("doc", "k", "r", "c", "v").groupBy("doc").applyInArrow(write, WRITTEN)


def write_segmentations(masks: DataFrame, grid: Grid, *, kind: str = "BINARY", **options) -> DataFrame:
    """doc, content of one segmentation on ``grid`` for each doc of ``masks`` (doc, mask_id, k, r, c): a
    segment for each mask_id, numbered from 1 in the order of their names. A task holds one document,
    a byte for each voxel and segment."""
    grid.require_budget()

    def write(key, t):
        import numpy as np

        values: dict[str, object] = {}
        names = t.column("mask_id").to_pylist()
        for name in sorted(set(names)):
            own = np.array([n == name for n in names])
            values[name] = np.zeros((len(grid.planes), grid.rows, grid.cols), bool)
            values[name][tuple(t.column(x).to_numpy()[own] for x in ("k", "r", "c"))] = True
        return _document(key[0].as_py(), write_segmentation(kind, grid, [(Segment(i, name), v) for i, (name, v) in enumerate(values.items(), 1)], **options))

    return masks.select("doc", "mask_id", "k", "r", "c").groupBy("doc").applyInArrow(write, WRITTEN)
