"""A small DICOM Part 10 codec: explicit VR little-endian, nested sequences of either length form.

A dataset is a dict from tag (``(group << 16) | element``) to ``(vr, value)``; a sequence's value is
a list of datasets, a binary one is bytes, numbers and strings are lists.
"""

from __future__ import annotations

import struct

EXPLICIT_LE = "1.2.840.10008.1.2.1"
#: Tags by keyword with their VR (value representation).
TAGS = {
    "FileMetaInformationGroupLength": (0x00020000, "UL"), "FileMetaInformationVersion": (0x00020001, "OB"), "MediaStorageSOPClassUID": (0x00020002, "UI"), "MediaStorageSOPInstanceUID": (0x00020003, "UI"), "TransferSyntaxUID": (0x00020010, "UI"), "ImplementationClassUID": (0x00020012, "UI"),
    "SOPClassUID": (0x00080016, "UI"), "SOPInstanceUID": (0x00080018, "UI"), "Modality": (0x00080060, "CS"), "CodeValue": (0x00080100, "SH"), "CodingSchemeDesignator": (0x00080102, "SH"), "CodeMeaning": (0x00080104, "LO"), "ReferencedSOPClassUID": (0x00081150, "UI"), "ReferencedSOPInstanceUID": (0x00081155, "UI"),
    "SliceThickness": (0x00180050, "DS"), "SpacingBetweenSlices": (0x00180088, "DS"), "SeriesInstanceUID": (0x0020000E, "UI"), "ImagePositionPatient": (0x00200032, "DS"), "ImageOrientationPatient": (0x00200037, "DS"), "FrameOfReferenceUID": (0x00200052, "UI"), "PlanePositionSequence": (0x00209113, "SQ"), "PlaneOrientationSequence": (0x00209116, "SQ"),
    "SamplesPerPixel": (0x00280002, "US"), "PhotometricInterpretation": (0x00280004, "CS"), "NumberOfFrames": (0x00280008, "IS"), "Rows": (0x00280010, "US"), "Columns": (0x00280011, "US"), "PixelSpacing": (0x00280030, "DS"), "BitsAllocated": (0x00280100, "US"), "BitsStored": (0x00280101, "US"), "HighBit": (0x00280102, "US"), "PixelRepresentation": (0x00280103, "US"), "PixelMeasuresSequence": (0x00289110, "SQ"),
    "SegmentationType": (0x00620001, "CS"), "SegmentSequence": (0x00620002, "SQ"), "SegmentedPropertyCategoryCodeSequence": (0x00620003, "SQ"), "SegmentNumber": (0x00620004, "US"), "SegmentLabel": (0x00620005, "LO"), "SegmentAlgorithmType": (0x00620008, "CS"), "SegmentAlgorithmName": (0x00620009, "LO"), "SegmentIdentificationSequence": (0x0062000A, "SQ"), "ReferencedSegmentNumber": (0x0062000B, "US"), "MaximumFractionalValue": (0x0062000E, "US"), "SegmentedPropertyTypeCodeSequence": (0x0062000F, "SQ"), "SegmentationFractionalType": (0x00620010, "CS"), "SegmentedPropertyTypeModifierCodeSequence": (0x00620011, "SQ"), "SegmentsOverlap": (0x00620013, "CS"), "TrackingID": (0x00620020, "UT"), "TrackingUID": (0x00620021, "UI"), "ContentLabel": (0x00700080, "CS"),
    "DoseUnits": (0x30040002, "CS"), "DoseType": (0x30040004, "CS"), "DoseSummationType": (0x3004000A, "CS"), "GridFrameOffsetVector": (0x3004000C, "DS"), "DoseGridScaling": (0x3004000E, "DS"),
    "StructureSetLabel": (0x30060002, "SH"), "ContourImageSequence": (0x30060016, "SQ"), "StructureSetROISequence": (0x30060020, "SQ"), "ROINumber": (0x30060022, "IS"), "ReferencedFrameOfReferenceUID": (0x30060024, "UI"), "ROIName": (0x30060026, "LO"), "ROIVolume": (0x3006002C, "DS"), "ROIGenerationAlgorithm": (0x30060036, "CS"), "ROIContourSequence": (0x30060039, "SQ"), "ContourSequence": (0x30060040, "SQ"), "ContourGeometricType": (0x30060042, "CS"), "NumberOfContourPoints": (0x30060046, "IS"), "ContourData": (0x30060050, "DS"), "RTROIObservationsSequence": (0x30060080, "SQ"), "ObservationNumber": (0x30060082, "IS"), "ReferencedROINumber": (0x30060084, "IS"), "RTROIInterpretedType": (0x300600A4, "CS"),
    "SharedFunctionalGroupsSequence": (0x52009229, "SQ"), "PerFrameFunctionalGroupsSequence": (0x52009230, "SQ"), "PixelData": (0x7FE00010, "OB"), "ROINameLength": (0x00091001, "LO"),
}
LONG_FORM = frozenset("OB OD OF OL OW SQ UC UN UR UT".split())
NUMERIC = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}
ITEM, ITEM_END, SEQUENCE_END, UNKNOWN_LENGTH = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF
#: The greatest even length of a value whose length takes two bytes; the VR of each tag.
LONGEST_SHORT = 0xFFFE
VRS = dict(TAGS.values())


def decimal(x: float) -> str:
    """A decimal string of at most six places and sixteen characters."""
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text if len(text) <= 16 else f"{x:.9g}"


def _tag(tag: int) -> bytes:
    return struct.pack("<HH", tag >> 16, tag & 0xFFFF)


def _value(vr: str, value) -> bytes:
    if vr in NUMERIC:
        return b"".join(struct.pack("<" + NUMERIC[vr], int(x) if vr in ("US", "SS", "UL", "SL") else x) for x in value)
    if isinstance(value, bytes):
        return value + b"\0" * (len(value) % 2)
    text = "\\".join(decimal(x) if vr == "DS" else str(x) for x in value).encode()
    return text + (b"\0" if vr == "UI" else b" ") * (len(text) % 2)


def encode_parts(dataset: dict) -> list:
    """The bytes of a dataset in pieces. A sequence may be given as its encoded items (bytes or a view
    of them), which are not copied."""
    out: list = []
    for tag in sorted(dataset):
        vr, value = dataset[tag]
        if vr != "SQ":
            body = [_value(vr, value)]
        elif isinstance(value, (bytes, memoryview)):
            body = [value]
        else:
            body = [x for item in value for x in encode_item(item)]
        size = sum(map(len, body))
        if vr not in LONG_FORM and size > LONGEST_SHORT:
            vr = "UN"  # by the standard: a value too long for its own form
        out += [_tag(tag) + vr.encode() + (struct.pack("<HI", 0, size) if vr in LONG_FORM else struct.pack("<H", size)), *body]
    return out


def encode_item(dataset: dict) -> list:
    """An item of a sequence in pieces."""
    body = encode_parts(dataset)
    return [_tag(ITEM) + struct.pack("<I", sum(map(len, body))), *body]


def encode_dataset(dataset: dict) -> bytes:
    return b"".join(encode_parts(dataset))


def named(values: dict) -> dict:
    """A dataset from keywords; sequences are lists of such dicts or encoded items, None is left out."""
    out = {}
    for name, value in values.items():
        if value is not None:
            tag, vr = TAGS[name]
            out[tag] = (vr, value if isinstance(value, (bytes, memoryview)) else [named(v) for v in value] if vr == "SQ" else value if isinstance(value, (list, tuple)) else [value])
    return out


def encode_file(values: dict, pixel_vr: str = "OB") -> bytes:
    """A Part 10 file of a dataset given by keywords."""
    body = named(values)
    if (pixels := TAGS["PixelData"][0]) in body:
        body[pixels] = (pixel_vr, body[pixels][1])
    meta = named({"FileMetaInformationVersion": b"\0\1", "MediaStorageSOPClassUID": values["SOPClassUID"], "MediaStorageSOPInstanceUID": values["SOPInstanceUID"], "TransferSyntaxUID": EXPLICIT_LE, "ImplementationClassUID": "2.25.1"})
    head = encode_dataset(meta)
    return b"".join([b"\0" * 128 + b"DICM", encode_dataset(named({"FileMetaInformationGroupLength": len(head)})), head, *encode_parts(body)])


class Reader:
    """Reads elements one after another; raw text keeps its padding. A sequence whose tag is in
    ``lazy`` is left as (place, length), to be read by ``each``."""

    def __init__(self, data: bytes, at: int = 0, lazy: frozenset[int] = frozenset()):
        self.data, self.at, self.lazy = data, at, lazy

    def number(self, code: str):
        (x,) = struct.unpack_from("<" + code, self.data, self.at)
        self.at += struct.calcsize(code)
        return x

    def tag(self) -> int:
        return self.number("H") << 16 | self.number("H")

    def each(self, length: int):
        """The items of a sequence, one after another."""
        end = len(self.data) if length == UNKNOWN_LENGTH else self.at + length
        while self.at < end:
            tag, size = self.tag(), self.number("I")
            if tag == SEQUENCE_END:
                break
            yield self.dataset(end if size == UNKNOWN_LENGTH else self.at + size)

    def items(self, length: int) -> list[dict]:
        return list(self.each(length))

    def dataset(self, end: int) -> dict:
        out = {}
        while self.at < end:
            tag = self.tag()
            if tag == ITEM_END:
                self.at += 4
                break
            vr = self.data[self.at : self.at + 2].decode("latin1")
            self.at += 2
            if vr in LONG_FORM:
                self.at += 2
                length = self.number("I")
            else:
                length = self.number("H")
            if vr == "UN" and length != UNKNOWN_LENGTH:
                vr = VRS.get(tag, vr)
            if vr == "SQ" or length == UNKNOWN_LENGTH:
                if tag not in self.lazy:
                    out[tag] = ("SQ", self.items(length))
                    continue
                out[tag] = ("SQ", (self.at, length))
                if length == UNKNOWN_LENGTH:
                    for _ in self.each(length):
                        pass
                else:
                    self.at += length
                continue
            body = self.data[self.at : self.at + length]
            self.at += length
            if vr in NUMERIC:
                size = struct.calcsize(NUMERIC[vr])
                out[tag] = (vr, list(struct.unpack(f"<{len(body) // size}{NUMERIC[vr]}", body)))
            elif vr in ("OB", "OW", "OD", "OF", "OL", "UN"):
                out[tag] = (vr, body)
            else:
                out[tag] = (vr, body.decode("utf-8", "replace").split("\\") if body else [])
        return out


def decode_file(data: bytes, lazy: frozenset[int] = frozenset()) -> dict:
    """The dataset of a Part 10 file without its file meta information. See ``Reader`` for ``lazy``."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM Part 10 file")
    return {t: v for t, v in Reader(data, 132, lazy).dataset(len(data)).items() if t >> 16 != 2}


class View:
    """Values of a dataset by keyword, trimmed and converted; absent is None."""

    def __init__(self, dataset: dict):
        self.dataset = dataset

    def raw(self, name: str):
        return self.dataset.get(TAGS[name][0], (None, None))[1]

    def has(self, name: str) -> bool:
        return TAGS[name][0] in self.dataset

    def text(self, name: str) -> str | None:
        value = self.raw(name)
        return value[0].strip(" \0") or None if value else None

    def numbers(self, name: str) -> list[float] | None:
        value = self.raw(name)
        if value is None:
            return None
        try:
            return [float(x) for x in value]
        except ValueError:
            return None

    def number(self, name: str) -> float | None:
        value = self.numbers(name)
        return value[0] if value else None

    def integer(self, name: str) -> int | None:
        x = self.number(name)
        return int(x) if x is not None and x == int(x) else None

    def sequence(self, name: str) -> list[View]:
        return [View(x) for x in self.raw(name) or []]
