"""The codec, readers and writers, conversions and streaming ingest; structure of the library."""

import ast
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxelmill import errors
from voxelmill.operators import convert, segments, structures
from voxelmill.operators.dose_grid import DoseQuery
from voxelmill.operators.grid import create_grid, uniform_grid
from voxelmill.plans import catalog
from voxelmill.sources import codec, dicom
from voxelmill.streaming import ingest

G = uniform_grid(5, 7, 4, spacing=(1.5, 2), step=3, frame_uid="1.2.3")
ROOT = Path(__file__).resolve().parent.parent


def notes(parsed):
    return [d.code for d in parsed.diagnostics]


def test_codec_reads_both_sequence_forms_and_known_bytes():
    values = {"SOPClassUID": "1.2", "SOPInstanceUID": "1.2.3", "Rows": 7, "PixelSpacing": [1.5, 0.1234567], "SegmentSequence": [{"SegmentNumber": 3, "SegmentLabel": "ä b"}], "PixelData": b"\1\2\3"}
    data = codec.encode_file(values)
    assert data[128:132] == b"DICM" and b"\x28\x00\x10\x00US\x02\x00\x07\x00" in data
    view = codec.View(codec.decode_file(data))
    assert view.numbers("PixelSpacing") == [1.5, 0.123457] and view.sequence("SegmentSequence")[0].text("SegmentLabel") == "ä b" and view.raw("PixelData") == b"\1\2\3\0"
    item = codec.encode_dataset(codec.named({"SegmentNumber": 9}))
    open_ended = b"\x62\x00\x02\x00SQ\0\0\xff\xff\xff\xff" + b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + item + b"\xfe\xff\x0d\xe0\0\0\0\0" + b"\xfe\xff\xdd\xe0\0\0\0\0"
    assert codec.View(codec.Reader(open_ended).dataset(len(open_ended))).sequence("SegmentSequence")[0].integer("SegmentNumber") == 9


def test_structure_sets():
    box = [(0, 0, 0), (4, 0, 0), (4, 4, 0.1234567)]
    rois = [dicom.Roi(0, "Heart ", [dicom.Contour("CLOSED_PLANAR", box, ["1.9"])]), dicom.Roi(0, "Heart ", []), dicom.Roi(0, "Lung", [dicom.Contour("POINT", box[:1])], "PTV", 12.5)]
    got = dicom.parse_structures(dicom.write_structures(rois, shuffle=True))
    assert got.names() == ["Heart ", "Heart ", "Lung"] and got.numbers() == [1, 2, 3] and notes(got) == ["EMPTY_ROI"]
    assert got.roi(1).contours[0].points[2] == (4, 4, 0.123457) and got.roi(1).contours[0].sop_refs == ["1.9"] and got.roi("Lung").interpreted_type == "PTV" and got.roi(3).volume_cm3 == 12.5
    with pytest.raises(errors.AmbiguousRoiNameError):
        got.roi("Heart ")
    with pytest.raises(KeyError):
        got.roi("none")
    assert "MISSING_RT_ROI_OBSERVATIONS" in notes(dicom.parse_structures(dicom.write_structures(rois, observations=False)))
    with pytest.raises(errors.MalformedContourError):
        dicom.chunk_points([1, 2])


@pytest.mark.parametrize(("bits", "signed"), [(16, False), (16, True), (32, False), (32, True)])
def test_doses(bits, signed):
    stored = np.arange(4 * 5 * 7).reshape(4, 5, 7) - (70 if signed else 0)
    got = dicom.parse_dose(dicom.write_dose(G, stored, scaling=0.25, bits=bits, signed=signed))
    assert np.array_equal(got.values, (stored * 0.25).astype(np.float32)) and got.grid.same(G) and not got.diagnostics


def test_dose_frames_are_put_in_order_and_oddities_noted():
    stored = np.stack([np.full((5, 7), v) for v in (400, 200, 0)])
    got = dicom.parse_dose(dicom.write_dose(G, stored, scaling=None, units="RELATIVE", offsets=[4, 2, 0]))
    assert got.values[:, 0, 0].tolist() == [0, 200, 400] and [p[2] for p in got.grid.planes] == [0, 2, 4]
    assert notes(got) == ["MISSING_DOSE_GRID_SCALING", "DOSE_UNITS_NOT_GY", "DOSE_FRAMES_REORDERED", "GRID_FRAME_OFFSET_NONZERO_ORIGIN"]
    assert notes(dicom.parse_dose(dicom.write_dose(G, stored[:1], offsets=[0]))) == ["SINGLE_FRAME_DOSE_GRID"]
    with pytest.raises(errors.MalformedDoseGridError):
        dicom.parse_dose(dicom.write_dose(G, stored, offsets=[0, 1]))
    with pytest.raises(errors.NotDoseError):
        dicom.parse_dose(dicom.write_image(G, 0, "1.2"))


def arrays(n):
    return np.random.default_rng(n).random((4, 5, 7)) < 0.3


@pytest.mark.parametrize("sparse", [False, True])
def test_segmentations(sparse):
    a, b = arrays(1), arrays(2)
    a[0] = False
    two = [(dicom.Segment(1, "one", category=dicom.Code("T", "SRT", "x")), a), (dicom.Segment(300, "two"), b & ~a)]
    for kind in ("BINARY", "LABELMAP"):
        got = dicom.parse_segmentation(dicom.write_segmentation(kind, G, two, sparse=sparse))
        top = len(G.planes) - len(got.grid.planes)
        assert np.array_equal(got.mask(1)[-3:], a[-3:]) and np.array_equal(got.mask(300), (b & ~a)[top:]) and got.segments[0].category.value == "T"
        with pytest.raises(errors.SegmentationTypeMismatchError):
            got.field(1)
    fraction = np.linspace(0, 1, a.size).reshape(a.shape).astype(np.float32)
    got = dicom.parse_segmentation(dicom.write_segmentation("FRACTIONAL", G, [(dicom.Segment(1), fraction)], fractional_type="OCCUPANCY", maximum=200))
    assert np.abs(got.field(1) - fraction).max() <= 0.5 / 200 + 1e-6 and got.maximum == 200 and not got.diagnostics and np.array_equal(got.support(1), got.field(1) > 0)
    with pytest.raises(errors.SegmentationTypeMismatchError):
        got.mask(1)
    assert "FRACTIONAL_VALUES_LOOK_BINARY" in notes(dicom.parse_segmentation(dicom.write_segmentation("FRACTIONAL", G, [(dicom.Segment(1), a * 1.0)], fractional_type="PROBABILITY")))


def test_segmentation_writer_refuses():
    a = arrays(1)
    with pytest.raises(errors.LabelmapOverlapError):
        dicom.write_segmentation("LABELMAP", G, [(dicom.Segment(1), a), (dicom.Segment(2), a)])
    with pytest.raises(TypeError):
        dicom.write_segmentation("FRACTIONAL", G, [(dicom.Segment(1), a)])
    for bad in ([], [(dicom.Segment(0), a)], [(dicom.Segment(1), a), (dicom.Segment(1), a)]):
        with pytest.raises(ValueError):
            dicom.write_segmentation("BINARY", G, bad)
    with pytest.raises(ValueError):
        dicom.write_segmentation("BINARY", G, [(dicom.Segment(1), a & False)], sparse=True)
    with pytest.raises(errors.GridMismatchError):
        dicom.write_segmentation("BINARY", G, [(dicom.Segment(1), a[:2])])
    with pytest.raises(errors.NotSegmentationError):
        dicom.parse_segmentation(dicom.write_image(G, 0, "1.2"))


def test_series():
    files = [dicom.write_image(G, k, f"1.9.{k}") for k in (3, 2, 1, 0)]
    grid, slices, found = dicom.parse_series(files)
    assert grid.same(G) and slices == [(f"1.9.{k}", k) for k in (3, 2, 1, 0)] and [d.code for d in found] == ["SLICE_ORDER_REVERSED"]
    other = create_grid(5, 7, planes=[(0, 0, 20)], spacing=(1.5, 2.5), frame_uid="1.2.3")
    with pytest.raises(errors.InconsistentSeriesError):
        dicom.parse_series([*files, dicom.write_image(other, 0, "1.9.9")])


def test_conversions(spark):
    a = arrays(3)
    seg = dicom.parse_segmentation(dicom.write_segmentation("BINARY", G, [(dicom.Segment(1, "A"), a)]))
    data, record = convert.segmentation_to_structure(spark, seg, 1)
    assert record.lossy_steps[0]["disagreement"] == 0 and record.lossy_steps[0]["dice"] == 1
    back, second = convert.structure_to_segmentation(spark, dicom.parse_structures(data), "A", G)
    assert np.array_equal(dicom.parse_segmentation(back).mask(1), a) and not second.lossy_steps
    soft = dicom.parse_segmentation(dicom.write_segmentation("FRACTIONAL", G, [(dicom.Segment(1, "F"), a * 0.5)], fractional_type="PROBABILITY"))
    with pytest.raises(errors.MissingThresholdError):
        convert.segmentation_to_structure(spark, soft, 1)
    with pytest.raises(ValueError):
        convert.segmentation_to_structure(spark, soft, 1, threshold=2.0)
    with pytest.raises(errors.SegmentNotFoundError):
        convert.segmentation_to_structure(spark, soft, 5, threshold=0.5)
    _, cut = convert.segmentation_to_structure(spark, soft, 1, threshold=0.4)
    assert [s["kind"] for s in cut.lossy_steps] == ["threshold", "vectorize"] and cut.lossy_steps[0]["voxels_after"] == int(a.sum())
    _, raw = convert.segmentation_to_structure(spark, soft, 1, threshold=128, scale="raw")
    assert raw.lossy_steps[0]["voxels_after"] == int(a.sum()) and raw.lossy_steps[0]["maximum"] == 255
    _, none = convert.segmentation_to_structure(spark, soft, 1, threshold=200, scale="raw")
    assert none.notes == ["no voxel reaches the threshold", "the segment has no voxels"]
    labels = dicom.parse_segmentation(dicom.write_segmentation("LABELMAP", G, [(dicom.Segment(1, "L"), a)]))
    with pytest.raises(errors.SegmentationTypeMismatchError):
        convert.segmentation_to_structure(spark, labels, 1, threshold=0.5)


def test_loading_a_structure_set(spark):
    box = lambda z, size=3.0: [(0.0, 0.0, z), (size, 0.0, z), (size, size, z), (0.0, size, z)]
    inner = [(1.0, 1.0, 3.0), (2.4, 1.0, 3.0), (2.4, 2.4, 3.0), (1.0, 2.4, 3.0)]
    rois = [
        dicom.Roi(0, "ring", [dicom.Contour("CLOSED_PLANAR", box(3.0, 8.0)), dicom.Contour("CLOSED_PLANAR", inner)], frame_uid="9.9"),
        dicom.Roi(0, "refs", [dicom.Contour("CLOSED_PLANAR", box(0.0), ["1.9.2"]), dicom.Contour("CLOSED_PLANAR", box(8.0), ["1.9.77"]), dicom.Contour("POINT", box(0.0)[:1])]),
        dicom.Roi(0, "none", []),
    ]
    parsed = dicom.parse_structures(dicom.write_structures(rois))
    got = structures.load(spark, parsed, G, slices=[(f"1.9.{k}", k) for k in range(4)])
    assert {(r.mask_id, r.interpretation, r.all_by_sop) for r in got.rois.collect()} == {("1", "nested-even-odd", False), ("2", "none", False), ("3", None, None)}
    assert {n.code for n in got.notes} == {"EMPTY_ROI", "FRAME_OF_REFERENCE_MISMATCH"}
    codes = {(r.mask_id, r.contour_no, r.code) for r in got.diagnostics.collect()}
    assert codes == {("1", 1, "NESTED_CLOSED_PLANAR_INTERPRETED"), ("2", 0, "SOP_REFERENCE_PLANE_MISMATCH"), ("2", 0, "CONTOUR_PLANE_DISTANCE"), ("2", 1, "SOP_REFERENCE_UNRESOLVED"), ("2", 2, "UNSUPPORTED_CONTOUR_GEOMETRY")}
    assert {r.k for r in got.masks.filter("mask_id = '2'").collect()} == {2, 3}
    with pytest.raises(errors.FrameOfReferenceMismatchError):
        structures.load(spark, parsed, G, strictness="strict")
    assert "FRAME_OF_REFERENCE_MISMATCH" not in {n.code for n in structures.load(spark, parsed, G, strictness="silent").notes}
    mixed = dicom.parse_structures(dicom.write_structures([dicom.Roi(0, "x", [dicom.Contour("CLOSED_PLANAR", box(0.0)), dicom.Contour("CLOSEDPLANAR_XOR", box(0.0))])]))
    with pytest.raises(errors.XorHomogeneityError):
        structures.load(spark, mixed, G)
    back = dicom.parse_structures(structures.from_mask(got.masks.filter("mask_id = '1'"), G, "ring"))
    again = structures.load(spark, back, G).masks
    assert {(r.k, r.r, r.c) for r in again.collect()} == {(r.k, r.r, r.c) for r in got.masks.filter("mask_id = '1'").collect()}


def test_dose_queries_say_how_they_were_made(spark):
    g = uniform_grid(9, 9, 9)
    field = g.voxel_table(spark).select("k", "r", "c", F.lit(10.0).alias("v"))
    inner = uniform_grid(4, 4, 4, origin=(2, 2, 2))
    mask = inner.voxel_table(spark).select(F.lit("m").alias("mask_id"), "k", "r", "c")
    for parts in (None, 2):
        q = DoseQuery(field, g, supersample=parts)
        s = q.statistics(mask, inner).first()
        assert (s.min_value, s.max_value, s.voxels, s.method.supersample, s.method.resampled) == (10, 10, 64, parts or 1, parts is None)
        assert {r.value for r in q.dose_at([0, 95, 100], mask, inner).collect()} == {10}
        assert [r.fraction for r in q.volume_at([5, 10, 20], mask, inner).orderBy("threshold").collect()] == [1, 1, 0]
        assert q.histogram(mask, inner, 4).count() == 5
    for bad in ({"supersample": 5}, {"method": "cubic"}):
        with pytest.raises(ValueError):
            DoseQuery(field, g, **bad)
    with pytest.raises(ValueError):
        DoseQuery(field, g).dose_at([101], mask, inner)


def test_two_segments_of_a_label_map_must_not_meet(spark):
    rows = spark.createDataFrame([("1", 0, 0, 0), ("2", 0, 0, 0)], "mask_id string, k int, r int, c int")
    with pytest.raises(Exception, match="two segments claim one voxel"):
        segments.merge_labels(rows).collect()


def test_arriving_documents(spark, tmp_path):
    box = [(0, 0, 0), (4, 0, 0), (4, 4, 0)]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.dcm").write_bytes(dicom.write_structures([dicom.Roi(0, f"r{i}", [dicom.Contour("CLOSED_PLANAR", box)])]))
    query = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "state"), dicom.read_rois, str(tmp_path / "out"), files_per_batch=2)
    query.awaitTermination(60)
    time.sleep(0.1)
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["r0", "r1", "r2"]
    assert dicom.scan_files(spark, str(tmp_path / "in")).count() == 3


def test_identifiers_depend_on_all_content():
    """Two documents that differ anywhere have different UIDs; the same one written again has its own."""
    from voxelmill.sources.codec import View, decode_file

    uid = lambda data: View(decode_file(data)).text("SOPInstanceUID")
    grid = uniform_grid(2, 3, 2)
    roi = lambda x: [dicom.Roi(0, "a", [dicom.Contour("CLOSED_PLANAR", [(0.0, 0.0, 0.0), (x, 0.0, 0.0), (0.0, 4.0, 0.0)])])]
    stored = np.arange(12).reshape(2, 2, 3)
    mask = stored > 5
    segment = lambda v, **kw: dicom.write_segmentation("BINARY", grid, [(dicom.Segment(1, "s"), v)], **kw)
    for make, other in (
        (lambda: dicom.write_structures(roi(4.0)), dicom.write_structures(roi(5.0))),
        (lambda: dicom.write_dose(grid, stored), dicom.write_dose(grid, stored[:, :, ::-1])),
        (lambda: dicom.write_dose(grid, stored), dicom.write_dose(grid, stored, scaling=2.0)),
        (lambda: segment(mask), segment(mask[::-1])),
    ):
        assert make() == make() and uid(make()) != uid(other)


# --- the library as a whole ------------------------------------------------------------------


def test_nothing_else_imports_the_training_data_operators():
    for path in ROOT.glob("voxelmill/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("voxelmill.llm") for n in names), path


def test_lower_layers_do_not_import_higher_ones():
    below = {"functions": {"operators", "sources", "plans", "streaming"}, "operators": {"plans", "streaming"}, "sources": {"plans", "streaming"}, "streaming": {"plans"}}
    for layer, above in below.items():
        for path in (ROOT / "voxelmill" / layer).glob("*.py"):
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, ast.ImportFrom) and (node.module or "").startswith("voxelmill."):
                    assert node.module.split(".")[1] not in above, path


VOXEL_QUERIES = list(catalog.ORACLES)


@pytest.mark.parametrize("name", VOXEL_QUERIES)
def test_query_equals_its_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events".split():
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    ours, theirs = entry.queries()[name](spark, sf).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    tidy = lambda df: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert tidy(ours) == tidy(theirs)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 3 and "d95" in out.columns
