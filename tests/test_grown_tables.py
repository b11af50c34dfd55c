"""What only other tables than the small ones show: masks that become empty, contours of many points,
and documents that are written and read in the tasks."""

import math
import pickle

import duckdb
import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from voxelmill import errors
from voxelmill.operators import report, structures
from voxelmill.operators.grid import uniform_grid
from voxelmill.sources import codec, dicom

SF = "/root/testdata/sf0.001"


def oracle(name, folder, tables):
    with duckdb.connect() as con:
        for table in tables:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
        return con.execute(entry.oracle_sql()[name]).fetchall()


@pytest.fixture(scope="module")
def cheap(tmp_path_factory):
    """Line items at half their price: no voxel is left in A and C."""
    folder = tmp_path_factory.mktemp("cheap")
    for table, rows in (("lineitem", "* REPLACE (l_extendedprice / 2 AS l_extendedprice)"), ("events", "*")):
        duckdb.execute(f"COPY (SELECT {rows} FROM '{SF}/{table}.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["segmentation_to_structure", "supersampled_stats"])
def test_an_empty_mask_has_its_row(spark, cheap, name):
    rows = entry.queries()[name](spark, cheap).collect()
    assert [tuple(r) for r in rows] == oracle(name, cheap, ["lineitem", "events"]) and len(rows) == 1


CONTOURS = "mask_id string, contour_no int, geometric_type string, points array<struct<x:double,y:double,z:double>>, sop_refs array<string>"


def slow_revisits(points, near_mm=0.05):
    """exact and near, by all pairs of points."""
    met = [math.dist(p, q) for i, p in enumerate(points) for j, q in enumerate(points) if 3 <= j - i < len(points) - 1 and p and q]
    return any(d == 0 for d in met), any(d < near_mm for d in met)


def wandering(rng, n, step, flat):
    """A contour on a lattice of ``step``, moved a little so that it lies across cells."""
    p = rng.integers(0, 40, (n, 3)) * step + rng.uniform(-1, 1, 3) * 1000
    if flat:
        p[:, 2] = 7.0
    return [tuple(map(float, x)) for x in p]


def test_revisits_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    shapes = [wandering(rng, int(rng.integers(1, 60)), float(step), flat) for step in (0.0251, 0.049, 0.05, 0.051, 0.2, 3.0) for flat in (True, False) for _ in range(25)]
    square = [(0.0, 0.0, 0.0), (9.0, 0.0, 0.0), (9.0, 9.0, 0.0), (0.0, 9.0, 0.0)]
    shapes += [[], square, [*square, square[0]], [*square[:3], square[0], square[3]], [*square, (0.0, -0.0, 0.0), (5.0, 1.0, 0.0)], [(math.nan, 0.0, 0.0)] * 6, [(math.inf, 0.0, 0.0)] * 6, [None] * 6, [(1.0, 1.0, 1.0)] * 3, [(1.0, 1.0, 1.0)] * 5, [(1e300, 0.0, 0.0), (2e300, 0.0, 0.0)] * 4]
    rows = [("m", i, "CLOSED_PLANAR", s, []) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, CONTOURS)
    got = {r.contour_no: (r.exact, r.near) for r in report.keyholes(df).collect()}
    want = {i: slow_revisits(s) for i, s in enumerate(shapes)}
    assert got == want and len(set(want.values())) == 3
    big = [i for i, s in enumerate(shapes) if len(s) >= 6]
    row = report.census(df).first()
    assert (row.contours, row.points, row.xor_contours) == (len(shapes), sum(map(len, shapes)), 0)
    assert (row.exact_revisits, row.near_revisits) == (sum(want[i][0] for i in big), sum(want[i] == (False, True) for i in big))


def test_revisits_are_found_without_a_join(spark):
    plan = report.census(spark.createDataFrame([("m", 0, "CLOSED_PLANAR", [(0.0, 0.0, 0.0)] * 9, [])], CONTOURS))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    # a contour that stays within one cell takes no time in proportion to its pairs
    n = 300_000
    xyz = np.stack([np.arange(n) * 1e-9, np.zeros(n), np.zeros(n)], axis=1)
    assert [x.tolist() for x in report.revisits(np.zeros(n, np.int64), np.arange(n), np.full(n, n), xyz, 0.05)] == [[False], [True]]


def test_long_contours_are_written_and_read():
    """20,000 points have more text than a short value can hold."""
    points = [(i / 7, -i / 3, 2.0) for i in range(20_000)]
    data = dicom.write_structures([dicom.Roi(0, "a", [dicom.Contour("CLOSED_PLANAR", points, ["1.2"])])])
    (got,) = dicom.parse_structures(data).rois[0].contours
    assert np.allclose(got.points, points, atol=1e-6) and got.sop_refs == ["1.2"]
    assert [(n, i) for n, i, _ in dicom.scan_contours(data)] == [(1, 0)]


def test_sequences_of_unknown_length_are_left_and_read():
    item = codec.encode_dataset(codec.named({"ROINumber": 3, "ROIName": "x"}))
    wrapped = b"\x06\x30\x39\x00SQ\0\0\xff\xff\xff\xff" + b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + item + b"\xfe\xff\x0d\xe0\0\0\0\0" + b"\xfe\xff\xdd\xe0\0\0\0\0" + item
    tag = codec.TAGS["ROIContourSequence"][0]
    got = codec.Reader(wrapped, 0, frozenset([tag])).dataset(len(wrapped))
    assert codec.View(got).integer("ROINumber") == 3
    assert [codec.View(x).integer("ROINumber") for x in codec.Reader(wrapped, *got[tag][1][:1]).each(got[tag][1][1])] == [3]


@pytest.mark.parametrize("name", ["structure_plane", "structure_roundtrip", "contour_coordinates", "structure_set_masks"])
def test_no_contour_comes_to_the_driver(spark, name, monkeypatch):
    """These queries collected all contours and wrote the document there."""
    for f in ("write_structures", "parse_structures"):
        monkeypatch.setattr(dicom, f, lambda *a, **k: pytest.fail("on the driver"))
    assert entry.queries()[name](spark, SF).count() == len(oracle(name, SF, ["lineitem", "events"]))


def test_documents_load_as_on_the_driver(spark):
    grid = uniform_grid(8, 9, 3, frame_uid="1.2.3")
    box = lambda z, a, b: [(a, a, z), (b, a, z), (b, b, z), (a, b, z)]
    made = [("set", "a", 4, "CLOSED_PLANAR", box(1.0, 0.5, 6.5), ["1.9.1"]), ("set", "a", 2, "CLOSED_PLANAR", box(1.0, 1.5, 3.5), []), ("set", "b", 1, "CLOSED_PLANAR", box(2.0, 0.0, 4.0), [])]
    rows = spark.createDataFrame(made, "doc string, " + CONTOURS)
    files = dicom.write_structure_sets(rows, shuffle=True)
    data = bytes(files.first().content)
    loaded, other = structures.load_tables(dicom.read_contours(files), dicom.read_rois(files), grid), structures.load(spark, dicom.parse_structures(data), grid)
    key = lambda df: sorted((r.mask_id.split("#")[-1], r.k, r.r, r.c) for r in df.collect())
    assert key(loaded.masks) == key(other.masks) and key(loaded.mask_plane("set#1", 1))
    facts = lambda df: sorted((r.name, r.n_contours, r.contours, r.interpretation) for r in df.collect())
    assert facts(loaded.rois) == facts(other.rois) == [("a", 2, 2, "nested-even-odd"), ("b", 1, 1, "none")]
    assert [c.points[0][0] for _, _, c in dicom.scan_contours(data)] == [1.5, 0.5, 0.0]
    mixed = rows.union(spark.createDataFrame([("set", "b", 9, "CLOSEDPLANAR_XOR", box(2.0, 1.0, 2.0), [])], rows.schema))
    files = dicom.write_structure_sets(mixed)
    with pytest.raises(errors.XorHomogeneityError):
        structures.load_tables(dicom.read_contours(files), dicom.read_rois(files), grid)


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """Events 20 times, with other keys each time: 300 contours."""
    folder = tmp_path_factory.mktemp("grown")
    for table, rows in (("lineitem", f"SELECT * FROM '{SF}/lineitem.parquet'"), ("events", f"SELECT * EXCLUDE (j) REPLACE (event_id + 100000 * j AS event_id, user_id + 15 * j AS user_id) FROM '{SF}/events.parquet', range(20) t(j)")):
        duckdb.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


def same_as_sql(df, name, folder):
    want = oracle(name, folder, ["lineitem", "events"])
    return sorted(map(tuple, df.collect())) == sorted(want) and bool(want)


def test_keyholes_of_many_contours_need_no_broadcast(spark, grown):
    """The points were joined with themselves, and the driver held them to broadcast them."""
    df = entry.queries()["keyhole_census"](spark, grown)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert same_as_sql(df, "keyhole_census", grown)


@pytest.mark.parametrize("name", ["structure_roundtrip", "contour_coordinates", "structure_set_masks"])
def test_documents_of_many_contours_pass_the_driver_by(spark, grown, name, monkeypatch):
    """The driver held all contours, and the document that it made of them."""
    sizes = []

    def seen(f, held):
        def call(*args, **options):
            out = f(*args, **options)
            sizes.append(len(pickle.dumps(held(args, out))))
            return out

        return call

    with monkeypatch.context() as m:
        for way in ("collect", "toArrow", "toPandas"):
            m.setattr(DataFrame, way, seen(getattr(DataFrame, way), lambda args, out: out))
        m.setattr(type(spark), "createDataFrame", seen(type(spark).createDataFrame, lambda args, out: args[1]))
        df = entry.queries()[name](spark, grown)
    assert sum(sizes) < 10_000
    assert same_as_sql(df, name, grown)
