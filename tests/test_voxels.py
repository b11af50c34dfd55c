"""Grids, masks, doses, sampling, contours and morphology: stated numbers and identities."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelmill import errors
from voxelmill.functions import columns as fn
from voxelmill.operators import contours, dose, grid, masks, morphology, sampling
from voxelmill.operators.grid import Tolerance, create_grid, uniform_grid

UNIT2 = uniform_grid(2, 2, 2)
MASK = "mask_id string, k int, r int, c int"


def mask(spark, voxels, name="m"):
    """voxels as (c, r, k)."""
    return spark.createDataFrame([(name, k, r, c) for c, r, k in voxels], MASK)


def voxels(df):
    return {(x.c, x.r, x.k) for x in df.collect()}


def full(spark, g, name="m"):
    return g.voxel_table(spark).select(F.lit(name).alias("mask_id"), "k", "r", "c")


def linear(spark, g):
    return g.voxel_table(spark).select("k", "r", "c", (F.col("c") + 10 * F.col("r") + 100 * F.col("k")).cast("float").alias("v"))


@pytest.fixture(scope="module")
def ramp(spark):
    rows = UNIT2.voxel_table(spark).select("k", "r", "c", (F.col("k") * 4 + F.col("r") * 2 + F.col("c") + 1).cast("float").alias("v"))
    return dose.samples(rows, full(spark, UNIT2), UNIT2)


# --- grids -----------------------------------------------------------------------------------


def test_grid_construction_refuses_bad_input():
    for bad in ({"rows": 0}, {"spacing": (0, 1)}, {"planes": []}, {"planes": [(0, 0, math.nan)]}):
        with pytest.raises(ValueError):
            create_grid(**({"rows": 2, "cols": 2, "planes": [(0, 0, 0)]} | bad))
    with pytest.raises(errors.NonOrthogonalBasisError):
        create_grid(2, 2, planes=[(0, 0, 0)], row_dir=(1, 0, 0), col_dir=(1, 1, 0))
    with pytest.raises(errors.NonParallelPlanesError):
        create_grid(2, 2, planes=[(0, 0, 0), (1, 0, 1)])
    with pytest.raises(errors.ResourceLimitError):
        uniform_grid(4096, 4096, 100).require_budget()


def test_planes_are_sorted_and_repeated_ones_reported():
    planes, notes = grid.sort_planes([(0, 0, 4), (0, 0, 0), (0, 0, 0.0005), (0, 0, 2)], (0, 0, 1))
    assert [p[2] for p in planes] == [0, 2, 4] and [n.code for n in notes] == ["DUPLICATE_PLANE_POSITION"]


def test_thickness_centre_and_transforms():
    g = create_grid(4, 6, planes=[(0, 0, z) for z in (0, 1, 6)], spacing=(2, 0.5))
    assert [g.thickness(k) for k in range(3)] == [1, 3, 5] and not g.uniform() and g.mean_spacing == 3
    assert g.to_patient(3, 2, 1) == (1.5, 4, 1) and g.nearest_plane((0, 0, 3.5)) == (1, 2.5)
    with pytest.raises(errors.IndeterminateVolumeError):
        uniform_grid(2, 2, 1).thickness(0)


def test_grid_equality_is_within_tolerance_but_not_transitive():
    a, b, c = (uniform_grid(3, 3, 3, origin=(x, 0, 0)) for x in (0, 0.4, 0.8))
    assert a.same(b) and b.same(a) and b.same(c) and not a.same(c)
    assert a.same(c, Tolerance(position_mm=1)) and not a.same(uniform_grid(3, 3, 3, spacing=(1, 1.02)))
    assert not uniform_grid(2, 2, 2, frame_uid="1.2.3").same(uniform_grid(2, 2, 2, frame_uid="1.2.4"))
    with pytest.raises(errors.GridMismatchError):
        a.require_same(c)


# --- doses -----------------------------------------------------------------------------------


def test_ramp_numbers(ramp):
    assert [(r.cnt, r.vol) for r in dose.histogram(ramp, 4).orderBy("bin").collect()] == [(2, 2.0)] * 4
    assert [dose.volume_above(ramp, t).first().vol for t in (5, 8, 9)] == [4, 1, 0]
    assert {r.fraction: r.value for r in dose.value_at(ramp, [0.0, 0.5, 1.0]).collect()} == {0.0: 8, 0.5: 5, 1.0: 1}
    assert dose.mean_value(ramp).first().mean == 4.5
    assert [(r.threshold, r.vol, r.fraction) for r in dose.sensitivity(ramp, [1, 5, 8]).orderBy("threshold").collect()] == [(1, 8, 1), (5, 4, 0.5), (8, 1, 0.125)]
    with pytest.raises(ValueError):
        dose.value_at(ramp, [1.5])


def test_dose_of_ten_times_the_plane(spark):
    g = uniform_grid(4, 4, 10)
    field = g.voxel_table(spark).select("k", "r", "c", (F.col("k") * 10.0).alias("v"))
    rows = dose.samples(field, full(spark, g), g)
    got = {r.fraction: r.value for r in dose.value_at(rows, [0.1, 0.5]).collect()}
    assert got == {0.1: 90, 0.5: 50}
    s = dose.statistics(rows).first()
    assert (s.max_value, s.mean_value, s.voxels) == (90, 45, 160) and dose.volume_above(rows, 50).first().vol / s.volume_mm3 == 0.5
    last = dose.cumulative_dvh(rows, 9).orderBy("i").collect()
    assert last[-1].vol == 0 and last[0].fraction == 1 and last[-1].dose == 90


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(1, 5)), min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.5, 0.95, 1.0]))
def test_quantile_equals_the_ordered_walk(spark, pairs, fraction):
    rows = spark.createDataFrame([("m", float(v), float(w)) for v, w in pairs], "mask_id string, v double, vol double")
    total, run, expected = sum(w for _, w in pairs), 0, None
    for v, w in sorted(pairs, reverse=True):
        run += w
        if run >= fraction * total:
            expected = v
            break
    assert dose.value_at(rows, [fraction]).first().value == expected


def test_an_outlier_does_not_widen_the_ranges(spark):
    """With one value a million times the others, a quantile still orders few of them."""
    rows = spark.range(20_000).select(F.lit("m").alias("mask_id"), F.when(F.col("id") == 0, 1e9).otherwise(40 + F.col("id") / 1000.0).alias("v"), F.lit(1.0).alias("vol"))
    values = sorted([1e9, *(40 + i / 1000 for i in range(1, 20_000))], reverse=True)
    assert {r.fraction: r.value for r in dose.value_at(rows, [0.02, 0.5, 0.95]).collect()} == {f: values[int(f * 20_000) - 1] for f in (0.02, 0.5, 0.95)}
    most = rows.groupBy(dose.value_range(F.col("v"))).count().agg(F.max("count")).first()[0]
    assert most < 200


def test_constant_values_fall_in_the_first_bin(spark):
    rows = spark.createDataFrame([("m", 3.0, 1.0)] * 4, "mask_id string, v double, vol double")
    assert [r.cnt for r in dose.histogram(rows, 3).orderBy("bin").collect()] == [4, 0, 0]


# --- sampling --------------------------------------------------------------------------------


def points(spark, *xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id int, x double, y double, z double")


def values(df):
    return [r.value for r in df.orderBy("point_id").collect()]


def test_sampling_is_exact_on_linear_fields(spark):
    g = uniform_grid(5, 5, 4)
    f = linear(spark, g)
    at = points(spark, (2.4, 3.6, 1.5), (0, 0, 0), (4.4, 1, 1), (9, 0, 0), (1, 1, 3.1))
    assert values(sampling.sample(at, f, g)) == pytest.approx([188.4, 0, 114, 0, 0])
    assert values(sampling.sample(at, f, g, method="nearest", outside=-1)) == [242, 0, 114, -1, -1]


def test_irregular_planes_and_single_planes(spark):
    g = create_grid(2, 2, planes=[(0, 0, z) for z in (0, 1, 5)])
    f = g.voxel_table(spark).select("k", "r", "c", F.array(*map(F.lit, (10.0, 20.0, 60.0)))[F.col("k")].alias("v"))
    assert values(sampling.sample(points(spark, (0, 0, 3)), f, g)) == [40]
    one = uniform_grid(2, 2, 1)
    assert values(sampling.sample(points(spark, (1, 1, 77)), linear(spark, one), one)) == [11]


@pytest.mark.parametrize("method", ["trilinear", "nearest"])
def test_both_ways_of_resampling_agree(spark, method):
    g, target = uniform_grid(6, 7, 5, spacing=(1.5, 1), step=2), uniform_grid(5, 5, 6, spacing=(1.3, 1.7), step=1.9, origin=(0.3, -0.4, 0.2))
    f = g.voxel_table(spark).select("k", "r", "c", F.sin(F.col("k") * 31 + F.col("r") * 7 + F.col("c")).cast("float").alias("v"))
    got = [sorted((r.k, r.r, r.c, r.v) for r in sampling.resample_field(f, g, target, method=method, kernel=k).collect()) for k in (True, False)]
    assert len(got[0]) == target.voxels and np.allclose(got[0], got[1], atol=1e-6)


def test_mask_to_a_coarser_grid(spark):
    g, target = uniform_grid(8, 8, 8), uniform_grid(3, 3, 3, spacing=(2, 2), step=2, origin=(1, 1, 1))
    assert sampling.resample_mask(full(spark, g), g, target).count() == 27
    with pytest.raises(errors.FrameOfReferenceMismatchError):
        sampling.resample_mask(full(spark, g), uniform_grid(8, 8, 8, frame_uid="1"), uniform_grid(2, 2, 2, frame_uid="2"))


def test_supersampling_of_one_voxel(spark):
    g = uniform_grid(9, 9, 9)
    f = g.voxel_table(spark).select("k", "r", "c", (F.col("c") * 40.0).alias("v"))
    rows = sampling.supersample(f, g, mask(spark, [(4, 4, 4)]), g, 2)
    s = dose.statistics(rows, parts=8).first()
    assert (s.min_value, s.max_value, s.mean_value, s.voxels) == (150, 170, 160, 1)
    assert dose.value_at(rows, [0.95]).first().value == 150 and dose.volume_above(rows, 160).first().vol == 0.5


# --- masks -----------------------------------------------------------------------------------


def test_set_algebra(spark):
    a, b = mask(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0)]), mask(spark, [(1, 1, 0), (2, 1, 0), (2, 2, 0)])
    g = uniform_grid(4, 4, 3)
    assert masks.union(a, g, b, g).count() == 5 and voxels(masks.intersection(a, g, b, g)) == {(1, 1, 0)}
    assert voxels(masks.subtract(a, g, b, g)) == {(0, 0, 0), (1, 0, 0)} and masks.xor(a, g, b, g).count() == 4
    assert voxels(masks.complement(masks.complement(a, g), g)) == voxels(a)
    o = masks.overlap(a, g, b, g).first()
    assert (o.n_a, o.n_b, o.n_both, o.disagreement) == (3, 3, 1, 4) and o.dice == pytest.approx(1 / 3)


def test_masks_of_different_grids_do_not_meet(spark):
    a, g, other = mask(spark, [(0, 0, 0)]), uniform_grid(4, 4, 3), uniform_grid(4, 4, 3, origin=(2, 0, 0))
    for f in (masks.union, masks.intersection, masks.subtract, masks.xor, masks.overlap):
        with pytest.raises(errors.GridMismatchError):
            f(a, g, a, other)
    assert masks.union(a, g, a, other, Tolerance(position_mm=3)).count() == 1


def test_masks_without_voxels(spark):
    g, none = uniform_grid(3, 3, 2), masks.empty(spark)
    assert masks.complement(none, g, ["x"]).count() == g.voxels
    assert {x.v for x in morphology.distance_transform(none, g, names=["x"]).collect()} == {np.float32(morphology.NOWHERE)}
    o = masks.overlap(none, g, none, g, names=["x"]).first()
    assert (o.n_a, o.n_b, o.dice, o.disagreement) == (0, 0, 1, 0)
    assert masks.bounding_box(none, ["x"]).first().k_min is None
    assert masks.value(mask(spark, [(1, 2, 0)]), g, 0, 2, 1).first().value == 1
    with pytest.raises(ValueError):
        masks.crop(none, g)
    with pytest.raises(IndexError):
        masks.plane(none, g, 2)
    with pytest.raises(Exception, match="INDETERMINATE"):
        masks.centroid(none, g, ["x"]).collect()


def test_measures(spark):
    g = create_grid(4, 4, planes=[(0, 0, z) for z in (0, 1, 6)])
    c = masks.centroid(mask(spark, [(1, 1, 0), (1, 1, 1)]), g).first()
    assert c.z == 0.75 and (c.x, c.y) == (1, 1)
    cube = masks.cube(spark, uniform_grid(20, 20, 20), 10)
    assert masks.volume(cube, uniform_grid(20, 20, 20)).first().volume_mm3 == 1000 == masks.analytic_volume("cube", 10)
    with pytest.raises(errors.IndeterminateVolumeError):
        masks.volume(mask(spark, []), uniform_grid(2, 2, 1))
    with pytest.raises(NotImplementedError):
        masks.volume(cube, g, method="contour")


def test_crop_and_pad_keep_places(spark):
    g = uniform_grid(10, 10, 6, spacing=(2, 3), step=4, origin=(1, 2, 3))
    m = mask(spark, [(4, 5, 2), (6, 7, 3)])
    place = lambda df, gr: {gr.to_patient(*v) for v in voxels(df)}
    for out, sub in (masks.crop(m, g, (2, 3, 5, 7, 4, 6)), masks.pad(m, g, (1, 2, 3))):
        assert place(out, sub) == place(m, g)
    assert masks.crop(m, g, (2, 3, 5, 7, 4, 6))[1].voxels == 18
    with pytest.raises(ValueError):
        masks.crop(m, g, (0, 6, 0, 1, 0, 1))
    with pytest.raises(ValueError):
        masks.pad(m, uniform_grid(10, 10, 1), 1)


def test_sphere_and_torus_volumes(spark):
    g = uniform_grid(41, 41, 41)
    assert masks.sphere(spark, g, 15).count() == pytest.approx(masks.analytic_volume("sphere", 15), rel=0.02)
    x, y, z = np.meshgrid(*[np.arange(-20, 21)] * 3, indexing="ij")
    assert masks.torus(spark, g, 12, 5).count() == ((np.sqrt(x * x + y * y) - 12) ** 2 + z * z <= 25).sum()
    assert masks.torus(spark, g, 12, 5).count() == pytest.approx(masks.analytic_volume("torus", 12, 5), rel=0.05)


# --- morphology ------------------------------------------------------------------------------


def slow_distances(points_, g):
    k, r, c = np.meshgrid(*(np.arange(n) for n in (len(g.planes), g.rows, g.cols)), indexing="ij")
    step = g.mean_spacing or 0
    return np.min([np.sqrt(((c - x) * g.spacing[1]) ** 2 + ((r - y) * g.spacing[0]) ** 2 + ((k - z) * step) ** 2) for x, y, z in points_], axis=0)


@pytest.mark.parametrize("g", [uniform_grid(7, 9, 5, spacing=(1.5, 0.7), step=3), uniform_grid(6, 6, 1)])
def test_distances_dilation_and_erosion_equal_brute_force(spark, g):
    rng = np.random.default_rng(1)
    some = {(int(rng.integers(g.cols)), int(rng.integers(g.rows)), int(rng.integers(len(g.planes)))) for _ in range(12)}
    every = {(c, r, k) for k in range(len(g.planes)) for r in range(g.rows) for c in range(g.cols)}
    m, far = mask(spark, sorted(some)), slow_distances(some, g)
    got = {(x.c, x.r, x.k): x.v for x in morphology.distance_transform(m, g).collect()}
    assert set(got) == every and all(got[v] == pytest.approx(far[v[2], v[1], v[0]], abs=1e-5) for v in every)
    out = slow_distances(every - some, g)
    signed = {(x.c, x.r, x.k): x.v for x in morphology.distance_transform(m, g, signed=True).collect()}
    assert all(signed[v] == pytest.approx(-out[v[2], v[1], v[0]] if v in some else far[v[2], v[1], v[0]], abs=1e-5) for v in every)
    for mm in (0, 1.5, 3.1):
        assert voxels(morphology.dilate(m, g, mm)) == {v for v in every if far[v[2], v[1], v[0]] <= mm}
    big = masks.complement(m, g)
    assert voxels(morphology.erode(big, g, 1.5)) == {v for v in every - some if far[v[2], v[1], v[0]] > 1.5}
    with pytest.raises(ValueError):
        morphology.dilate(m, g, -1)


def test_a_large_ball_takes_the_distance(spark):
    g = uniform_grid(25, 25, 25)
    m = mask(spark, [(12, 12, 12)])
    assert len(morphology._ball(g, 6)) > morphology.BALL
    assert morphology.dilate(m, g, 6).count() == len(morphology._ball(g, 6))


def test_components(spark):
    g = uniform_grid(6, 6, 3)
    m = mask(spark, [(0, 0, 0), (4, 4, 0), (3, 4, 0), (4, 3, 0)])
    assert {(r.label, r.size) for r in morphology.components(m, g).collect()} == {(1, 3), (2, 1)}
    assert voxels(morphology.largest_component(m, g)) == {(4, 4, 0), (3, 4, 0), (4, 3, 0)}
    pair = mask(spark, [(0, 0, 0), (1, 1, 1)])
    assert [morphology.components(pair, g, n).agg(F.max("label")).first()[0] for n in (26, 6)] == [1, 2]
    assert {v for v, in morphology.components(mask(spark, [(5, 5, 0), (0, 0, 0)]), g).filter("label = 1").select("c").collect()} == {0}
    rows = np.random.default_rng(0).random((3, 6, 6)) < 0.4
    random = mask(spark, [(int(c), int(r), int(k)) for k, r, c in np.argwhere(rows)])
    u = morphology.neighbour_pairs(random, g, 6).count()
    assert u == sum(int((rows & np.roll(rows, -1, a)).take(range(rows.shape[a] - 1), axis=a).sum()) for a in range(3))


# --- contours --------------------------------------------------------------------------------


def outline(spark, *shapes, z=0.0, kind="CLOSED_PLANAR", refs=None):
    rows = [("m", i, kind, [(float(x), float(y), float(z)) for x, y in s], refs) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, "mask_id string, contour_no int, geometric_type string, points array<struct<x:double,y:double,z:double>>, sop_refs array<string>")


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]


def inside(shapes, x, y):
    odd = False
    for s in shapes:
        for (x0, y0), (x1, y1) in zip(s, s[1:] + s[:1], strict=True):
            if min(y0, y1) <= y < max(y0, y1) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0):
                odd = not odd
    return odd


@pytest.mark.parametrize("seed", range(3))
def test_rasterization_equals_the_even_odd_rule(spark, seed):
    g, rng = uniform_grid(20, 24, 1), np.random.default_rng(seed)
    shapes = [[(float(x), float(y)) for x, y in rng.integers(-20, 120, (int(rng.integers(3, 9)), 2)) / 4] for _ in range(4)]
    got = voxels(contours.rasterize(contours.associate(contours.checked(outline(spark, *shapes)), g), g))
    assert got == {(c, r, 0) for r in range(20) for c in range(24) if inside(shapes, c, r)}


def test_three_encodings_of_a_ring_are_one_mask(spark):
    g = uniform_grid(16, 16, 3)
    outer, inner = square(4, 4, 3.3), square(4, 4, 1.2)
    bridge = outer[:1] + [inner[0], inner[3], inner[2], inner[1], inner[0]] + outer[:1] + outer[1:]
    place = lambda c: contours.associate(c, g)
    rings = [voxels(contours.rasterize(place(c), g)) for c in (outline(spark, outer, inner), outline(spark, outer, inner, kind="CLOSEDPLANAR_XOR"), outline(spark, bridge))]
    assert rings[0] == rings[1] == rings[2] and (4, 4, 0) not in rings[0] and (4, 2, 0) in rings[0]
    kinds = [contours.hole_interpretation(place(c), g).first().interpretation for c in (outline(spark, outer, inner), outline(spark, outer, inner, kind="CLOSEDPLANAR_XOR"), outline(spark, outer))]
    assert kinds == ["nested-even-odd", "xor", "none"]


def test_malformed_contours_fail(spark):
    for bad in (outline(spark, [(0, 0), (1, 1)]), outline(spark, [(0, 0), (1, math.nan), (2, 2)])):
        with pytest.raises(Exception, match="too few points or a coordinate"):
            contours.checked(bad).collect()
    mixed = outline(spark, square(1, 1, 1)).union(outline(spark, square(1, 1, 1), kind="CLOSEDPLANAR_XOR"))
    assert contours.homogeneous(mixed).first().mixed
    assert contours.rasterize(contours.associate(outline(spark, [(0, 0)], kind="POINT"), UNIT2), UNIT2).count() == 0


def test_references_win_over_geometry(spark):
    g = uniform_grid(8, 8, 4, step=2)
    slices = spark.createDataFrame([("u1", 0), ("u2", 3)], "sop_uid string, k int")
    rows = outline(spark, square(3, 3, 1), z=0, refs=["none", "u2", "u1"]).union(outline(spark, square(3, 3, 1), z=4, refs=["x"]).withColumn("contour_no", F.lit(7))).union(outline(spark, square(3, 3, 1), z=2).withColumn("contour_no", F.lit(8)))
    got = {r.contour_no: (r.k, r.k_geo, r.via_sop, r.unresolved) for r in contours.associate(rows, g, slices).collect()}
    assert got == {0: (3, 0, True, False), 7: (2, 2, False, True), 8: (1, 1, False, False)}
    s = contours.association_summary(contours.associate(rows, g, slices)).first()
    assert (s.contours, s.by_sop, s.by_geometry, s.unresolved, s.all_by_sop) == (3, 1, 2, 1, False)


def test_tracing(spark):
    g = uniform_grid(6, 6, 2)
    one = contours.vectorize(mask(spark, [(2, 3, 0)]), g).first().points
    assert [(p.x, p.y) for p in one] == [(1.5, 2.5), (2.5, 2.5), (2.5, 3.5), (1.5, 3.5)]
    assert [len(r.points) for r in contours.vectorize(mask(spark, [(1, 1, 0), (2, 2, 0)]), g).collect()] == [4, 4]
    ring = mask(spark, [(c, r, 1) for c in range(5) for r in range(5) if (c, r) != (2, 2)])
    loops = contours.vectorize(ring, g).orderBy("contour_no").collect()
    area = lambda p: sum(a.x * b.y - b.x * a.y for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2
    assert [area(r.points) for r in loops] == [25, -1]


@pytest.mark.parametrize("seed", range(2))
def test_filling_the_outlines_gives_the_mask_back(spark, seed):
    g = uniform_grid(9, 11, 3, spacing=(1.5, 0.8), step=2)
    some = np.random.default_rng(seed).random((3, 9, 11)) < 0.5
    m = mask(spark, [(int(c), int(r), int(k)) for k, r, c in np.argwhere(some)])
    assert voxels(contours.rasterize(contours.vectorize(m, g), g)) == voxels(m)


# --- column functions ------------------------------------------------------------------------


def test_column_functions(spark):
    row = spark.range(1).select(
        fn.round_half_up(F.lit(-2.5)).alias("a"), fn.redact(F.lit("see 1.2.840.5, not 1.5")).alias("b"), fn.numbers(F.lit(r"1\ 2.5 \x")).alias("c"), fn.quantised(F.lit(1.7), 200).alias("d"), fn.quantised(F.lit(0.1225), 200).alias("e"), fn.angle_between(fn.vec(1, 0, 0), fn.vec(-1, 0, 0)).alias("f"),
        fn.points(F.array(*(F.lit(float(i)) for i in range(6)))).alias("g"), fn.points(F.array().cast("array<double>")).alias("h"), fn.redact_details(F.create_map(F.lit("u"), F.lit("1.2.3"))).alias("i"), *(c.alias(f"n{i}") for i, c in enumerate(fn.normalize(fn.vec(0, 3, 4)))),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (-2, "see [redacted-uid], not 1.5", [1, 2.5, None], 200, 25) and row.f == pytest.approx(math.pi)
    assert [(p.x, p.y, p.z) for p in row.g] == [(0, 1, 2), (3, 4, 5)] and row.h == [] and row.i == {"u": "[redacted-uid]"} and (row.n1, row.n2) == (0.6, 0.8)
    for bad in (fn.points(F.array(F.lit(1.0))), F.array(*fn.normalize(fn.vec(0, 0, 0)))):
        with pytest.raises(Exception, match="triples|normalize"):
            spark.range(1).select(bad).collect()
