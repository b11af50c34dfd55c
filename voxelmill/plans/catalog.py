"""The registered queries and their oracles.

Every query applies library operators to the driver's tables (see ``sources.tables``); its oracle
is the same result as DuckDB SQL, written on its own. Floating results are rounded alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import columns as fn
from voxelmill.operators import contours, dose, grid, masks, morphology, report, sampling
from voxelmill.sources import tables as t

QUERIES: dict = {}
ORACLES: dict = {}
L = t.GRID
H = "[0.0, 2.0, 4.0, 7.0, 9.0, 12.0, 14.0]"
THICK = "[2.0, 2.0, 2.5, 2.5, 2.5, 2.5, 2.0]"

#: Common parts of the oracles.
PRELUDE = f"""WITH RECURSIVE vox AS (
  SELECT (l_linenumber - 1)::INT AS k, round(l_discount * 100)::INT AS r, (l_quantity - 1)::INT AS c,
    sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE / count(*) AS v, count(*) AS n, sum(round(l_tax * 100)::BIGINT)::BIGINT AS tax
  FROM lineitem GROUP BY ALL),
vv AS (SELECT k, r, c, v, n, tax, 2.0::DOUBLE * ({THICK})[k + 1] AS vol FROM vox),
a AS (SELECT k, r, c, v, vol FROM vv WHERE v >= 53000), b AS (SELECT k, r, c, v, vol FROM vv WHERE tax >= 4 * n), cc AS (SELECT k, r, c, v, vol FROM vv WHERE v >= 60000),
ms AS (SELECT 'A' AS mask_id, * FROM a UNION ALL SELECT 'B', * FROM b UNION ALL SELECT 'C', * FROM cc),
g AS (SELECT (i // 550)::INT AS k, ((i % 550) // 50)::INT AS r, (i % 50)::INT AS c FROM range(3850) q(i)),
verts AS (SELECT user_id, event_id, (event_id * 7919 + user_id * 13) % 197 / 4.0::DOUBLE AS x, (event_id * 104729 + user_id * 7) % 43 / 4.0::DOUBLE AS y,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
cont AS (SELECT 'roi' || user_id % 5 AS mask_id, user_id::INT AS contour_no, (user_id % 7)::INT AS k, x, y, i FROM verts WHERE n >= 3),
edge AS (SELECT mask_id, contour_no, k, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1
    FROM cont WINDOW w AS (PARTITION BY contour_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
tg AS (SELECT (i // 240)::INT AS k, ((i % 240) // 30)::INT AS r, (i % 30)::INT AS c FROM range(1440) q(i)),
tp AS (SELECT k, r, c, 1.25 + 1.5 * c AS x, 0.75 + 2.5 * r AS y, ([0.5, 3.0, 5.5, 8.0, 11.0, 13.5])[k + 1]::DOUBLE AS z FROM tg)
"""


def register(name: str, oracle: str | None, *, prelude: bool = True):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = (PRELUDE if prelude else "") + oracle
        return f

    return add


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


def masked(spark, d):
    """Samples of the field under A, B and C."""
    return dose.samples(t.field(spark, d), t.masks(spark, d), L)


# --- dose-volume -----------------------------------------------------------------------------


@register("structure_report", """
, run AS (SELECT mask_id, v, sum(vol) OVER (PARTITION BY mask_id ORDER BY v DESC) AS upto, sum(vol) OVER (PARTITION BY mask_id) AS total FROM ms)
SELECT m.mask_id, round(max(v), 6) AS max_value, round(min(v), 6) AS min_value, round(sum(v * vol) / sum(vol), 6) AS mean_value, round(sum(vol), 6) AS volume_mm3, count(*) AS voxels,
  round((SELECT max(v) FROM run WHERE run.mask_id = m.mask_id AND upto >= 0.95 * total), 6) AS d95, round((SELECT max(v) FROM run WHERE run.mask_id = m.mask_id AND upto >= 0.5 * total), 6) AS d50,
  round(sum(CASE WHEN v >= 55000 THEN vol ELSE 0 END), 6) AS v55000
FROM ms m GROUP BY m.mask_id""")
def structure_report(spark, d):
    rows = masked(spark, d)
    at = dose.value_at(rows, [0.5, 0.95]).groupBy("mask_id").agg(F.max(F.when(F.col("fraction") == 0.95, F.col("value"))).alias("d95"), F.max(F.when(F.col("fraction") == 0.5, F.col("value"))).alias("d50"))
    above = dose.volume_above(rows, 55000).withColumnRenamed("vol", "v55000")
    out = dose.statistics(rows).join(at, "mask_id").join(above, "mask_id")
    return rounded(out, "max_value", "min_value", "mean_value", "volume_mm3", "d95", "d50", "v55000")


@register("voxel_volume", "SELECT mask_id, round(sum(vol), 6) AS volume_mm3 FROM ms GROUP BY mask_id")
def voxel_volume(spark, d):
    return rounded(masks.volume(t.masks(spark, d), L), "volume_mm3")


@register("mask_count", "SELECT mask_id, count(*) AS voxels FROM ms GROUP BY mask_id")
def mask_count(spark, d):
    return masks.count(t.masks(spark, d))


HISTOGRAM = """
, ends AS (SELECT mask_id, min(v) AS lo, max(v) AS hi FROM ms GROUP BY mask_id),
got AS (SELECT mask_id, least(greatest(floor((v - lo) / (hi - lo) * 16), 0), 15)::INT AS bin, count(*) AS cnt, sum(vol) AS vol FROM ms JOIN ends USING (mask_id) GROUP BY ALL)
SELECT e.mask_id, i::INT AS bin, round(lo + (hi - lo) / 16 * i, 6) AS lo, round(lo + (hi - lo) / 16 * (i + 1), 6) AS hi, coalesce(cnt, 0)::BIGINT AS cnt, round(coalesce(vol, 0), 6) AS vol
FROM ends e CROSS JOIN range(16) q(i) LEFT JOIN got ON got.mask_id = e.mask_id AND got.bin = i"""


@register("histogram", HISTOGRAM)
def histogram(spark, d):
    return rounded(dose.histogram(masked(spark, d), 16), "lo", "hi", "vol")


@register("volume_above_threshold", "SELECT mask_id, round(sum(CASE WHEN v >= 58000 THEN vol ELSE 0 END), 6) AS vol FROM ms GROUP BY mask_id")
def volume_above_threshold(spark, d):
    return rounded(dose.volume_above(masked(spark, d), 58000), "vol")


@register("value_at_volume_fraction", """
, run AS (SELECT mask_id, v, sum(vol) OVER (PARTITION BY mask_id ORDER BY v DESC) AS upto, sum(vol) OVER (PARTITION BY mask_id) AS total FROM ms)
SELECT mask_id, fraction, round(coalesce(max(CASE WHEN upto >= fraction * total THEN v END), min(v)), 6) AS value
FROM run CROSS JOIN (SELECT unnest([0.0, 0.02, 0.5, 0.95, 1.0])::DOUBLE AS fraction) GROUP BY mask_id, fraction""")
def value_at_volume_fraction(spark, d):
    return rounded(dose.value_at(masked(spark, d), [0.0, 0.02, 0.5, 0.95, 1.0]), "value")


@register("mean_value", "SELECT mask_id, round(sum(v * vol) / sum(vol), 6) AS mean FROM ms GROUP BY mask_id")
def mean_value(spark, d):
    return rounded(dose.mean_value(masked(spark, d)), "mean")


@register("threshold_sensitivity", """
SELECT mask_id, threshold, round(sum(CASE WHEN v >= threshold THEN vol ELSE 0 END), 6) AS vol, round(sum(CASE WHEN v >= threshold THEN vol ELSE 0 END) / sum(vol), 6) AS fraction
FROM ms CROSS JOIN (SELECT unnest([50000.0, 55000.0, 60000.0, 65000.0])::DOUBLE AS threshold) GROUP BY ALL""")
def threshold_sensitivity(spark, d):
    return rounded(dose.sensitivity(masked(spark, d), [50000, 55000, 60000, 65000]), "vol", "fraction")


@register("dose_statistics", "SELECT mask_id, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, round(sum(v * vol) / sum(vol), 6) AS mean_value, round(sum(vol), 6) AS volume_mm3, count(*) AS voxels, 'whole' AS mode FROM ms GROUP BY mask_id")
def dose_statistics(spark, d):
    out = dose.statistics(masked(spark, d)).withColumn("mode", dose.method_tag("whole", 1, False)["mode"])
    return rounded(out, "min_value", "max_value", "mean_value", "volume_mm3")


DVH = """
, ends AS (SELECT mask_id, max(v) AS top, sum(vol) AS total FROM ms GROUP BY mask_id),
got AS (SELECT mask_id, least(floor(v / top * 64), 63)::INT AS bin, vol FROM ms JOIN ends USING (mask_id))
SELECT e.mask_id, i::INT AS i, round(top * i / 64, 6) AS dose, round(CASE WHEN i = 64 THEN 0 ELSE coalesce((SELECT sum(vol) FROM got WHERE got.mask_id = e.mask_id AND bin >= i), 0) END, 6) AS vol,
  round(CASE WHEN i = 64 THEN 0 ELSE coalesce((SELECT sum(vol) FROM got WHERE got.mask_id = e.mask_id AND bin >= i), 0) END / total, 6) AS fraction
FROM ends e CROSS JOIN range(65) q(i)"""


@register("cumulative_dvh", DVH)
def cumulative_dvh(spark, d):
    return rounded(dose.cumulative_dvh(masked(spark, d), 64), "dose", "vol", "fraction")


# the value at a point of Grid L, as SQL: p(x, y, z, ...) to fx, fy, fz and the eight corners
TRILINEAR = f"""
, fi AS (SELECT *, x / 1.0 AS fx, y / 2.0 AS fy, greatest(len(list_filter({H}[1:6], lambda q: q < z)) - 1, 0) AS kk FROM pts),
fz AS (SELECT *, kk + (z - ({H})[kk + 1]) / (({H})[kk + 2] - ({H})[kk + 1]) AS fz FROM fi),
ok AS (SELECT *, floor(fx)::INT AS x0, floor(fy)::INT AS y0, floor(fz)::INT AS z0 FROM fz WHERE z >= -1e-9 AND z <= 14 + 1e-9 AND fx BETWEEN -0.5 AND 49.5 AND fy BETWEEN -0.5 AND 10.5),
cor AS (SELECT ok.*, i, least(greatest(x0 + i % 2, 0), 49) AS gc, least(greatest(y0 + (i // 2) % 2, 0), 10) AS gr, least(greatest(z0 + i // 4, 0), 6) AS gk FROM ok CROSS JOIN range(8) q(i)),
val AS (SELECT pid, fx, fy, fz, x0, y0, z0, {", ".join(f"max(CASE WHEN i = {i} THEN v END) AS v{i}" for i in range(8))} FROM cor JOIN vox ON vox.k = gk AND vox.r = gr AND vox.c = gc GROUP BY ALL),
row_ AS (SELECT *, {", ".join(f"v{i} + (v{i + 1} - v{i}) * (fx - x0) AS w{i}" for i in (0, 2, 4, 6))} FROM val),
pl AS (SELECT *, w0 + (w2 - w0) * (fy - y0) AS u0, w4 + (w6 - w4) * (fy - y0) AS u1 FROM row_),
tri AS (SELECT pid, u0 + (u1 - u0) * (fz - z0) AS val FROM pl)
"""
POINTS = "pts AS (SELECT event_id AS pid, (event_id * 31 % 520) / 10.0::DOUBLE - 1 AS x, (event_id * 17 % 230) / 10.0::DOUBLE - 1 AS y, (event_id * 13 % 150) / 10.0::DOUBLE AS z FROM events)"


def points(spark, d):
    e = F.col("event_id")
    return t.read(spark, d, "events").select(e.alias("point_id"), (e * 31 % 520 / 10.0 - 1).alias("x"), (e * 17 % 230 / 10.0 - 1).alias("y"), (e * 13 % 150 / 10.0).alias("z"))


@register("sample_trilinear", f", {POINTS} {TRILINEAR} SELECT p.pid AS point_id, round(coalesce(val, 0.0), 6) AS value FROM pts p LEFT JOIN tri USING (pid)")
def sample_trilinear(spark, d):
    return rounded(sampling.sample(points(spark, d), t.field(spark, d), L).select("point_id", "value"), "value")


@register("sample_nearest", f""", {POINTS} {TRILINEAR}, nn AS (SELECT pid, v FROM ok JOIN vox ON vox.k = floor(fz + 0.5) AND vox.r = floor(fy + 0.5) AND vox.c = floor(fx + 0.5))
SELECT p.pid AS point_id, round(coalesce(nn.v, -1.0), 6) AS value FROM pts p LEFT JOIN nn USING (pid)""")
def sample_nearest(spark, d):
    return rounded(sampling.sample(points(spark, d), t.field(spark, d), L, method="nearest", outside=-1.0).select("point_id", "value"), "value")


@register("continuous_index", f", {POINTS} {TRILINEAR} SELECT pid AS point_id, round(fx, 6) AS fx, round(fy, 6) AS fy, round(CASE WHEN z <= 14 + 1e-9 THEN fz END, 6) AS fz FROM fz")
def continuous_index(spark, d):
    return rounded(sampling.continuous_index(points(spark, d), L).select("point_id", "fx", "fy", "fz"), "fx", "fy", "fz")


RESAMPLED = f", pts AS (SELECT (k * 8 + r) * 30 + c AS pid, x, y, z FROM tp) {TRILINEAR} SELECT k, r, c, round(coalesce(val, 0.0)::FLOAT::DOUBLE, 2) AS v FROM tp LEFT JOIN tri ON pid = (k * 8 + r) * 30 + c"


@register("resample_field", RESAMPLED)
def resample_field(spark, d):
    out = sampling.resample_field(t.field(spark, d), L, t.TARGET, kernel=False)
    return rounded(out.withColumn("v", F.col("v").cast("double")), "v", digits=2)


@register("resample_field_kernel", ORACLES["resample_field"], prelude=False)
def resample_field_kernel(spark, d):
    full = sampling.resample_field(t.field(spark, d), L, t.TARGET, kernel=True)
    return rounded(full.withColumn("v", F.col("v").cast("double")), "v", digits=2)


@register("resample_mask", f", pts AS (SELECT (k * 8 + r) * 30 + c AS pid, x, y, z FROM tp) {TRILINEAR} SELECT m.mask_id, (pid // 240)::INT AS k, ((pid % 240) // 30)::INT AS r, (pid % 30)::INT AS c FROM ok JOIN ms m ON m.k = floor(fz + 0.5) AND m.r = floor(fy + 0.5) AND m.c = floor(fx + 0.5)")
def resample_mask(spark, d):
    return sampling.resample_mask(t.masks(spark, d), L, t.TARGET)


@register("supersampled_stats", f""", fine AS (SELECT m.k, m.r, m.c, vol / 8 AS vol, i, j, l FROM cc m CROSS JOIN range(2) q1(i) CROSS JOIN range(2) q2(j) CROSS JOIN range(2) q3(l)),
pts AS (SELECT ((k * 11 + r) * 50 + c) * 8 + i * 4 + j * 2 + l AS pid, vol, c + ((i + 0.5) / 2 - 0.5) AS x, 2 * (r + ((j + 0.5) / 2 - 0.5)) AS y, ({H})[k + 1] + ({THICK})[k + 1] * ((l + 0.5) / 2 - 0.5) AS z FROM fine) {TRILINEAR}
, s AS (SELECT coalesce(val, 0.0) AS v, vol FROM pts LEFT JOIN tri USING (pid))
SELECT 'C' AS mask_id, round(min(v), 4) AS min_value, round(max(v), 4) AS max_value, round(sum(v * vol) / sum(vol), 4) AS mean_value, round(sum(vol), 4) AS volume_mm3, (count(*) / 8)::BIGINT AS voxels FROM s""")
def supersampled_stats(spark, d):
    out = dose.statistics(sampling.supersample(t.field(spark, d), L, t.mask(spark, d, "C"), L, 2), parts=8, names=["C"])
    return rounded(out, "min_value", "max_value", "mean_value", "volume_mm3", digits=4)


# --- masks -----------------------------------------------------------------------------------

OVERLAP = "(SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k, r, c)) AS n_both"


def ab(spark, d):
    return t.mask(spark, d, "A", "m"), L, t.mask(spark, d, "B", "m"), L


@register("dice", f", o AS (SELECT {OVERLAP}) SELECT n_a, n_b, n_both, round(2.0 * n_both / (n_a + n_b), 6) AS dice FROM o")
def dice(spark, d):
    return rounded(masks.overlap(*ab(spark, d)).select(*(F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "n_both")), "dice"), "dice")


@register("voxel_disagreement", f", o AS (SELECT {OVERLAP}) SELECT (n_a + n_b - 2 * n_both)::BIGINT AS disagreement FROM o")
def voxel_disagreement(spark, d):
    return masks.overlap(*ab(spark, d)).select(F.col("disagreement").cast("long").alias("disagreement"))


CENTROID = f"SELECT mask_id, round(sum(c * w) / sum(w), 6) AS ic, round(sum(r * w) / sum(w), 6) AS ir, round(sum(k * w) / sum(w), 6) AS ik, round(sum(c * w) / sum(w), 6) AS x, round(sum(2.0 * r * w) / sum(w), 6) AS y, round(sum(({H})[k + 1] * w) / sum(w), 6) AS z FROM (SELECT *, ({THICK})[k + 1]::DOUBLE AS w FROM ms) GROUP BY mask_id"


@register("centroid", CENTROID)
def centroid(spark, d):
    return rounded(masks.centroid(t.masks(spark, d), L), "ic", "ir", "ik", "x", "y", "z")


@register("centroid_displacement", f", ce AS (SELECT mask_id, sum(c * w) / sum(w) AS x, sum(2.0 * r * w) / sum(w) AS y, sum(({H})[k + 1] * w) / sum(w) AS z FROM (SELECT *, ({THICK})[k + 1]::DOUBLE AS w FROM ms) GROUP BY mask_id) SELECT round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) AS displacement_mm FROM ce p, ce q WHERE p.mask_id = 'A' AND q.mask_id = 'B'")
def centroid_displacement(spark, d):
    return rounded(masks.displacement(*ab(spark, d)).select("displacement_mm"), "displacement_mm")


@register("bounding_box", "SELECT mask_id, min(k) AS k_min, max(k) AS k_max, min(r) AS r_min, max(r) AS r_max, min(c) AS c_min, max(c) AS c_max FROM ms GROUP BY mask_id")
def bounding_box(spark, d):
    return masks.bounding_box(t.masks(spark, d))


@register("crop", "SELECT mask_id, k - 1 AS k, r - 2 AS r, c - 10 AS c, round(c * 1.0, 6) AS x FROM ms WHERE k BETWEEN 1 AND 5 AND r BETWEEN 2 AND 8 AND c BETWEEN 10 AND 40")
def crop(spark, d):
    out, sub = masks.crop(t.masks(spark, d), L, (1, 5, 2, 8, 10, 40))
    return rounded(out.withColumn("x", sub.patient(F.col("k"), F.col("r"), F.col("c"))[0]), "x")


@register("pad", "SELECT mask_id, k, r + 3 AS r, c + 2 AS c, round(2.0 * r, 6) AS y FROM ms")
def pad(spark, d):
    out, grown = masks.pad(t.masks(spark, d), L, (2, 3, 0))
    return rounded(out.withColumn("y", grown.patient(F.col("k"), F.col("r"), F.col("c"))[1]), "y")


for _name, _f, _sql in (
    ("union", masks.union, "SELECT k, r, c FROM a UNION SELECT k, r, c FROM b"),
    ("intersection", masks.intersection, "SELECT k, r, c FROM a INTERSECT SELECT k, r, c FROM b"),
    ("subtract", masks.subtract, "SELECT k, r, c FROM a EXCEPT SELECT k, r, c FROM b"),
    ("xor", masks.xor, "(SELECT k, r, c FROM a EXCEPT SELECT k, r, c FROM b) UNION ALL (SELECT k, r, c FROM b EXCEPT SELECT k, r, c FROM a)"),
):
    register(f"mask_{_name}", _sql)(lambda spark, d, f=_f: f(*ab(spark, d)).select("k", "r", "c"))


@register("mask_complement", "SELECT mask_id, g.k, g.r, g.c FROM g CROSS JOIN (SELECT DISTINCT mask_id FROM ms) EXCEPT SELECT mask_id, k, r, c FROM ms")
def mask_complement(spark, d):
    return masks.complement(t.masks(spark, d), L)


@register("threshold_to_mask", "SELECT k, r, c FROM vox WHERE v >= 57000")
def threshold_to_mask(spark, d):
    return dose.threshold_mask(t.field(spark, d), 57000).select("k", "r", "c")


@register("support", "SELECT k, r, c FROM vox WHERE v - 55000 > 0")
def support(spark, d):
    return dose.support(t.field(spark, d).withColumn("v", F.col("v") - 55000)).select("k", "r", "c")


for _name, _f, _sql in (
    ("cube", lambda s: masks.cube(s, L, 9.0), "abs(c - 24.5) <= 4.5 AND abs(2 * r - 10) <= 4.5 AND abs(z - 7) <= 4.5"),
    ("sphere", lambda s: masks.sphere(s, L, 6.0), "sqrt((c - 24.5) ** 2 + (2 * r - 10) ** 2 + (z - 7) ** 2) <= 6"),
    ("torus", lambda s: masks.torus(s, L, 7.0, 3.0), "(sqrt((c - 24.5) ** 2 + (2 * r - 10) ** 2) - 7) ** 2 + (z - 7) ** 2 <= 9"),
):
    register(f"phantom_{_name}", f"SELECT k, r, c FROM (SELECT *, ({H})[k + 1] AS z FROM g) WHERE {_sql}")(lambda spark, d, f=_f: f(spark).select("k", "r", "c"))


# --- coordinates and planes ------------------------------------------------------------------


@register("index_to_patient", f"SELECT k, r, c, c * 1.0::DOUBLE AS x, r * 2.0::DOUBLE AS y, ({H})[k + 1]::DOUBLE AS z FROM vox")
def index_to_patient(spark, d):
    x, y, z = L.patient(F.col("k"), F.col("r"), F.col("c"))
    return t.voxels(spark, d).select("k", "r", "c", x.alias("x"), y.alias("y"), z.alias("z"))


@register("patient_to_pixel", f", {POINTS} SELECT pid AS point_id, round(x, 6) AS px, round(y / 2, 6) AS py FROM pts")
def patient_to_pixel(spark, d):
    px, py = L.pixel((F.col("x"), F.col("y"), F.col("z")))
    return rounded(points(spark, d).select("point_id", px.alias("px"), py.alias("py")), "px", "py")


@register("nearest_plane", f", {POINTS} SELECT pid AS point_id, list_position(list_transform({H}, lambda h: abs(h - z)), list_min(list_transform({H}, lambda h: abs(h - z))))::INT - 1 AS k FROM pts")
def nearest_plane(spark, d):
    return points(spark, d).select("point_id", L.nearest(L.projection((F.col("x"), F.col("y"), F.col("z")))).alias("k"))


STACKS = "WITH RECURSIVE stack AS (SELECT l_orderkey AS grid_id, (round(l_quantity * 10)::BIGINT + l_suppkey % 3) / 1000.0::DOUBLE AS proj, min(l_linenumber) AS i FROM lineitem GROUP BY ALL)"


@register("plane_thickness", STACKS + " SELECT grid_id, round(proj, 6) AS proj, round(coalesce((lead(proj) OVER w - lag(proj) OVER w) / 2, lead(proj) OVER w - proj, proj - lag(proj) OVER w), 6) AS thickness FROM stack WINDOW w AS (PARTITION BY grid_id ORDER BY proj)", prelude=False)
def plane_thickness(spark, d):
    return rounded(grid.plane_thickness(t.plane_stacks(spark, d)).select("grid_id", "proj", "thickness"), "proj", "thickness")


@register("plane_sort_dedup", STACKS + """, ranked AS (SELECT grid_id, proj, row_number() OVER (PARTITION BY grid_id ORDER BY proj) AS i FROM stack),
fold AS (SELECT grid_id, i, proj, proj AS kept, true AS keep FROM ranked WHERE i = 1
  UNION ALL SELECT r.grid_id, r.i, r.proj, CASE WHEN r.proj - f.kept > 0.001 THEN r.proj ELSE f.kept END, r.proj - f.kept > 0.001 FROM fold f JOIN ranked r ON r.grid_id = f.grid_id AND r.i = f.i + 1)
SELECT grid_id, (row_number() OVER (PARTITION BY grid_id ORDER BY proj) - 1)::INT AS k, round(proj, 6) AS proj FROM fold WHERE keep""", prelude=False)
def plane_sort_dedup(spark, d):
    return rounded(grid.sorted_planes(t.plane_stacks(spark, d)), "proj")


@register("uniform_spacing", STACKS + """, gaps AS (SELECT grid_id, row_number() OVER w AS i, proj - lag(proj) OVER w AS gap FROM stack WINDOW w AS (PARTITION BY grid_id ORDER BY proj))
SELECT grid_id, coalesce(bool_and(abs(gap - first) <= 0.1), true) AS uniform FROM (SELECT *, min(CASE WHEN i = 2 THEN gap END) OVER (PARTITION BY grid_id) AS first FROM gaps) GROUP BY grid_id""", prelude=False)
def uniform_spacing(spark, d):
    return grid.uniform_flags(t.plane_stacks(spark, d), tolerance=0.1)


@register("slice_order_reversed", "WITH s AS (SELECT l_orderkey AS grid_id, l_linenumber AS i, max(l_quantity)::DOUBLE AS proj FROM lineitem GROUP BY ALL), st AS (SELECT grid_id, proj - lag(proj) OVER (PARTITION BY grid_id ORDER BY i) AS step FROM s) SELECT grid_id, coalesce(bool_and(step < -1e-6), false) AS reversed FROM st GROUP BY grid_id", prelude=False)
def slice_order_reversed(spark, d):
    rows = t.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grid_id"), F.col("l_linenumber").alias("i")).agg(F.max("l_quantity").cast("double").alias("proj"))
    return grid.reversed_flags(rows)


# frames 1.2.0 to 1.2.2 (or none), spacings 4 thousandths apart, planes a quarter apart: of neighbours by key, some are the same
GRIDS = "WITH g AS (SELECT s_suppkey AS id, s_nationkey % 3 AS size, round(s_acctbal)::BIGINT % 5 AS step, s_suppkey % 4 AS frame, s_suppkey % 7 AS shift FROM supplier)"


@register("grid_equality", GRIDS + """ SELECT p.id, (p.frame = 3 OR q.frame = 3 OR p.frame = q.frame) AND p.size = q.size AND abs(p.step - q.step) <= 2 AND abs(p.shift - q.shift) <= 2 AND true AS same
FROM g p JOIN g q ON q.id = p.id + 4 OR q.id = p.id + 1""", prelude=False)
def grid_equality(spark, d):
    s, number = F.col("s_suppkey"), F.round("s_acctbal").cast("long") % 5
    spacing = F.array(1 + number * 0.004, F.lit(1.0))
    planes = F.array(*(F.array(F.lit(0.0), F.lit(0.0), s % 7 * 0.25 + 2 * k) for k in range(3)))
    axis = lambda *v: F.array(*map(F.lit, v))
    shape = F.struct((F.col("s_nationkey") % 3 + 5).alias("rows"), F.lit(6).alias("cols"), axis(1.0, 0.0, 0.0).alias("row_dir"), axis(0.0, 1.0, 0.0).alias("col_dir"), spacing.alias("spacing"), planes.alias("planes"), F.when(s % 4 != 3, F.concat(F.lit("1.2."), (s % 4).cast("string"))).alias("frame_uid"))
    grids = t.read(spark, d, "supplier").select(s.alias("id"), shape.cast(grid.GRID_TYPE).alias("a"))
    other = grids.select(F.explode(F.array(F.col("id") - 1, F.col("id") - 4)).alias("id"), F.col("a").alias("b"))
    return grids.join(other, "id").select("id", grid.same_column(F.col("a"), F.col("b")).alias("same"))


@register("fingerprint", f"""SELECT r_regionkey AS id, '11|50|2.000,1.000|1.000,0.000,0.000|0.000,1.000,0.000|' || array_to_string(list_transform({H}, lambda h: '0.000,' || printf('%.3f', r_regionkey / 8.0) || ',' || printf('%.3f', h)), ';') || '|1.2.3' AS fingerprint FROM region""", prelude=False)
def fingerprint(spark, d):
    # regions are five at any size: their grids live on the driver, as grids do
    grids = {r.r_regionkey: grid.create_grid(L.rows, L.cols, planes=[(0.0, r.r_regionkey / 8, z) for z in t.HEIGHTS], spacing=L.spacing, frame_uid=L.frame_uid) for r in t.read(spark, d, "region").collect()}
    return spark.createDataFrame([(i, g.fingerprint()) for i, g in grids.items()], "id int, fingerprint string")


@register("vector_math", "SELECT p_partkey AS id, round(sqrt(x * x + y * y + 9), 6) AS len, round(2 * x - y + 3.0, 6) AS dot, round(3 * y, 6) AS cx, round(acos(greatest(-1.0, least(1.0, (2 * x - y + 3) / (sqrt(x * x + y * y + 9) * sqrt(6))))), 6) AS angle, floor(x / 3 + 0.5)::BIGINT AS rounded FROM (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 17)::DOUBLE AS y FROM part)", prelude=False)
def vector_math(spark, d):
    a, b = fn.vec(F.col("p_size").cast("double"), (F.col("p_partkey") % 17).cast("double"), 3), fn.vec(2, -1, 1)
    side = fn.cross(a, fn.vec(0, 0, 3))
    out = t.read(spark, d, "part").select(F.col("p_partkey").alias("id"), fn.length(a).alias("len"), fn.dot(a, b).alias("dot"), side[0].alias("cx"), fn.angle_between(a, b).alias("angle"), fn.round_half_up(F.col("p_size") / 3.0).alias("rounded"))
    return rounded(out, "len", "dot", "cx", "angle")


# --- contours --------------------------------------------------------------------------------


def placed(spark, d):
    return contours.associate(contours.checked(t.contours(spark, d)), L)


RASTER = """, cross_ AS (SELECT mask_id, k, y::INT AS r, x0 + (y - y0) / (y1 - y0) * (x1 - x0) AS x FROM edge CROSS JOIN range(11) q(y) WHERE least(y0, y1) <= y AND y < greatest(y0, y1)),
filled AS (SELECT mask_id, k, r, c::INT AS c FROM cross_ CROSS JOIN range(50) q(c) WHERE x > c GROUP BY ALL HAVING count(*) % 2 = 1)"""


@register("rasterize_even_odd", RASTER + " SELECT mask_id, k, r, c FROM filled")
def rasterize_even_odd(spark, d):
    return contours.rasterize(placed(spark, d), L)


@register("nesting_flags", """, firsts AS (SELECT mask_id, contour_no, k, x AS px, y AS py FROM cont WHERE i = 1),
par AS (SELECT f.mask_id, f.k, f.contour_no, e.contour_no AS other, count(*) FILTER (px < x0 + (py - y0) / (y1 - y0) * (x1 - x0)) % 2 = 1 AS inside
  FROM firsts f JOIN edge e ON e.mask_id = f.mask_id AND e.k = f.k AND e.contour_no <> f.contour_no AND least(y0, y1) <= py AND py < greatest(y0, y1) GROUP BY ALL)
SELECT f.mask_id, f.k, f.contour_no, coalesce(bool_or(inside), false) AS inside FROM firsts f LEFT JOIN par USING (mask_id, k, contour_no) GROUP BY ALL""")
def nesting_flags(spark, d):
    return contours.nesting(placed(spark, d), L)


ASSOCIATED = """, one AS (SELECT mask_id, contour_no, k AS k_geo FROM cont WHERE i = 1),
assoc AS (SELECT mask_id, contour_no, k_geo, CASE WHEN contour_no % 3 = 0 THEN (contour_no + 1) % 7 ELSE k_geo END::INT AS k, contour_no % 3 = 0 AS via_sop, contour_no % 3 = 1 AS unresolved FROM one)"""


@register("slice_association", ASSOCIATED + f" SELECT mask_id, contour_no, k, k_geo, via_sop, unresolved, round(abs(({H})[k + 1] - ({H})[k_geo + 1]), 6) AS distance_mm, ({THICK})[k + 1]::DOUBLE / 2 AS tolerance_mm FROM assoc")
def slice_association(spark, d):
    out = contours.associate(t.contours(spark, d), L, t.slices(spark))
    return rounded(out.select("mask_id", "contour_no", "k", "k_geo", "via_sop", "unresolved", "distance_mm", "tolerance_mm"), "distance_mm")


@register("association_summary", ASSOCIATED + " SELECT mask_id, count(*) AS contours, count(*) FILTER (via_sop) AS by_sop, count(*) FILTER (NOT via_sop) AS by_geometry, count(*) FILTER (unresolved) AS unresolved, bool_and(via_sop) AS all_by_sop FROM assoc GROUP BY mask_id")
def association_summary(spark, d):
    return contours.association_summary(contours.associate(t.contours(spark, d), L, t.slices(spark)))


@register("contour_census", """, ct AS (SELECT mask_id, contour_no, count(*) AS n FROM cont GROUP BY ALL),
hit AS (SELECT DISTINCT p.contour_no FROM cont p JOIN cont q ON p.contour_no = q.contour_no AND q.i >= p.i + 3 AND p.x = q.x AND p.y = q.y JOIN ct ON ct.contour_no = p.contour_no WHERE q.i - p.i < n - 1 AND n >= 6)
SELECT mask_id, count(*) AS contours, sum(n)::BIGINT AS points, 0::BIGINT AS xor_contours, count(hit.contour_no) AS exact_revisits, 0::BIGINT AS near_revisits FROM ct LEFT JOIN hit USING (contour_no) GROUP BY mask_id""")
def contour_census(spark, d):
    return report.census(t.contours(spark, d))


SIDES = """, side AS (SELECT m.*, s, ([-1, 0, 1, 0])[s + 1] AS dr, ([0, 1, 0, -1])[s + 1] AS dc FROM ms m CROSS JOIN range(4) q(s)),
sides AS (SELECT mask_id, k, r, c, s::INT AS side FROM side WHERE NOT EXISTS (SELECT 1 FROM ms o WHERE o.mask_id = side.mask_id AND o.k = side.k AND o.r = side.r + dr AND o.c = side.c + dc))"""


@register("vectorize_boundary_edges", SIDES + " SELECT mask_id, k, r, c, side, c + ([-0.5, 0.5, 0.5, -0.5])[side + 1]::DOUBLE AS x0, r + ([-0.5, -0.5, 0.5, 0.5])[side + 1]::DOUBLE AS y0, c + ([0.5, 0.5, -0.5, -0.5])[side + 1]::DOUBLE AS x1, r + ([-0.5, 0.5, 0.5, -0.5])[side + 1]::DOUBLE AS y1 FROM sides")
def vectorize_boundary_edges(spark, d):
    return contours.boundary_edges(t.masks(spark, d)).withColumns({n: F.col(n).cast("double") for n in ("x0", "y0", "x1", "y1")})


@register("vectorize_loops", SIDES + f" SELECT mask_id, k, c + ([-0.5, 0.5, 0.5, -0.5])[side + 1]::DOUBLE AS x, 2 * (r + ([-0.5, -0.5, 0.5, 0.5])[side + 1])::DOUBLE AS y, ({H})[k + 1]::DOUBLE AS z FROM sides")
def vectorize_loops(spark, d):
    # every boundary side is in one loop, so the vertices of all loops are the starts of the sides
    return contours.vectorize(t.masks(spark, d), L).select("mask_id", "k", F.explode("points").alias("p")).select("mask_id", "k", "p.x", "p.y", "p.z")


@register("vectorize_roundtrip", "SELECT mask_id, k, r, c FROM ms")
def vectorize_roundtrip(spark, d):
    return contours.rasterize(contours.vectorize(t.masks(spark, d), L), L)


# --- morphology ------------------------------------------------------------------------------

MEAN = 14.0 / 6
SQUARED = f"(1.0 * (g.c - m.c) ** 2 + 4.0 * (g.r - m.r) ** 2 + {MEAN!r} ** 2 * (g.k - m.k) ** 2)"


@register("distance_transform", f"SELECT g.k, g.r, g.c, round(sqrt(min({SQUARED}))::FLOAT::DOUBLE, 4) AS v FROM g CROSS JOIN cc m GROUP BY ALL")
def distance_transform(spark, d):
    out = morphology.distance_transform(t.mask(spark, d, "C"), L)
    return rounded(out.select("k", "r", "c", F.col("v").cast("double").alias("v")), "v", digits=4)


@register("signed_distance", f""", outs AS (SELECT k, r, c FROM g EXCEPT SELECT k, r, c FROM cc), p AS (SELECT g.k, g.r, g.c, min({SQUARED}) AS d2 FROM g CROSS JOIN cc m GROUP BY ALL), q AS (SELECT g.k, g.r, g.c, min({SQUARED}) AS b2 FROM cc g CROSS JOIN outs m GROUP BY ALL)
SELECT k, r, c, round((CASE WHEN d2 = 0 THEN -sqrt(b2) ELSE sqrt(d2) END)::FLOAT::DOUBLE, 4) AS v FROM p LEFT JOIN q USING (k, r, c)""")
def signed_distance(spark, d):
    out = morphology.distance_transform(t.mask(spark, d, "C"), L, signed=True)
    return rounded(out.select("k", "r", "c", F.col("v").cast("double").alias("v")), "v", digits=4)


@register("dilate", f"SELECT DISTINCT g.k, g.r, g.c FROM g JOIN cc m ON {SQUARED} <= 9")
def dilate(spark, d):
    return morphology.dilate(t.mask(spark, d, "C"), L, 3.0).select("k", "r", "c")


@register("erode", f", outs AS (SELECT k, r, c FROM g EXCEPT SELECT k, r, c FROM a) SELECT k, r, c FROM a EXCEPT SELECT DISTINCT g.k, g.r, g.c FROM g JOIN outs m ON {SQUARED} <= 1")
def erode(spark, d):
    return morphology.erode(t.mask(spark, d, "A"), L, 1.0).select("k", "r", "c")


def _components_sql(reach: str) -> str:
    return f""", node AS (SELECT k, r, c, (k * 11 + r) * 50 + c AS id FROM cc), ed AS (SELECT p.id AS u, q.id AS v FROM node p JOIN node q ON abs(p.k - q.k) <= 1 AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 AND {reach}),
walk AS (SELECT id AS root, id FROM node UNION SELECT w.root, e.v FROM walk w JOIN ed e ON e.u = w.id), comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
size AS (SELECT root, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, root)::INT AS label FROM comp GROUP BY root)"""


@register("connected_components", _components_sql("abs(p.k - q.k) + abs(p.r - q.r) + abs(p.c - q.c) = 1") + " SELECT k, r, c, label, size FROM node JOIN comp USING (id) JOIN size USING (root)")
def connected_components(spark, d):
    return morphology.components(t.mask(spark, d, "C"), L, 6).drop("mask_id")


@register("largest_component", _components_sql("true") + " SELECT k, r, c FROM node JOIN comp USING (id) JOIN size USING (root) WHERE label = 1")
def largest_component(spark, d):
    return morphology.largest_component(t.mask(spark, d, "C"), L, 26).select("k", "r", "c")


@register("neighbour_pairs", ", node AS (SELECT k, r, c, (k * 11 + r) * 50 + c AS id FROM cc) SELECT p.id::BIGINT AS u, q.id::BIGINT AS v FROM node p JOIN node q ON p.id < q.id AND abs(p.k - q.k) <= 1 AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1")
def neighbour_pairs(spark, d):
    out = morphology.neighbour_pairs(t.mask(spark, d, "C"), L)
    return out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
