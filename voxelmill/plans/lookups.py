"""Queries on look-ups, guards, empty masks, metadata and files, registered beside the others.

No SQL reads or writes the files, so those oracles state what must come back of what was written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill import errors
from voxelmill.functions import columns as fn
from voxelmill.operators import contours, convert, dose, masks, morphology, report, sampling, segments, structures
from voxelmill.operators.dose_grid import DoseQuery
from voxelmill.operators.grid import Tolerance, create_grid, uniform_grid
from voxelmill.plans.catalog import H, L, POINTS, RASTER, SIDES, THICK, TRILINEAR, ab, masked, placed, points, register, rounded
from voxelmill.sources import dicom
from voxelmill.sources import tables as t
from voxelmill.streaming import ingest

NAMES = ["A", "none"]

# --- empty masks and look-ups ----------------------------------------------------------------


@register("complement_of_empty", "SELECT 'A' AS mask_id, k, r, c FROM (SELECT k, r, c FROM g EXCEPT SELECT k, r, c FROM a) UNION ALL SELECT 'none', k, r, c FROM g")
def complement_of_empty(spark, d):
    return masks.complement(t.mask(spark, d, "A"), L, NAMES)


@register("overlap_of_empty", """SELECT 'm' AS mask_id, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k, r, c)) AS n_both,
round(2.0 * (SELECT count(*) FROM a JOIN b USING (k, r, c)) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)), 6) AS dice UNION ALL SELECT 'none', 0, 0, 0, 1.0""")
def overlap_of_empty(spark, d):
    out = masks.overlap(*ab(spark, d), names=["m", "none"])
    return rounded(out.select("mask_id", *(F.col(n).cast("long").alias(n) for n in ("n_a", "n_b", "n_both")), "dice"), "dice")


@register("distance_of_empty", "SELECT 'none' AS mask_id, count(*) AS voxels, 1e10::DOUBLE AS least, 1e10::DOUBLE AS greatest FROM g")
def distance_of_empty(spark, d):
    out = morphology.distance_transform(masks.empty(spark), L, names=["none"])
    return out.groupBy("mask_id").agg(F.count("*").alias("voxels"), F.min("v").cast("double").alias("least"), F.max("v").cast("double").alias("greatest"))


@register("box_of_empty", "SELECT 'A' AS mask_id, min(k) AS k_min, max(k) AS k_max, min(r) AS r_min, max(r) AS r_max, min(c) AS c_min, max(c) AS c_max FROM a UNION ALL SELECT 'none', -1, -1, -1, -1, -1, -1")
def box_of_empty(spark, d):
    # nulls are shown as -1
    return masks.bounding_box(t.mask(spark, d, "A"), NAMES).na.fill(-1)


@register("crop_to_box", ", box AS (SELECT min(k) AS k0, min(r) AS r0, min(c) AS c0 FROM ms) SELECT mask_id, (k - k0)::INT AS k, (r - r0)::INT AS r, (c - c0)::INT AS c, c::DOUBLE AS x FROM ms, box")
def crop_to_box(spark, d):
    out, sub = masks.crop(t.masks(spark, d), L)
    return rounded(out.withColumn("x", sub.patient(F.col("k"), F.col("r"), F.col("c"))[0]), "x")


@register("mask_lookup", "SELECT n AS mask_id, k, r, c, (EXISTS (SELECT 1 FROM ms WHERE ms.mask_id = n AND ms.k = p.k AND ms.r = p.r AND ms.c = p.c))::INT AS value FROM (SELECT unnest([0, 2, 6]) AS k, unnest([0, 3, 10]) AS r, unnest([0, 4, 49]) AS c) p CROSS JOIN (SELECT unnest(['A', 'B', 'C', 'none']) AS n)")
def mask_lookup(spark, d):
    every = t.masks(spark, d)
    parts = [masks.value(every, L, k, r, c, ["A", "B", "C", "none"]).select("mask_id", *(F.lit(v).alias(n) for n, v in zip("krc", (k, r, c), strict=True)), "value") for k, r, c in ((0, 0, 0), (2, 3, 4), (6, 10, 49))]
    return parts[0].union(parts[1]).union(parts[2])


@register("mask_plane", "SELECT mask_id, k, r, c FROM ms WHERE k = 3")
def mask_plane(spark, d):
    return masks.plane(t.masks(spark, d), L, 3)


@register("field_lookup", "SELECT k, r, c, round(v, 6) AS v FROM vox WHERE (k = 1 AND r = 2 AND c = 3) OR k = 5")
def field_lookup(spark, d):
    field = t.field(spark, d)
    one = sampling.value(field, L, 1, 2, 3).select(F.lit(1).alias("k"), F.lit(2).alias("r"), F.lit(3).alias("c"), "v")
    return rounded(one.union(sampling.plane(field, L, 5)), "v")


@register("union_within_tolerance", "SELECT k, r, c FROM a UNION SELECT k, r, c FROM b")
def union_within_tolerance(spark, d):
    a, _, b, _ = ab(spark, d)
    moved = create_grid(L.rows, L.cols, planes=[(0.8, 0.0, z) for z in t.HEIGHTS], spacing=L.spacing, frame_uid=L.frame_uid)
    return masks.union(a, L, b, moved, Tolerance(position_mm=1.0)).select("k", "r", "c")


# --- grids, generators and vectors -----------------------------------------------------------


@register("uniform_planes", "SELECT i::INT AS k, round(1.5 + 0.6 * 2.5 * i, 6) AS x, 2.0::DOUBLE AS y, round(3 + 0.8 * 2.5 * i, 6) AS z, 2.5::DOUBLE AS thickness FROM range(9) q(i)", prelude=False)
def uniform_planes(spark, d):
    # the normal of these directions is (0.6, 0, 0.8)
    grid = uniform_grid(4, 5, 9, step=2.5, origin=(1.5, 2.0, 3.0), row_dir=(0.8, 0.0, -0.6), col_dir=(0.0, 1.0, 0.0))
    return rounded(grid.plane_table(spark).select("k", "x", "y", "z", "thickness"), "x", "y", "z", "thickness")


@register("analytic_volumes", "SELECT p_partkey AS id, round(p_size::DOUBLE ** 3, 4) AS cube, round(4 / 3 * pi() * p_size ** 3, 4) AS sphere, round(2 * pi() ** 2 * (p_size + 2) * 4, 4) AS torus FROM (SELECT DISTINCT p_size AS p_partkey, p_size FROM part)", prelude=False)
def analytic_volumes(spark, d):
    # sizes are fifty at any scale
    sizes = [r.p_size for r in t.read(spark, d, "part").select("p_size").distinct().collect()]
    rows = [(s, masks.analytic_volume("cube", s), masks.analytic_volume("sphere", s), masks.analytic_volume("torus", s + 2, 2)) for s in sizes]
    return rounded(spark.createDataFrame([(s, float(a), b, c) for s, a, b, c in rows], "id int, cube double, sphere double, torus double"), "cube", "sphere", "torus", digits=4)


@register("dense_mask", "SELECT mask_id, k, r, c FROM (SELECT 'dense' AS mask_id, *, (k * 11 + r) * 50 + c AS i FROM g) WHERE i % 7 = 3")
def dense_mask(spark, d):
    return masks.from_dense(spark, L, [int(i % 7 == 3) for i in range(L.voxels)], "dense").union(masks.empty(spark))


@register("dense_field", "SELECT k, r, c, (((k * 11 + r) * 50 + c) % 97 / 4.0)::DOUBLE AS v FROM g")
def dense_field(spark, d):
    out = sampling.from_dense(spark, L, [i % 97 / 4 for i in range(L.voxels)])
    return out.withColumn("v", F.col("v").cast("double"))


@register("generated_fields", "SELECT source, k, r, c, (c + 10 * r + 100 * k + 0.5 * (source = 'arrays')::INT)::DOUBLE AS v FROM g CROSS JOIN (SELECT unnest(['column', 'arrays']) AS source)")
def generated_fields(spark, d):
    @sampling.vectorised
    def ramp(c, r, k):
        return c + 10 * r + 100 * k + 0.5

    both = sampling.generated(spark, L, lambda c, r, k: c + 10 * r + 100 * k).withColumn("source", F.lit("column")).union(sampling.generated(spark, L, ramp).withColumn("source", F.lit("arrays")))
    return both.withColumn("v", F.col("v").cast("double"))


@register("vector_sums", "SELECT p_partkey AS id, x + 2 AS ax, y - 1 AS sy, 3 * x AS tx, round(x / sqrt(x * x + y * y + 9), 6) AS nx, round(sqrt((x - 2) ** 2 + (y + 1) ** 2 + 4), 6) AS far FROM (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 17)::DOUBLE AS y FROM part)", prelude=False)
def vector_sums(spark, d):
    a, b = fn.vec(F.col("p_size").cast("double"), (F.col("p_partkey") % 17).cast("double"), 3), fn.vec(2, -1, 1)
    out = t.read(spark, d, "part").select(F.col("p_partkey").alias("id"), fn.add(a, b)[0].alias("ax"), fn.sub(a, fn.vec(0, 1, 0))[1].alias("sy"), fn.scale(a, 3)[0].alias("tx"), fn.normalize(a)[0].alias("nx"), fn.distance(a, b).alias("far"))
    return rounded(out, "nx", "far")


@register("decimal_strings", "SELECT o_orderkey AS id, i::INT AS i, CASE WHEN i = 2 THEN -1 ELSE round(([o_totalprice, o_custkey / 8.0, 0])[i + 1], 4) END AS number FROM orders CROSS JOIN range(3) q(i)", prelude=False)
def decimal_strings(spark, d):
    price = F.format_string("%.4f", F.col("o_totalprice").cast("double"))
    text = F.concat(price, F.lit("\\ "), F.format_string("%.4f", F.col("o_custkey") / 8.0), F.lit(" \\none"))
    out = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(fn.numbers(text)).alias("i", "number"))
    return rounded(out.na.fill(-1.0, ["number"]), "number", digits=4)


# --- dose queries ----------------------------------------------------------------------------


RUN = ", run AS (SELECT mask_id, v, sum(vol) OVER (PARTITION BY mask_id ORDER BY v DESC) AS upto, sum(vol) OVER (PARTITION BY mask_id) AS total FROM {})"


@register("dose_at", RUN.format("ms") + " SELECT mask_id, percent, round(coalesce(max(CASE WHEN upto >= percent / 100 * total THEN v END), min(v)), 6) AS value, 'whole' AS mode, false AS resampled FROM run CROSS JOIN (SELECT unnest([95.0, 50.0, 2.0])::DOUBLE AS percent) GROUP BY mask_id, percent")
def dose_at(spark, d):
    out = DoseQuery(t.field(spark, d), L).dose_at([95, 50, 2], t.masks(spark, d), L)
    return rounded(out.select("mask_id", F.round("percent", 6).alias("percent"), "value", "method.mode", "method.resampled"), "value")


VOLUMES = "SELECT mask_id, threshold, round(sum(CASE WHEN v >= threshold THEN vol ELSE 0 END), 4) AS vol, round(sum(CASE WHEN v >= threshold THEN vol ELSE 0 END) / sum(vol), 6) AS fraction FROM {} CROSS JOIN (SELECT unnest([55000.0, 62000.0])::DOUBLE AS threshold) GROUP BY ALL"


@register("volume_at", VOLUMES.format("ms"))
def volume_at(spark, d):
    out = DoseQuery(t.field(spark, d), L).volume_at([55000, 62000], t.masks(spark, d), L)
    return rounded(rounded(out.select("mask_id", "threshold", "vol", "fraction"), "vol", digits=4), "fraction")


FINE = f""", fine AS (SELECT m.k, m.r, m.c, vol / 8 AS vol, i, j, l FROM cc m CROSS JOIN range(2) q1(i) CROSS JOIN range(2) q2(j) CROSS JOIN range(2) q3(l)),
pts AS (SELECT ((k * 11 + r) * 50 + c) * 8 + i * 4 + j * 2 + l AS pid, vol, c + ((i + 0.5) / 2 - 0.5) AS x, 2 * (r + ((j + 0.5) / 2 - 0.5)) AS y, ({H})[k + 1] + ({THICK})[k + 1] * ((l + 0.5) / 2 - 0.5) AS z FROM fine) {TRILINEAR}
, s AS (SELECT 'C' AS mask_id, coalesce(val, 0.0) AS v, vol FROM pts LEFT JOIN tri USING (pid))"""


def fine_query(spark, d):
    return DoseQuery(t.field(spark, d), L, supersample=2), t.mask(spark, d, "C")


@register("dose_at_supersampled", FINE + RUN.format("s") + " SELECT mask_id, percent, round(coalesce(max(CASE WHEN upto >= percent / 100 * total THEN v END), min(v)), 3) AS value, 8 AS parts FROM run CROSS JOIN (SELECT unnest([90.0, 50.0])::DOUBLE AS percent) GROUP BY mask_id, percent")
def dose_at_supersampled(spark, d):
    query, mask = fine_query(spark, d)
    return rounded(query.dose_at([90, 50], mask, L).select("mask_id", F.round("percent", 6).alias("percent"), "value", F.lit(query.parts).alias("parts")), "value", digits=3)


@register("volume_at_supersampled", FINE + " " + VOLUMES.format("s"))
def volume_at_supersampled(spark, d):
    query, mask = fine_query(spark, d)
    return rounded(rounded(query.volume_at([55000, 62000], mask, L).select("mask_id", "threshold", "vol", "fraction"), "vol", digits=4), "fraction")


@register("dvh_supersampled", FINE + """, e AS (SELECT mask_id, max(v) AS top, sum(vol) AS total FROM s GROUP BY mask_id), got AS (SELECT least(floor(v / (top / 32)), 31)::INT AS bin, vol FROM s JOIN e USING (mask_id))
SELECT mask_id, i::INT AS i, round(top * i / 32, 4) AS dose, round(CASE WHEN i = 32 THEN 0 ELSE coalesce((SELECT sum(vol) FROM got WHERE bin >= i), 0) END, 4) AS vol, 'supersample' AS mode FROM e CROSS JOIN range(33) q(i)""")
def dvh_supersampled(spark, d):
    query, mask = fine_query(spark, d)
    return rounded(query.histogram(mask, L, 32).select("mask_id", "i", "dose", "vol", "method.mode"), "dose", "vol", digits=4)


@register("dose_sample", f", {POINTS} {TRILINEAR} SELECT p.pid AS point_id, round(coalesce(val, 0.0), 6) AS value FROM pts p LEFT JOIN tri USING (pid)")
def dose_sample(spark, d):
    return rounded(DoseQuery(t.field(spark, d), L).sample(points(spark, d)).select("point_id", "value"), "value")


# --- contours --------------------------------------------------------------------------------


@register("hole_interpretation", """, firsts AS (SELECT mask_id, contour_no, k, x AS px, y AS py FROM cont WHERE i = 1),
par AS (SELECT f.mask_id, f.contour_no, e.contour_no AS other, count(*) FILTER (px < x0 + (py - y0) / (y1 - y0) * (x1 - x0)) % 2 = 1 AS inside
  FROM firsts f JOIN edge e ON e.mask_id = f.mask_id AND e.k = f.k AND e.contour_no <> f.contour_no AND least(y0, y1) <= py AND py < greatest(y0, y1) GROUP BY ALL)
SELECT f.mask_id, CASE WHEN coalesce(bool_or(inside), false) THEN 'nested-even-odd' ELSE 'none' END AS interpretation FROM firsts f LEFT JOIN par USING (mask_id, contour_no) GROUP BY 1""")
def hole_interpretation(spark, d):
    return contours.hole_interpretation(placed(spark, d), L)


@register("xor_homogeneity", "SELECT mask_id, count(DISTINCT contour_no % 4 = 0) > 1 AS mixed FROM cont GROUP BY 1")
def xor_homogeneity(spark, d):
    kind = F.when(F.col("contour_no") % 4 == 0, "CLOSEDPLANAR_XOR").otherwise("CLOSED_PLANAR")
    return contours.homogeneous(t.contours(spark, d).withColumn("geometric_type", kind))


@register("outline_order", """WITH b AS (SELECT n_name AS mask_id, n_nationkey AS n, n_nationkey % 7 AS k, n_nationkey % 4 AS r0, n_nationkey % 4 + n_nationkey % 3 AS r1, n_nationkey AS c0, n_nationkey + n_nationkey % 5 AS c1 FROM nation),
s AS (SELECT *, c1 - c0 + 1 AS w, r1 - r0 + 1 AS h FROM b), v AS (SELECT s.*, i FROM s, range(100) q(i) WHERE i < 2 * (w + h))
SELECT mask_id, i::INT AS i, (CASE WHEN i < w THEN c0 - 0.5 + i WHEN i < w + h THEN c1 + 0.5 WHEN i < 2 * w + h THEN c1 + 0.5 - (i - w - h) ELSE c0 - 0.5 END)::DOUBLE AS x,
  (2 * CASE WHEN i < w THEN r0 - 0.5 WHEN i < w + h THEN r0 - 0.5 + (i - w) WHEN i < 2 * w + h THEN r1 + 0.5 ELSE r1 + 0.5 - (i - 2 * w - h) END)::DOUBLE AS y FROM v""", prelude=False)
def outline_order(spark, d):
    """Rectangles: their outlines start at the first corner and go clockwise."""
    n = F.col("n_nationkey")
    rows = t.read(spark, d, "nation").select(F.col("n_name").alias("mask_id"), (n % 7).cast("int").alias("k"), F.explode(F.sequence(n % 4, n % 4 + n % 3).cast("array<int>")).alias("r"), n.alias("n"))
    boxes = rows.select("mask_id", "k", "r", F.explode(F.sequence(F.col("n"), F.col("n") + F.col("n") % 5).cast("array<int>")).alias("c"))
    return contours.vectorize(boxes, L).select("mask_id", F.posexplode("points").alias("i", "p")).select("mask_id", "i", "p.x", "p.y")


def document(spark, data: bytes, doc: str = "doc"):
    return spark.createDataFrame([(doc, bytearray(data))], "doc string, content binary")


@register("contour_coordinates", f"SELECT mask_id, n::INT AS contour_no, (i - 1)::INT AS i, round(x / 3, 6) AS x, round(2 * y / 7, 6) AS y FROM (SELECT *, dense_rank() OVER (PARTITION BY mask_id ORDER BY contour_no) - 1 AS n FROM cont)")
def contour_coordinates(spark, d):
    """Coordinates that have no short decimals, written with six of them."""
    rows = t.contours(spark, d).withColumn("points", F.transform("points", lambda p: F.struct((p["x"] / 3).alias("x"), (p["y"] / 7).alias("y"), p["z"].alias("z"))))
    files = t.structure_files(rows)
    names = dicom.read_rois(files).select(F.col("mask_id").alias("id"), "name")
    out = t.read_back(files).join(F.broadcast(names), F.col("mask_id") == F.col("id")).select(F.col("name").alias("mask_id"), "contour_no", F.posexplode("points").alias("i", "p"))
    return rounded(out.select("mask_id", "contour_no", "i", "p.x", "p.y"), "x", "y")


@register("structure_from_mask", SIDES + f" SELECT 'C' AS name, k, c + ([-0.5, 0.5, 0.5, -0.5])[side + 1]::DOUBLE AS x, 2 * (r + ([-0.5, -0.5, 0.5, 0.5])[side + 1])::DOUBLE AS y FROM sides WHERE mask_id = 'C'")
def structure_from_mask(spark, d):
    files = document(spark, structures.from_mask(t.mask(spark, d, "C"), L, "C"))
    named = dicom.read_rois(files).select(F.col("mask_id").alias("id"), "name")
    out = contours.associate(dicom.read_contours(files), L).join(named, F.col("mask_id") == F.col("id"))
    return out.select("name", "k", F.explode("points").alias("p")).select("name", "k", "p.x", "p.y")


@register("structure_plane", RASTER + " SELECT k, r, c FROM filled WHERE mask_id = 'roi1' AND k = 2")
def structure_plane(spark, d):
    files = t.structure_files(t.contours(spark, d))
    rois = dicom.read_rois(files)
    (roi,) = rois.filter("name = 'roi1'").collect()
    return structures.load_tables(t.read_back(files), rois, L).mask_plane(roi.mask_id, 2).select("k", "r", "c")


# --- metadata --------------------------------------------------------------------------------


@register("structure_metadata", """SELECT (n_nationkey + 1)::INT AS number, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' ' ELSE '' END AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 4.0 ELSE -1 END::DOUBLE AS volume_cm3,
CASE WHEN n_nationkey % 5 = 0 THEN '1.2.' || n_regionkey ELSE '' END AS frame_uid, CASE WHEN n_nationkey % 4 = 0 THEN 'PTV' ELSE 'ORGAN' END AS interpreted_type, 1::BIGINT AS namesakes FROM nation""", prelude=False)
def structure_metadata(spark, d):
    nations = t.read(spark, d, "nation").orderBy("n_nationkey").collect()
    rois = [dicom.Roi(0, n.n_name + " " * (n.n_nationkey % 3 == 0), [dicom.Contour("POINT", [(1.0, 2.0, 3.0)])], "PTV" if n.n_nationkey % 4 == 0 else "ORGAN", n.n_nationkey / 4 if n.n_nationkey % 2 == 0 else None, f"1.2.{n.n_regionkey}" if n.n_nationkey % 5 == 0 else None) for n in nations]
    got = dicom.parse_structures(dicom.write_structures(rois, shuffle=True))
    found = [got.roi(i) for i in got.numbers()]
    return spark.createDataFrame([(r.number, r.name, -1.0 if r.volume_cm3 is None else r.volume_cm3, r.frame_uid or "", r.interpreted_type, len(got.by_name(n))) for r, n in zip(found, got.names(), strict=True)], "number int, name string, volume_cm3 double, frame_uid string, interpreted_type string, namesakes long")


@register("dose_metadata", """SELECT 'dose' || r_regionkey AS doc, CASE WHEN r_regionkey = 1 THEN 'RELATIVE' ELSE 'GY' END AS units, (0.5 + r_regionkey)::DOUBLE AS scaling, 'PHYSICAL' AS dose_type, 'PLAN' AS summation,
(-3 * (0.5 + r_regionkey))::DOUBLE AS least, (8 * (0.5 + r_regionkey))::DOUBLE AS greatest, CASE WHEN r_regionkey = 1 THEN 'DOSE_UNITS_NOT_GY' WHEN r_regionkey = 2 THEN 'DOSE_FRAMES_REORDERED' ELSE '' END AS notes FROM region""", prelude=False)
def dose_metadata(spark, d):
    """Doses of 16 bits and a sign, with other units or frames out of order."""
    import numpy as np

    grid, rows = uniform_grid(2, 3, 2, step=2.0), []
    for r in t.read(spark, d, "region").orderBy("r_regionkey").collect():
        i = r.r_regionkey
        stored = np.arange(12).reshape(2, 2, 3) - 3
        got = dicom.parse_dose(dicom.write_dose(grid, stored, scaling=0.5 + i, units="RELATIVE" if i == 1 else "GY", bits=16, signed=True, offsets=[0.0, -2.0] if i == 2 else None))
        codes = [n.code for n in got.diagnostics]
        rows.append((f"dose{i}", got.units, got.scaling, got.dose_type, got.summation, float(got.values.min()), float(got.values.max()), ",".join(codes)))
    return spark.createDataFrame(rows, "doc string, units string, scaling double, dose_type string, summation string, least double, greatest double, notes string")


@register("segment_metadata", "SELECT (r_regionkey + 1)::INT AS number, r_name AS label, 'T' || r_regionkey AS code, 'Tissue ' || r_name AS meaning, 7::BIGINT AS frames, true AS has, false AS has_next FROM region", prelude=False)
def segment_metadata(spark, d):
    import numpy as np

    regions = t.read(spark, d, "region").orderBy("r_regionkey").collect()
    values = np.ones((len(L.planes), L.rows, L.cols), bool)
    seg = dicom.parse_segmentation(dicom.write_segmentation("BINARY", L, [(dicom.Segment(r.r_regionkey + 1, r.r_name, category=dicom.Code(f"T{r.r_regionkey}", "SRT", f"Tissue {r.r_name}")), values) for r in regions]))
    return spark.createDataFrame([(s.number, s.label, s.category.value, s.category.meaning, s.frame_count, seg.has(s.number), seg.has(s.number + len(regions))) for s in seg.segments], "number int, label string, code string, meaning string, frames long, has boolean, has_next boolean")


@register("folder_classes", "SELECT * FROM (VALUES ('0', 'structure'), ('1', 'dose'), ('2', 'segmentation'), ('3', 'image')) v(doc, kind)", prelude=False)
def folder_classes(spark, d):
    import numpy as np

    from voxelmill.sources.codec import View, decode_file

    shape = (len(L.planes), L.rows, L.cols)
    files = [dicom.write_structures([dicom.Roi(0, "a", [])]), dicom.write_dose(L, np.ones(shape, int)), dicom.write_segmentation("BINARY", L, [(dicom.Segment(1), np.ones(shape, bool))]), dicom.write_image(L, 0, "1.9.1")]
    return spark.createDataFrame([(str(i), dicom.classify(View(decode_file(data)))) for i, data in enumerate(files)], "doc string, kind string")


@register("image_series", f"SELECT '1.9.' || (i + 1) AS sop_uid, i::INT AS k, ({H})[i + 1]::DOUBLE AS z, 'SLICE_ORDER_REVERSED' AS note FROM range(7) q(i)", prelude=False)
def image_series(spark, d):
    files = [dicom.write_image(L, k, f"1.9.{k + 1}") for k in reversed(range(len(L.planes)))]
    grid, planes, notes = dicom.parse_series(files)
    L.require_same(grid)
    return spark.createDataFrame([(sop, k, grid.planes[k][2], ",".join(n.code for n in notes)) for sop, k in planes], "sop_uid string, k int, z double, note string")


@register("distinct_planes", "SELECT i::INT AS k, (2.0 * i)::DOUBLE AS z FROM range(4) q(i)", prelude=False)
def distinct_planes(spark, d):
    """Two segments whose frames lie 0.3 mm apart share planes: the first position of each stays."""
    import numpy as np

    from voxelmill.sources.codec import decode_file

    grid = uniform_grid(3, 3, 4, step=2.0)
    data = dicom.write_segmentation("BINARY", grid, [(dicom.Segment(n), np.ones((4, 3, 3), bool)) for n in (1, 2)])
    assert decode_file(data)
    near = [(0.0, 0.0, 2.0 * k + shift) for shift in (0.0, 0.3) for k in range(4)]
    kept = dicom.distinct_positions(near, grid.normal)
    return spark.createDataFrame([(k, p[2]) for k, p in enumerate(kept)], "k int, z double")


@register("provenance", "SELECT 'voxelmill 0.1.0' AS software, 'segmentation-to-structure' AS direction, 11 AS rows, 50 AS columns, 7 AS planes, '1.2.3' AS frame_uid, 'vectorize' AS steps", prelude=False)
def provenance(spark, d):
    data = dicom.write_segmentation("BINARY", L, [(dicom.Segment(1, "C"), convert.dense(t.mask(spark, d, "C"), L))])
    _, record = convert.segmentation_to_structure(spark, dicom.parse_segmentation(data), 1)
    g = record.grid
    return spark.createDataFrame([(record.software, record.direction, g["rows"], g["columns"], g["planes"], g["frame_uid"], ",".join(s["kind"] for s in record.lossy_steps))], "software string, direction string, rows int, columns int, planes int, frame_uid string, steps string")


# --- segmentations of fractions and labels ---------------------------------------------------

STORED = "least(greatest(floor(v / 100000.0 * 200 + 0.5), 0), 200)"
FRAC = f"frac AS (SELECT g.k, g.r, g.c, coalesce(({STORED} / 200)::FLOAT::DOUBLE, 0.0) AS v FROM g LEFT JOIN vox USING (k, r, c))"


def fractional(spark, d) -> dicom.Segmentation:
    """The field as a fractional segment of steps of 1/200, written and parsed."""
    import numpy as np

    rows = t.field(spark, d).toArrow()
    values = np.zeros((len(L.planes), L.rows, L.cols))
    values[tuple(rows.column(x).to_numpy() for x in masks.KEY)] = rows.column("v").to_numpy() / 100000.0
    return dicom.parse_segmentation(dicom.write_segmentation("FRACTIONAL", L, [(dicom.Segment(1, "v"), values)], fractional_type="PROBABILITY", maximum=200))


@register("fractional_roundtrip", f", {FRAC} SELECT k, r, c, round(v, 6) AS v FROM frac")
def fractional_roundtrip(spark, d):
    out = sampling.from_dense(spark, L, fractional(spark, d).field(1))
    return rounded(out.withColumn("v", F.col("v").cast("double")), "v")


@register("fractional_support", f", {FRAC} SELECT k, r, c, v >= 0.55 AS above FROM frac WHERE v > 0")
def fractional_support(spark, d):
    seg = fractional(spark, d)
    cut = dose.threshold_mask(sampling.from_dense(spark, L, seg.field(1)), 0.55, "cut").select("k", "r", "c", F.lit(True).alias("above"))
    return convert.sparse(spark, seg.support(1), "v").select("k", "r", "c").join(cut, masks.KEY, "left").withColumn("above", F.coalesce("above", F.lit(False)))


@register("confidence_at_points", f", {FRAC}, {POINTS} {TRILINEAR.replace('JOIN vox ON vox.k = gk AND vox.r = gr AND vox.c = gc', 'JOIN frac ON frac.k = gk AND frac.r = gr AND frac.c = gc')} SELECT p.pid AS point_id, round(coalesce(val, 0.0), 5) AS value FROM pts p LEFT JOIN tri USING (pid)")
def confidence_at_points(spark, d):
    return rounded(segments.sample_confidence(points(spark, d), fractional(spark, d), 1).select("point_id", "value"), "value", digits=5)


@register("labelmap_roundtrip", "SELECT CASE WHEN c.k IS NULL THEN 2 ELSE 300 END AS segment, a.k, a.r, a.c FROM a LEFT JOIN cc c USING (k, r, c)")
def labelmap_roundtrip(spark, d):
    """Two segments that share no voxel, one numbered beyond eight bits."""
    a, c = (convert.dense(t.mask(spark, d, n), L) for n in ("A", "C"))
    data = dicom.write_segmentation("LABELMAP", L, [(dicom.Segment(2, "rest"), a & ~c), (dicom.Segment(300, "C"), c)])
    return dicom.read_masks(document(spark, data)).select(F.substring_index("mask_id", "#", -1).cast("int").alias("segment"), "k", "r", "c")


@register("sparse_frames", ", m AS (SELECT 'A' AS n, k FROM a WHERE k % 2 = 0 GROUP BY k) SELECT 1 AS segment, count(*) AS frames, (SELECT count(*) FROM a WHERE k % 2 = 0) AS voxels FROM m")
def sparse_frames(spark, d):
    seg = dicom.parse_segmentation(dicom.write_segmentation("BINARY", L, [(dicom.Segment(1, "A"), convert.dense(t.mask(spark, d, "A").filter("k % 2 = 0"), L))], sparse=True))
    return spark.createDataFrame([(s.number, s.frame_count, int(seg.mask(s.number).sum())) for s in seg.segments], "segment int, frames long, voxels long")


# --- many documents at once ------------------------------------------------------------------


@register("written_segmentations", "SELECT 'plane' || k % 2 AS doc, row_number() OVER (PARTITION BY k % 2, k, r, c ORDER BY mask_id) > 0 AS there, dense_rank() OVER (PARTITION BY k % 2 ORDER BY mask_id)::INT AS segment, k, r, c FROM ms")
def written_segmentations(spark, d):
    rows = t.masks(spark, d).withColumn("doc", F.concat(F.lit("plane"), (F.col("k") % 2).cast("string")))
    back = dicom.read_masks(dicom.write_segmentations(rows, L))
    return back.select("doc", F.lit(True).alias("there"), F.substring_index("mask_id", "#", -1).cast("int").alias("segment"), "k", "r", "c")


@register("written_doses", "SELECT doc, k, r, c, round(floor(v / 100 / scale * 2 + 0.5) * 0.5, 4) AS v FROM vox CROSS JOIN (SELECT unnest(['one', 'two']) AS doc, unnest([1, 2]) AS scale)")
def written_doses(spark, d):
    both = t.field(spark, d).select(F.explode(F.array(F.struct(F.lit("one").alias("doc"), F.lit(1).alias("scale")), F.struct(F.lit("two").alias("doc"), F.lit(2).alias("scale")))).alias("s"), "k", "r", "c", "v")
    files = dicom.write_doses(both.select("s.doc", "k", "r", "c", (F.col("v") / 100 / F.col("s.scale")).alias("v")), L, scaling=0.5)
    present = t.field(spark, d).select("k", "r", "c")
    return rounded(dicom.read_doses(files).join(present, masks.KEY, "left_semi").select("doc", "k", "r", "c", F.col("v").cast("double").alias("v")), "v", digits=4)


@register("written_structures", "SELECT 'set' || contour_no % 3 AS doc, mask_id AS name, count(DISTINCT contour_no) AS contours, count(*) AS points, round(sum(x), 4) AS xs FROM cont GROUP BY ALL")
def written_structures(spark, d):
    files = dicom.write_structure_sets(t.contours(spark, d).withColumn("doc", F.concat(F.lit("set"), (F.col("contour_no") % 3).cast("string")))).persist()
    names = dicom.read_rois(files).select("mask_id", "name")
    sums = dicom.read_contours(files).groupBy("doc", "mask_id").agg(F.count("*").alias("contours"), F.sum(F.size("points")).alias("points"), F.sum(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"])).alias("xs"))
    return rounded(sums.join(names, "mask_id").select("doc", "name", "contours", "points", "xs"), "xs", digits=4)


# --- reports ---------------------------------------------------------------------------------


@register("value_checksums", """, px AS (SELECT s.k, i, coalesce(floor(v / 500)::BIGINT & 255, 0) AS v FROM (SELECT DISTINCT k FROM vox) s CROSS JOIN range(550) q(i) LEFT JOIN vox ON vox.k = s.k AND vox.r * 50 + vox.c = i),
h AS (SELECT k, list_prepend(2166136261::BIGINT, list(v ORDER BY i)) AS vs, count(*) FILTER (v <> 0) AS nonzero, sum(v)::BIGINT AS sum, max(v) AS max FROM px GROUP BY ALL)
SELECT k, list_reduce(vs, lambda h, v: (xor(h, v) * 16777619) & 4294967295) AS checksum, nonzero, sum, max FROM h""")
def value_checksums(spark, d):
    stored = t.field(spark, d).select("k", (F.col("r") * L.cols + F.col("c")).alias("i"), F.floor(F.col("v") / 500).cast("int").bitwiseAND(255).alias("v"))
    return report.value_checksums(stored, ["k"], L.rows * L.cols)


SLICES = "WITH s AS (SELECT l_linenumber AS segment, l_suppkey % 50 + l_linenumber / 3000.0::DOUBLE AS z, sum(l_partkey)::BIGINT AS checksum, count(*) AS nonzero, sum(CASE WHEN l_quantity > 1 OR l_suppkey % 2 = 0 THEN l_partkey END)::BIGINT AS sum_b, count(*) FILTER (l_quantity > 1 OR l_suppkey % 2 = 0) AS n_b FROM lineitem GROUP BY ALL)"


@register("slice_comparison", SLICES + """, b AS (SELECT segment, z + 0.0001 AS z, sum_b AS checksum, n_b AS nonzero FROM s WHERE segment < 7 AND (l_mod(z) <> 3) AND n_b > 0),
m AS (SELECT s.segment, s.z, s.nonzero, s.checksum = b.checksum AND s.nonzero = b.nonzero AS same, b.segment IS NOT NULL AS both FROM s LEFT JOIN b ON b.segment = s.segment AND floor(b.z * 1000 + 0.5) = floor(s.z * 1000 + 0.5))
SELECT m.segment, n.total IS NOT NULL AS matched, coalesce(sum(nonzero) - any_value(n.total), -1)::BIGINT AS count_delta, count(*) FILTER (m.both) AS checked, count(*) FILTER (m.both AND same) AS exact, count(*) FILTER (NOT m.both AND nonzero > 0) AS missing, round(coalesce(min(CASE WHEN m.both AND NOT same THEN z END), -1), 6) AS first_mismatch_z
FROM m LEFT JOIN (SELECT segment, sum(nonzero) AS total FROM b GROUP BY 1) n USING (segment) GROUP BY m.segment, n.total""".replace("l_mod(z)", "(floor(z)::BIGINT % 11)"), prelude=False)
def slice_comparison(spark, d):
    keep = F.expr("l_quantity > 1 or l_suppkey % 2 = 0")
    z = (F.col("l_suppkey") % 50 + F.col("l_linenumber") / 3000.0).alias("z")
    rows = t.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("segment"), z).agg(F.sum("l_partkey").alias("checksum"), F.count("*").alias("nonzero"), F.sum(F.when(keep, F.col("l_partkey"))).alias("sum_b"), F.count_if(keep).alias("n_b"))
    ours = rows.select("segment", "z", "checksum", "nonzero")
    theirs = rows.filter("segment < 7 and floor(z) % 11 <> 3 and n_b > 0").select("segment", (F.col("z") + 0.0001).alias("z"), F.col("sum_b").alias("checksum"), F.col("n_b").alias("nonzero"))
    return rounded(report.compare_slices(ours, theirs).na.fill(-1, ["count_delta", "first_mismatch_z"]), "first_mismatch_z")


@register("flagged_metrics", """, s AS (SELECT mask_id, max(v) AS mx, sum(vol) AS vo FROM ms GROUP BY 1), o AS (SELECT lower(mask_id) AS name, unnest(['mx', 'vo']) AS metric, unnest([mx, vo]) AS ours, unnest([mx * 1.01, vo * 1.05]) AS theirs FROM s)
SELECT dense_rank() OVER (ORDER BY round(abs((ours - theirs) / theirs) * 100, 4) DESC) AS place, name, metric, round((ours - theirs) / theirs * 100, 4) AS percent FROM o WHERE abs(ours - theirs) > greatest(CASE metric WHEN 'mx' THEN 0.5 ELSE 1.0 END, 0.02 * abs(theirs))""")
def flagged_metrics(spark, d):
    ours = masked(spark, d).groupBy("mask_id").agg(F.max("v").alias("mx"), F.sum("vol").alias("vo")).withColumnRenamed("mask_id", "name")
    theirs = ours.select("name", (F.col("mx") * 1.01).alias("mx"), (F.col("vo") * 1.05).alias("vo"))
    # a report of a few rows: its order is made visible here
    rows = report.flagged(report.agreement(ours, theirs, {"mx": "dose", "vo": "volume"})).select("name", "metric", F.round("percent", 4).alias("percent")).collect()
    places = [1]
    for before, after in zip(rows, rows[1:], strict=False):
        places.append(places[-1] + (abs(after.percent) != abs(before.percent)))
    return spark.createDataFrame([(i, *r) for i, r in zip(places, rows, strict=False)], "place long, name string, metric string, percent double")


NOISE = """WITH i AS (SELECT o_custkey AS series, o_orderkey AS n, 1 + o_orderkey % 3 * 0.01::DOUBLE AS s0, o_orderkey % 5 * 0.02::DOUBLE AS tilt, o_orderkey % 4 * 0.1::DOUBLE AS px, (o_orderkey % 1000)::DOUBLE AS pz, o_orderkey % 3 AS digits FROM orders),
f AS (SELECT *, first_value(s0) OVER w AS f0, first_value(tilt) OVER w AS ft, first_value(px) OVER w AS fx, first_value(pz) OVER w AS fz, count(*) OVER (PARTITION BY series) AS instances FROM i WINDOW w AS (PARTITION BY series ORDER BY n)),
m AS (SELECT *, 1 / sqrt(1 + ft * ft) AS cz, abs(s0 - f0) AS apart, acos(least(1.0, greatest(-1.0, (1 + tilt * ft) / (sqrt(1 + tilt * tilt) * sqrt(1 + ft * ft))))) AS ra FROM f WHERE instances > 1),
p AS (SELECT *, (px - fx) * (-ft * cz) + (pz - fz) * cz AS along FROM m),
g AS (SELECT *, sqrt(greatest((px - fx - along * (-ft * cz)) ** 2 + (pz - fz - along * cz) ** 2, 0)) AS aside, along - lag(along) OVER (PARTITION BY series ORDER BY along) AS gap FROM p)"""


@register("series_noise", NOISE + " SELECT series, max(instances) AS instances, round(max(apart), 6) AS spacing_spread, round(max(ra), 5) AS row_angle, 0.0::DOUBLE AS col_angle, round(max(aside), 5) AS off_axis, round(min(gap), 5) AS min_gap, round(avg(gap), 5) AS mean_gap, round(max(gap), 5) AS max_gap, min(digits)::INT AS digits FROM g GROUP BY series", prelude=False)
def series_noise(spark, d):
    o = F.col("o_orderkey")
    tilt, zero, one = o % 5 * 0.02, F.lit(0.0), F.lit(1.0)
    digits = F.element_at(F.array(F.lit("7"), F.lit("7.5"), F.lit("7.25")), (o % 3 + 1).cast("int"))
    rows = t.read(spark, d, "orders").select(
        F.col("o_custkey").alias("series"), o.alias("n"), F.array(1 + o % 3 * 0.01, F.lit(2.0)).alias("spacing"), F.array(one, zero, tilt, zero, one, zero).alias("orientation"),
        F.array(o % 4 * 0.1, zero, (o % 1000).cast("double")).alias("position"), F.array(digits, F.lit("0.0000"), F.lit("1e-3"), F.lit("3.1415")).alias("decimals"),
    )
    out = report.series_noise(rows, "series", "n")
    return rounded(rounded(out, "spacing_spread"), "row_angle", "col_angle", "off_axis", "min_gap", "mean_gap", "max_gap", digits=5)


@register("report_files", "SELECT mask_id AS name, count(*) AS voxels, round(max(v), 4) AS greatest FROM ms GROUP BY 1")
def report_files(spark, d):
    """A report written as JSON lines and read back."""
    path = t.scratch(spark, "report")
    report.write_report(rounded(masked(spark, d).groupBy(F.col("mask_id").alias("name")).agg(F.count("*").alias("voxels"), F.max("v").alias("greatest")), "greatest", digits=4), path)
    return spark.read.schema("name string, voxels long, greatest double").json(path)


@register("stream_of_doses", "SELECT 'dose' || n || '.dcm' AS doc, 12::BIGINT AS voxels, (11.0 * (n + 1))::DOUBLE AS greatest FROM range(3) q(n)", prelude=False)
def stream_of_doses(spark, d):
    """Files that arrive one a batch, parsed by the batch reader within the stream."""
    import numpy as np

    base, grid = t.scratch(spark, "stream"), uniform_grid(2, 3, 2)
    files = spark.createDataFrame([(f"dose{n}.dcm", bytearray(dicom.write_dose(grid, np.arange(12).reshape(2, 2, 3), scaling=n + 1.0))) for n in range(3)], "name string, content binary")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for r in files.collect():
        path = hadoop.Path(f"{base}/in/{r.name}")
        out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path)
        out.write(r.content)
        out.close()
    ingest.ingest(spark, f"{base}/in", f"{base}/checkpoint", dicom.read_doses, f"{base}/out", files_per_batch=1).awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy(F.substring_index("doc", "/", -1).alias("doc")).agg(F.count("*").alias("voxels"), F.max("v").cast("double").alias("greatest"))


# --- what is refused, and what is noted ------------------------------------------------------


def refusals(spark) -> list[tuple[str, str]]:
    """Each case and the error it raises."""
    import numpy as np

    shape = (len(L.planes), L.rows, L.cols)
    ones, elsewhere = np.ones(shape, bool), create_grid(L.rows, L.cols, planes=list(L.planes), spacing=L.spacing, frame_uid="1.2.4")
    none, single = masks.empty(spark), uniform_grid(2, 2, 1)
    binary = dicom.parse_segmentation(dicom.write_segmentation("BINARY", L, [(dicom.Segment(1), ones)]))
    half = dicom.parse_segmentation(dicom.write_segmentation("FRACTIONAL", L, [(dicom.Segment(1), ones * 0.5)], fractional_type="OCCUPANCY"))
    square = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (4.0, 4.0, 0.0)]
    twins = dicom.parse_structures(dicom.write_structures([dicom.Roi(0, "twin", [dicom.Contour("CLOSED_PLANAR", square)], frame_uid="1.2.9")] * 2))
    mixed = dicom.parse_structures(dicom.write_structures([dicom.Roi(0, "m", [dicom.Contour("CLOSED_PLANAR", square), dicom.Contour("CLOSEDPLANAR_XOR", square)])]))
    short = dicom.parse_structures(dicom.write_structures([dicom.Roi(0, "s", [dicom.Contour("CLOSED_PLANAR", square[:2])])]))
    dose_file, seg_file = dicom.write_dose(L, np.ones(shape, int)), dicom.write_segmentation("BINARY", L, [(dicom.Segment(1), ones)])
    cases = {
        "ambiguous name": lambda: twins.roi("twin"),
        "box off the grid": lambda: masks.crop(none, L, (0, 99, 0, 1, 0, 1)),
        "box of nothing": lambda: masks.crop(none, L),
        "budget": lambda: uniform_grid(4096, 4096, 100).require_budget(),
        "centroid of nothing": lambda: masks.centroid(none, L, ["x"]).collect(),
        "contour too short": lambda: structures.load(spark, short, L).masks.collect(),
        "dose as segmentation": lambda: dicom.parse_segmentation(dose_file),
        "field of a binary segment": lambda: binary.field(1),
        "frames differ": lambda: masks.displacement(none, L, none, elsewhere),
        "grids differ": lambda: masks.union(none, L, none, uniform_grid(2, 2, 2)),
        "index off the grid": lambda: masks.value(none, L, 7, 0, 0),
        "mask of a fractional segment": lambda: half.mask(1),
        "no such segment": lambda: binary.mask(2),
        "no threshold": lambda: convert.segmentation_to_structure(spark, half, 1),
        "not a dose": lambda: dicom.parse_dose(seg_file),
        "offsets missing": lambda: dicom.parse_dose(dicom.write_dose(L, np.ones(shape, int), offsets=[0.0, 1.0])),
        "overlapping labels": lambda: dicom.write_segmentation("LABELMAP", L, [(dicom.Segment(1), ones), (dicom.Segment(2), ones)]),
        "quantile of nothing": lambda: dose.value_at(dose.samples(sampling.from_dense(spark, L, np.ones(shape)), none, L), [0.5], ["x"]).collect(),
        "series of two sizes": lambda: dicom.parse_series([dicom.write_image(L, 0, "1.9.1"), dicom.write_image(uniform_grid(2, 2, 2, frame_uid="1.2.3"), 1, "1.9.2")]),
        "single plane": lambda: single.thickness(0),
        "strict frames": lambda: structures.load(spark, twins, L, strictness="strict"),
        "threshold too great": lambda: convert.segmentation_to_structure(spark, half, 1, threshold=1.5),
        "tilted directions": lambda: create_grid(2, 2, planes=[(0, 0, 0)], row_dir=(1, 0, 0), col_dir=(1, 1, 0)),
        "unset sparse frames": lambda: dicom.write_segmentation("BINARY", L, [(dicom.Segment(1), ~ones)], sparse=True),
        "volume by contours": lambda: masks.volume(none, L, "contour"),
        "xor mixed": lambda: structures.load(spark, mixed, L),
    }
    out = []
    for name, run in cases.items():
        try:
            run()
            out.append((name, "nothing"))
        except (errors.VoxelError, ValueError, IndexError, TypeError) as e:
            out.append((name, type(e).__name__))
        except Exception:
            out.append((name, "failure of the job"))
    return out


REFUSED = {
    "ambiguous name": "AmbiguousRoiNameError", "box off the grid": "ValueError", "box of nothing": "ValueError", "budget": "ResourceLimitError", "centroid of nothing": "failure of the job", "contour too short": "failure of the job", "dose as segmentation": "NotSegmentationError", "field of a binary segment": "SegmentationTypeMismatchError",
    "frames differ": "FrameOfReferenceMismatchError", "grids differ": "GridMismatchError", "index off the grid": "IndexError", "mask of a fractional segment": "SegmentationTypeMismatchError", "no such segment": "SegmentNotFoundError", "no threshold": "MissingThresholdError", "not a dose": "NotDoseError", "offsets missing": "MalformedDoseGridError",
    "overlapping labels": "LabelmapOverlapError", "quantile of nothing": "failure of the job", "series of two sizes": "InconsistentSeriesError", "single plane": "IndeterminateVolumeError", "strict frames": "FrameOfReferenceMismatchError", "threshold too great": "ValueError", "tilted directions": "NonOrthogonalBasisError", "unset sparse frames": "ValueError",
    "volume by contours": "NotImplementedMethodError", "xor mixed": "XorHomogeneityError",
}


@register("refusals", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{e}')" for c, e in REFUSED.items()) + ") v(what, error)", prelude=False)
def refused(spark, d):
    return spark.createDataFrame(refusals(spark), "what string, error string")


@register("structure_notes", """SELECT * FROM (VALUES ('document', 'EMPTY_ROI', 1), ('document', 'FRAME_OF_REFERENCE_MISMATCH', 1), ('document', 'MISSING_RT_ROI_OBSERVATIONS', 1), ('contour', 'CONTOUR_PLANE_DISTANCE', 1),
('contour', 'NESTED_CLOSED_PLANAR_INTERPRETED', 1), ('contour', 'SOP_REFERENCE_PLANE_MISMATCH', 1), ('contour', 'SOP_REFERENCE_UNRESOLVED', 1), ('contour', 'UNSUPPORTED_CONTOUR_GEOMETRY', 1)) v(of_what, code, n)""", prelude=False)
def structure_notes(spark, d):
    """A structure set in which each thing that loading notes is there once."""
    box = lambda a, b, z: [(a, a, z), (b, a, z), (b, b, z), (a, b, z)]
    known, other = ["1.9.1"], ["1.9.2"]
    shapes = [
        dicom.Contour("CLOSED_PLANAR", box(0.0, 18.0, 0.0), known), dicom.Contour("CLOSED_PLANAR", box(5.0, 9.0, 0.0), known), dicom.Contour("POINT", [(1.0, 1.0, 0.0)], known),
        dicom.Contour("CLOSED_PLANAR", box(30.0, 36.0, 4.0), ["1.9.99"]), dicom.Contour("CLOSED_PLANAR", box(30.0, 36.0, 5.6), ["1.9.4"]), dicom.Contour("CLOSED_PLANAR", box(40.0, 44.0, 1.0), other),
    ]
    data = dicom.write_structures([dicom.Roi(0, "a", shapes, frame_uid="1.2.3"), dicom.Roi(0, "b", [], frame_uid="1.2.4")], observations=False)
    loaded = structures.load(spark, dicom.parse_structures(data), L, slices=[(f"1.9.{k + 1}", k) for k in range(len(L.planes))])
    notes = spark.createDataFrame([("document", n.code) for n in loaded.notes], "of_what string, code string")
    every = notes.union(loaded.diagnostics.select(F.lit("contour"), "code"))
    return every.groupBy("of_what", "code").agg(F.count("*").cast("int").alias("n"))
