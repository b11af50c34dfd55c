"""Queries on structure sets, segmentations and reports, registered beside the voxel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import columns as fn
from voxelmill.operators import convert, grid, masks, report, segments, structures
from voxelmill.operators.dose_grid import DoseQuery
from voxelmill.plans.catalog import H, L, RASTER, TRILINEAR, masked, register, rounded
from voxelmill.sources import dicom
from voxelmill.sources import tables as t


@register("roi_left_join", """WITH c AS (SELECT o_custkey AS k, max_by((o_orderkey % 50)::INT, o_orderkey) AS n FROM orders GROUP BY 1), o AS (SELECT c_custkey AS k, c_mktsegment AS typ FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey AS roi, coalesce(n, 0) AS n_contours, coalesce(typ, 'ORGAN') AS interpreted_type FROM customer LEFT JOIN c ON c.k = c_custkey LEFT JOIN o ON o.k = c_custkey""", prelude=False)
def roi_left_join(spark, d):
    customers = t.read(spark, d, "customer")
    rois = customers.select(F.col("c_custkey").alias("roi"))
    outlines = t.read(spark, d, "orders").select(F.col("o_custkey").alias("roi"), F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 50).cast("int").alias("n_contours"))
    seen = customers.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("roi"), F.lit(0).alias("i"), F.col("c_mktsegment").alias("interpreted_type"))
    return segments.join_rois(rois, outlines, seen, ["roi"])


@register("undeclared_frames", "SELECT o_orderkey AS frame, o_custkey AS segment FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", prelude=False)
def undeclared_frames(spark, d):
    frames = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("segment"))
    return segments.undeclared(frames, t.read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("segment")), ["segment"]).select("frame", "segment")


@register("frames_per_segment", "SELECT c_custkey AS segment, count(o_orderkey) AS frames FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", prelude=False)
def frames_per_segment(spark, d):
    return segments.frames_per_segment(t.read(spark, d, "orders").select(F.col("o_custkey").alias("segment")), t.read(spark, d, "customer").select(F.col("c_custkey").alias("segment")), ["segment"])


@register("labelmap_merge", "SELECT k, r, c, CASE WHEN count(*) = 1 THEN max(CASE mask_id WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END) ELSE 0 END AS label FROM ms GROUP BY k, r, c")
def labelmap_merge(spark, d):
    numbered = t.masks(spark, d).withColumn("mask_id", F.when(F.col("mask_id") == "A", "1").when(F.col("mask_id") == "B", "2").otherwise("3"))
    return segments.merge_labels(numbered, fail=False).withColumn("label", F.coalesce("label", F.lit(0)))


@register("fractional_quantise", "SELECT k, r, c, least(greatest(floor(v / 100000.0 * 200 + 0.5), 0), 200)::INT AS stored, round((least(greatest(floor(v / 100000.0 * 200 + 0.5), 0), 200) / 200)::FLOAT::DOUBLE, 6) AS fraction FROM vox")
def fractional_quantise(spark, d):
    stored = t.field(spark, d).withColumn("stored", fn.quantised(F.col("v") / 100000.0, 200))
    return rounded(stored.select("k", "r", "c", "stored", (F.col("stored") / 200).cast("float").cast("double").alias("fraction")), "fraction")


@register("binary_in_disguise", "SELECT l_returnflag AS field, (count(*) FILTER (q <> 0) > 0 AND count(*) FILTER (q <> 0 AND q >= 49) >= 0.98 * count(*) FILTER (q <> 0)) AS binary FROM (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_quantity > 25 THEN 50 ELSE 0 END ELSE l_quantity END AS q FROM lineitem) GROUP BY 1", prelude=False)
def binary_in_disguise(spark, d):
    cut = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_quantity") > 25, 50).otherwise(0)).otherwise(F.col("l_quantity"))
    return segments.looks_binary(t.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("field"), cut.alias("v")), "field", 50)


BITS = "pb AS (SELECT mask_id, k, (r * 50 + c) // 8 AS byte, sum(1 << ((r * 50 + c) % 8)) AS v FROM ms GROUP BY ALL)"


@register("bit_pack", f", {BITS}, l AS (SELECT mask_id, k, max(byte) AS last FROM pb GROUP BY ALL), e AS (SELECT mask_id, k, unnest(range(last + 1)) AS byte FROM l) SELECT mask_id, k, string_agg(printf('%02x', coalesce(v, 0)::INT), '' ORDER BY byte) AS hexed FROM e LEFT JOIN pb USING (mask_id, k, byte) GROUP BY ALL")
def bit_pack(spark, d):
    flat = t.masks(spark, d).withColumn("i", F.col("r") * L.cols + F.col("c"))
    return segments.pack_bits(flat, ["mask_id", "k"])


@register("bit_unpack", "SELECT mask_id, k, r * 50 + c AS i FROM ms")
def bit_unpack(spark, d):
    packed = bit_pack(spark, d).select("mask_id", "k", F.unhex("hexed").alias("pixels"))
    return segments.unpack_bits(packed, L.rows * L.cols)


@register("series_consistency", "WITH f AS (SELECT o_custkey AS series, o_orderkey AS instance, o_totalprice AS p, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders) SELECT series, instance FROM f WHERE abs(p - q) > 50000", prelude=False)
def series_consistency(spark, d):
    rows = t.read(spark, d, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("instance"), F.col("o_totalprice").alias("p"))
    return segments.inconsistent(rows, "series", "instance", {"p": 50000.0}).select("series", "instance")


@register("redact_uids", r"SELECT event_id, regexp_replace(event_type || ' of 1.2.840.' || user_id || '.7 at 1.5', '\b\d+(?:\.\d+){2,}\b', '[redacted-uid]', 'g') AS message FROM events", prelude=False)
def redact_uids(spark, d):
    text = F.concat(F.col("event_type"), F.lit(" of 1.2.840."), F.col("user_id").cast("string"), F.lit(".7 at 1.5"))
    return t.read(spark, d, "events").select("event_id", fn.redact(text).alias("message"))


@register("point_chunks", f"SELECT mask_id, contour_no, (i - 1)::INT AS i, x, y * 2 AS y, ({H})[k + 1]::DOUBLE AS z FROM cont")
def point_chunks(spark, d):
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"], p["z"])))
    out = t.contours(spark, d).select("mask_id", "contour_no", F.posexplode(fn.points(flat)).alias("i", "p"))
    return out.select("mask_id", "contour_no", "i", "p.x", "p.y", "p.z")


@register("slice_checksum", """, sl AS (SELECT DISTINCT mask_id, k FROM ms), px AS (SELECT sl.mask_id, sl.k, i, (m.k IS NOT NULL)::BIGINT AS v FROM sl CROSS JOIN range(550) q(i) LEFT JOIN ms m ON m.mask_id = sl.mask_id AND m.k = sl.k AND m.r * 50 + m.c = i),
h AS (SELECT mask_id, k, list_prepend(2166136261::BIGINT, list(v ORDER BY i)) AS vs, sum(v)::BIGINT AS nonzero FROM px GROUP BY ALL)
SELECT mask_id, k, list_reduce(vs, lambda h, v: (xor(h, v) * 16777619) & 4294967295) AS checksum, nonzero FROM h""")
def slice_checksum(spark, d):
    return report.slice_checksums(t.masks(spark, d), L.rows, L.cols)


@register("keyhole_census", """, ct AS (SELECT contour_no, count(*) AS n FROM cont GROUP BY 1),
hit AS (SELECT DISTINCT p.contour_no FROM cont p JOIN cont q ON p.contour_no = q.contour_no AND q.i >= p.i + 3 AND p.x = q.x AND p.y = q.y JOIN ct ON ct.contour_no = p.contour_no WHERE q.i - p.i < n - 1)
SELECT DISTINCT mask_id, c.contour_no, h.contour_no IS NOT NULL AS exact, h.contour_no IS NOT NULL AS near FROM cont c LEFT JOIN hit h ON h.contour_no = c.contour_no""")
def keyhole_census(spark, d):
    return report.keyholes(t.contours(spark, d))


@register("agreement_report", """, s AS (SELECT mask_id, max(v) AS mx, sum(vol) AS vo FROM ms GROUP BY 1), o AS (SELECT lower(mask_id) AS name, unnest(['mx', 'vo']) AS metric, unnest([mx, vo]) AS ours, unnest([mx * 1.01, vo * 1.05]) AS theirs FROM s)
SELECT name, metric, round(ours - theirs, 4) AS delta, abs(ours - theirs) <= greatest(CASE metric WHEN 'mx' THEN 0.5 ELSE 1.0 END, 0.02 * abs(theirs)) AS within FROM o""")
def agreement_report(spark, d):
    ours = masked(spark, d).groupBy("mask_id").agg(F.max("v").alias("mx"), F.sum("vol").alias("vo")).withColumnRenamed("mask_id", "name")
    theirs = ours.select(F.concat(F.lit(" "), F.lower("name")).alias("name"), (F.col("mx") * 1.01).alias("mx"), (F.col("vo") * 1.05).alias("vo"))
    return rounded(report.agreement(ours, theirs, {"mx": "dose", "vo": "volume"}).select("name", "metric", "delta", "within"), "delta", digits=4)


@register("plane_spreads", "WITH s AS (SELECT l_orderkey AS grid_id, (round(l_quantity * 10)::BIGINT + l_suppkey % 3) / 1000.0::DOUBLE AS proj FROM lineitem GROUP BY ALL), p AS (SELECT grid_id, proj - lag(proj) OVER (PARTITION BY grid_id ORDER BY proj) AS gap FROM s) SELECT grid_id, count(*) AS planes, round(min(gap), 6) AS min_gap, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap FROM p GROUP BY 1", prelude=False)
def plane_spreads(spark, d):
    return rounded(report.spreads(t.plane_stacks(spark, d), "grid_id"), "min_gap", "mean_gap", "max_gap")


# --- whole documents: no SQL reads or writes these files, so the oracle states what must come back


@register("segmentation_roundtrip", "SELECT mask_id, k, r, c FROM ms")
def segmentation_roundtrip(spark, d):
    """A, B and C written as one binary segmentation and read back by the file kernel."""
    names = ("A", "B", "C")
    every = t.masks(spark, d)
    data = dicom.write_segmentation("BINARY", L, [(dicom.Segment(i + 1, n), convert.dense(every.filter(F.col("mask_id") == n), L)) for i, n in enumerate(names)])
    files = spark.createDataFrame([("seg", bytearray(data))], "doc string, content binary")
    label = F.array(*map(F.lit, names))[F.substring_index("mask_id", "#", -1).cast("int") - 1]
    return dicom.read_masks(files).select(label.alias("mask_id"), "k", "r", "c")


@register("dose_roundtrip", "SELECT k, r, c, round(((v)::BIGINT * 0.5)::FLOAT::DOUBLE, 4) AS v FROM (SELECT k, r, c, floor(v / 100) AS v FROM vox)")
def dose_roundtrip(spark, d):
    """The field written as a dose of stored hundreds at half scale, and read back."""
    import numpy as np

    rows = t.field(spark, d).toArrow()
    stored = np.zeros((len(L.planes), L.rows, L.cols), np.int64)
    at = tuple(rows.column(x).to_numpy() for x in masks.KEY)
    stored[at] = np.floor(rows.column("v").to_numpy() / 100).astype(np.int64)
    files = spark.createDataFrame([("dose", bytearray(dicom.write_dose(L, stored, scaling=0.5)))], "doc string, content binary")
    present = t.field(spark, d).select("k", "r", "c")
    return rounded(dicom.read_doses(files).join(present, masks.KEY, "left_semi").select("k", "r", "c", F.col("v").cast("double").alias("v")), "v", digits=4)


@register("structure_roundtrip", "SELECT mask_id AS name, count(DISTINCT contour_no) AS contours, count(*) AS points, 'ORGAN' AS interpreted_type FROM cont GROUP BY 1")
def structure_roundtrip(spark, d):
    """The event contours written as a structure set with its sequences shuffled, and read back."""
    files = t.structure_files(t.contours(spark, d), shuffle=True)
    outlines = dicom.read_contours(files).groupBy("mask_id").agg(F.count("*").alias("contours"), F.sum(F.size("points")).alias("points"))
    return dicom.read_rois(files).join(outlines, "mask_id", "left").select("name", F.coalesce("contours", F.lit(0)).alias("contours"), F.coalesce("points", F.lit(0)).alias("points"), "interpreted_type")


@register("segmentation_to_structure", "SELECT 'vectorize' AS step, count(*) AS voxels_before, count(*) AS voxels_after, 0::BIGINT AS disagreement, 1.0::DOUBLE AS dice FROM cc")
def segmentation_to_structure(spark, d):
    data = dicom.write_segmentation("BINARY", L, [(dicom.Segment(1, "C"), convert.dense(t.mask(spark, d, "C"), L))])
    _, record = convert.segmentation_to_structure(spark, dicom.parse_segmentation(data), 1)
    rows = [(s["kind"], s["voxels_before"], s["voxels_after"], s["disagreement"], s["dice"]) for s in record.lossy_steps]
    return spark.createDataFrame(rows, "step string, voxels_before long, voxels_after long, disagreement long, dice double")


@register("structure_to_segmentation", "SELECT k, r, c FROM cc")
def structure_to_segmentation(spark, d):
    """C as contours in a structure set, filled into a segmentation, and read back."""
    seg = dicom.write_segmentation("BINARY", L, [(dicom.Segment(1, "C"), convert.dense(t.mask(spark, d, "C"), L))])
    outlines, _ = convert.segmentation_to_structure(spark, dicom.parse_segmentation(seg), 1)
    data, _ = convert.structure_to_segmentation(spark, dicom.parse_structures(outlines), "C", L)
    files = spark.createDataFrame([("seg", bytearray(data))], "doc string, content binary")
    return dicom.read_masks(files).select("k", "r", "c")


@register("frame_ordering", "WITH f AS (SELECT o_custkey AS doc, o_orderkey AS frame, o_totalprice AS offs FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY offs, frame) AS a, row_number() OVER (PARTITION BY doc ORDER BY frame) AS b FROM f) SELECT doc, frame, (a - 1)::INT AS place, bool_or(a <> b) OVER (PARTITION BY doc) AS reordered FROM p", prelude=False)
def frame_ordering(spark, d):
    rows = t.read(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("offset"))
    return grid.ordered_frames(rows, "doc").select("doc", "frame", "place", "reordered")


@register("point_ratio", """, side AS (SELECT m.*, s, ([-1, 0, 1, 0])[s + 1] AS dr, ([0, 1, 0, -1])[s + 1] AS dc FROM ms m CROSS JOIN range(4) q(s)),
o AS (SELECT mask_id, count(*) AS ours FROM side WHERE NOT EXISTS (SELECT 1 FROM ms x WHERE x.mask_id = side.mask_id AND x.k = side.k AND x.r = side.r + dr AND x.c = side.c + dc) GROUP BY 1)
SELECT mask_id, ours, 2 * ours AS original, 0.5::DOUBLE AS ratio FROM o""")
def point_ratio(spark, d):
    from voxelmill.operators import contours

    ours = contours.vectorize(t.masks(spark, d), L)
    return report.point_ratios(ours, ours.union(ours))


@register("dose_on_another_grid", f", pts AS (SELECT (k * 8 + r) * 30 + c AS pid, x, y, z FROM tp) {TRILINEAR}, val2 AS (SELECT coalesce(val, 0.0)::FLOAT::DOUBLE AS v FROM tp LEFT JOIN tri ON pid = (k * 8 + r) * 30 + c) SELECT round(min(v), 2) AS min_value, round(max(v), 2) AS max_value, count(*) AS voxels, true AS resampled FROM val2")
def dose_on_another_grid(spark, d):
    every = t.TARGET.voxel_table(spark).select(F.lit("all").alias("mask_id"), "k", "r", "c")
    out = DoseQuery(t.field(spark, d), L).statistics(every, t.TARGET)
    return rounded(out.select("min_value", "max_value", "voxels", F.col("method.resampled").alias("resampled")), "min_value", "max_value", digits=2)


@register("structure_set_masks", RASTER + " SELECT mask_id, k, r, c FROM filled")
def structure_set_masks(spark, d):
    """The event contours as a structure set document, loaded whole."""
    files = t.structure_files(t.contours(spark, d).withColumn("sop_refs", F.array().cast("array<string>")))
    rois = dicom.read_rois(files)
    loaded = structures.load_tables(t.read_back(files), rois, L)
    return loaded.masks.join(F.broadcast(rois.select("mask_id", "name")), "mask_id").select(F.col("name").alias("mask_id"), "k", "r", "c")
