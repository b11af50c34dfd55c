"""Reports on contours and on agreement between two sets of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.functions.columns import angle_between, cross, dot, length, normalize, scale, sub, vec

#: FNV-1a, 32 bits: fixed values.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def fnv1a(values: Column) -> Column:
    """FNV-1a of an array of bytes (integers 0 to 255), as a long."""
    return F.aggregate(values, F.lit(FNV_BASIS).cast("long"), lambda h, v: (h.bitwiseXOR(v.cast("long")) * FNV_PRIME).bitwiseAND(0xFFFFFFFF))


def slice_checksums(masks: DataFrame, rows: int, cols: int) -> DataFrame:
    """mask_id, k, checksum and nonzero of each occupied slice as bytes of 0 and 1."""
    per = masks.groupBy("mask_id", "k").agg(F.collect_set(F.col("r") * cols + F.col("c")).alias("on"))
    # a slice is rebuilt as a text of 0s and 1s from the gaps between its set pixels
    order = F.array_sort("on")
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))
    text = F.aggregate(order, start, lambda a, i: F.struct(F.concat(a["s"], F.repeat(F.lit("0"), i - a["at"]), F.lit("1")).alias("s"), (i + 1).alias("at")), lambda a: F.rpad(a["s"], rows * cols, "0"))
    flags = F.transform(F.split(text, ""), lambda x: x.cast("int"))
    return per.select("mask_id", "k", fnv1a(F.slice(flags, 1, rows * cols)).alias("checksum"), F.size("on").cast("long").alias("nonzero"))


def value_checksums(values: DataFrame, key: list[str], pixels: int, index: str = "i") -> DataFrame:
    """key, checksum, nonzero, sum and max of slices of byte values (``key``, an index below
    ``pixels`` and v; missing pixels are 0). Slices without a row have none here either."""
    per = values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(index).cast("int").alias("i"), F.col("v").cast("int").alias("v")))).alias("m"), F.count_if(F.col("v") != 0).alias("nonzero"), F.sum(F.col("v").cast("long")).alias("sum"), F.max(F.col("v").cast("long")).alias("max"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(pixels - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).bitwiseAND(255))
    return per.select(*key, fnv1a(dense).alias("checksum"), "nonzero", "sum", F.greatest("max", F.lit(0)).alias("max"))


def compare_slices(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row for each segment of ``ours``: segment, matched (``theirs`` has it), count_delta,
    checked and exact (slices that both have at the same z, and those of equal checksum and count),
    missing (occupied slices of ours without a counterpart) and first_mismatch_z.

    Both are slices (segment, z, checksum, nonzero). They meet on the segment and z in whole
    micrometres, halves up. Of slices of one side at the same place the last by checksum counts."""
    place = F.floor(F.col("z") * 1000 + 0.5).cast("long")
    side = lambda df, n: df.groupBy("segment", place.alias("zk")).agg(F.max_by(F.struct("z", "checksum", "nonzero"), "checksum").alias(n))
    total = lambda df, n: df.groupBy("segment").agg(F.sum("nonzero").alias(n))
    met = side(ours, "a").join(side(theirs, "b"), ["segment", "zk"], "left")
    same = (F.col("a.checksum") == F.col("b.checksum")) & (F.col("a.nonzero") == F.col("b.nonzero"))
    both = F.col("b").isNotNull()
    per = met.groupBy("segment").agg(F.count_if(both).alias("checked"), F.count_if(both & same).alias("exact"), F.count_if(~both & (F.col("a.nonzero") > 0)).alias("missing"), F.min(F.when(both & ~same, F.col("a.z"))).alias("first_mismatch_z"))
    counts = total(ours, "n_a").join(total(theirs, "n_b"), "segment", "left")
    out = per.join(counts, "segment")
    return out.select("segment", F.col("n_b").isNotNull().alias("matched"), (F.col("n_a") - F.col("n_b")).alias("count_delta"), "checked", "exact", "missing", "first_mismatch_z")


def revisits(owner, place, size, xyz, near_mm: float):
    """Two arrays of booleans by owner (numpy): whether a contour comes back to a point exactly, and
    within ``near_mm``, as ``keyholes`` says. The points of contour ``owner``, of ``size`` points, have
    their ``place`` in it and the rows ``xyz``.

    Points are sorted, not compared all with all. Of equal points, or those of one cell (whose diagonal
    is below ``near_mm``), a pair at a fitting distance along the contour is found within three
    neighbours, or there is none; and then a cell has four points at most, so that the cells around a
    point cost a bounded number of comparisons."""
    import numpy as np

    count = int(owner.max()) + 1 if len(owner) else 0
    exact, near = np.zeros(count, bool), np.zeros(count, bool)

    def pairs(a, b, equal):
        """Marks the owners of the pairs of rows that fit."""
        apart = np.abs(place[a] - place[b])
        fit = (owner[a] == owner[b]) & (apart >= 3) & (apart < size[a] - 1)
        a, b = a[fit], b[fit]
        d = xyz[a] - xyz[b]
        near[owner[a[np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) < near_mm]]] = True
        if equal:
            exact[owner[a[(d == 0).all(axis=1)]]] = True

    def neighbours(order, equal):
        for lag in (1, 2, 3):
            pairs(order[:-lag], order[lag:], equal)

    good = np.isfinite(xyz).all(axis=1)
    owner, place, size, xyz = owner[good], place[good], size[good], xyz[good] + 0.0
    neighbours(np.lexsort((place, xyz[:, 2], xyz[:, 1], xyz[:, 0], owner)), True)
    left = ~near[owner]
    owner, place, size, xyz = owner[left], place[left], size[left], xyz[left]
    # 0.52: the diagonal is 0.901 of near_mm, and two cells are more than it
    cells = np.clip(np.floor(xyz / (0.52 * near_mm)), -(2.0**62), 2.0**62).astype(np.int64).view(np.uint64)
    # a key that is linear in the cell: equal keys of different cells only cost a comparison
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    key = (cells * factors).sum(axis=1, dtype=np.uint64) + owner.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)
    neighbours(np.lexsort((place, key)), False)
    left = ~near[owner]
    owner, place, size, xyz, key = owner[left], place[left], size[left], xyz[left], key[left]
    order = np.argsort(key, kind="stable")
    owner, place, size, xyz, key = owner[order], place[order], size[order], xyz[order], key[order]
    flat = [len(key) == 0 or (xyz[:, i] == xyz[0, i]).all() for i in range(3)]
    steps = [range(1) if f else range(-2, 3) for f in flat]
    for step in [(i, j, k) for i in steps[0] for j in steps[1] for k in steps[2] if (i, j, k) > (0, 0, 0)]:
        at = key + (np.array(step, np.int64).view(np.uint64) * factors).sum(dtype=np.uint64)
        first, last = np.searchsorted(key, at, "left"), np.searchsorted(key, at, "right")
        n = last - first
        a = np.repeat(np.arange(len(key)), n)
        pairs(a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), False)
    return exact, near


def _revisited(contours: DataFrame, near_mm: float, columns: list[str]) -> DataFrame:
    """``columns`` of each contour with exact and near (see ``keyholes``). A contour is one row, so
    nothing is joined or shuffled."""
    if not near_mm > 0:
        raise ValueError("the distance has to be positive")
    kinds, names = dict(contours.dtypes), [*columns, "exact", "near"]

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(len(columns))
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = lists.flatten().flatten()  # a null point has null coordinates
            xyz = np.stack([p.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for p in parts], axis=1)
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            found = np.zeros((2, len(size)), bool)
            some = revisits(owner, place, size[owner], xyz, near_mm)
            found[:, : len(some[0])] = some
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(found[0]), pa.array(found[1])], names)

    points = F.transform("points", lambda p: F.struct(*(p[a].cast("double").alias(a) for a in "xyz")))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "exact boolean, near boolean"])
    return contours.select(*columns, points.alias("points")).mapInArrow(kernel, schema)


def keyholes(contours: DataFrame, near_mm: float = 0.05) -> DataFrame:
    """mask_id, contour_no, exact, near: whether a contour comes back to a point (exactly, or within
    ``near_mm``) three or more points later, other than by closing."""
    return _revisited(contours, near_mm, ["mask_id", "contour_no"])


def census(contours: DataFrame, near_mm: float = 0.05, least_points: int = 6) -> DataFrame:
    """mask_id, contours, points, xor_contours, and the closed planar contours of ``least_points``
    and more that come back to a point: exactly, or only nearly (exact_revisits, near_revisits)."""
    sized = contours.withColumn("_n", F.size("points"))
    rows = _revisited(sized, near_mm, ["mask_id", "geometric_type", "_n"])
    closed = (F.col("geometric_type") == "CLOSED_PLANAR") & (F.col("_n") >= least_points)
    return rows.groupBy("mask_id").agg(F.count("*").alias("contours"), F.sum("_n").alias("points"), F.count_if(F.col("geometric_type") == "CLOSEDPLANAR_XOR").alias("xor_contours"), F.count_if(closed & F.col("exact")).alias("exact_revisits"), F.count_if(closed & F.col("near") & ~F.col("exact")).alias("near_revisits"))


#: Absolute and relative tolerance of each kind of metric.
TOLERANCES = {"dose": (0.5, 0.02), "volume": (1.0, 0.02), "percent": (2.0, 0.0)}


def agreement(ours: DataFrame, theirs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Metrics of both sides joined on the trimmed, lower-cased ``name``: name, metric, ours,
    theirs, delta, within. ``kinds``: metric column to dose, volume or percent."""
    norm = lambda df: df.withColumn("name", F.lower(F.trim("name")))
    long = lambda df, v: norm(df).select("name", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(v)) for m in kinds))).alias("s")).select("name", "s.*")
    limits = F.create_map(*(x for m, k in kinds.items() for x in (F.lit(m), F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(TOLERANCES[k], ("abs", "rel"), strict=True))))))
    both = long(ours, "ours").join(long(theirs, "theirs"), ["name", "metric"]).withColumn("_t", limits[F.col("metric")])
    delta = F.col("ours") - F.col("theirs")
    return both.select("name", "metric", "ours", "theirs", delta.alias("delta"), (F.abs(delta) <= F.greatest(F.col("_t.abs"), F.col("_t.rel") * F.abs("theirs"))).alias("within"))


def flagged(report: DataFrame) -> DataFrame:
    """The rows of ``agreement`` outside their tolerance, the greatest relative difference first."""
    percent = F.when(F.col("theirs") != 0, F.col("delta") / F.when(F.col("theirs") != 0, F.col("theirs")) * 100)
    out = report.filter(~F.col("within")).withColumn("percent", percent)
    return out.orderBy(F.desc(F.abs(F.coalesce("percent", F.lit(0.0)))), "name", "metric")


def point_ratios(ours: DataFrame, original: DataFrame) -> DataFrame:
    """mask_id, ours, original, ratio: the points of both sides' contours."""
    total = lambda df, n: df.groupBy("mask_id").agg(F.sum(F.size("points")).alias(n))
    return total(ours, "ours").join(total(original, "original"), "mask_id").withColumn("ratio", F.col("ours") / F.col("original"))


def write_report(rows: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    rows.write.mode("overwrite").json(path)


def spreads(planes: DataFrame, key: str) -> DataFrame:
    """key, planes, min_gap, mean_gap, max_gap of the gaps between sorted projections."""
    gap = F.col("proj") - F.lag("proj").over(Window.partitionBy(key).orderBy("proj"))
    return planes.withColumn("gap", gap).groupBy(key).agg(F.count("*").alias("planes"), F.min("gap").alias("min_gap"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))


def series_noise(instances: DataFrame, key: str, order: str) -> DataFrame:
    """How much the instances of a series differ: key, instances, spacing_spread, row_angle and
    col_angle (greatest differences from the first instance by ``order``), off_axis (greatest distance
    from its normal), min_gap, mean_gap, max_gap, and digits: the fewest fractional digits of its
    decimal strings, of those that are not zero and have no exponent (0 if there are none).

    instances: key, order, spacing (array of 2), orientation (array of 6), position (array of 3) and
    decimals (array of strings). Series of one instance have no row."""
    first = instances.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct("spacing", "orientation", "position"), order).alias("f"), F.count("*").alias("instances")).filter("instances > 1")
    vector = lambda c, i: vec(*(F.get(c, F.lit(i + j)) for j in range(3)))
    row0, col0 = vector(F.col("f.orientation"), 0), vector(F.col("f.orientation"), 3)
    moved = sub(vector(F.col("position"), 0), vector(F.col("f.position"), 0))
    normal = normalize(cross(row0, col0))
    along = dot(moved, normal)
    aside = length(sub(moved, scale(normal, along)))
    plain = F.filter("decimals", lambda d: ~d.rlike("[eE]") & (F.abs(d.try_cast("double")) >= 1e-9))
    digits = F.array_min(F.transform(plain, lambda d: F.when(d.contains("."), F.length(F.substring_index(d, ".", -1))).otherwise(0)))
    apart = F.greatest(*(F.abs(F.get("spacing", F.lit(i)) - F.get("f.spacing", F.lit(i))) for i in range(2)))
    angles = [angle_between(a, vector(F.col("orientation"), 3 * i)) for i, a in enumerate((row0, col0))]
    rows = instances.join(first, F.col(key) == F.col("_key")).select(key, "instances", apart.alias("apart"), angles[0].alias("ra"), angles[1].alias("ca"), aside.alias("aside"), along.alias("along"), digits.alias("digits"))
    gap = F.col("along") - F.lag("along").over(Window.partitionBy(key).orderBy("along"))
    return rows.withColumn("gap", gap).groupBy(key).agg(
        F.max("instances").alias("instances"), F.max("apart").alias("spacing_spread"), F.max("ra").alias("row_angle"), F.max("ca").alias("col_angle"), F.max("aside").alias("off_axis"),
        F.min("gap").alias("min_gap"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.coalesce(F.min("digits"), F.lit(0)).alias("digits"),
    )
