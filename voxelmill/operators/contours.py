"""Contours (mask_id, contour_no, geometric_type, points, sop_refs) to masks and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.operators.grid import Grid
from voxelmill.operators.masks import ID

#: The least points of each geometric type, and the types that enclose an area.
LEAST_POINTS = {"POINT": 1, "OPEN_PLANAR": 2, "OPEN_NONPLANAR": 2, "CLOSED_PLANAR": 3, "CLOSEDPLANAR_XOR": 3}
FILLABLE = ("CLOSED_PLANAR", "CLOSEDPLANAR_XOR")
EMPTY_MESSAGE = "contour has too few points or a coordinate that is not finite"


def _xyz(p: Column) -> tuple[Column, Column, Column]:
    return p["x"], p["y"], p["z"]


def fillable() -> Column:
    return F.col("geometric_type").isin(*FILLABLE)


def checked(contours: DataFrame) -> DataFrame:
    """Fails on contours with too few points for their type or coordinates that are not finite;
    types without a rule may have any number."""
    least = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LEAST_POINTS.items() for x in kv)), F.col("geometric_type")), F.lit(0))
    finite = F.forall("points", lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")) & (F.abs(p["z"]) < float("inf")))
    good = (F.size("points") >= least) & finite
    return contours.withColumn("points", F.when(good, F.col("points")).otherwise(F.raise_error(F.lit(EMPTY_MESSAGE)).cast(dict(contours.dtypes)["points"])))


def homogeneous(contours: DataFrame) -> DataFrame:
    """mask_id, mixed: whether XOR contours are mixed with other types."""
    xor = F.count_if(F.col("geometric_type") == "CLOSEDPLANAR_XOR")
    return contours.groupBy("mask_id").agg(((xor > 0) & (xor < F.count("*"))).alias("mixed"))


def associate(contours: DataFrame, grid: Grid, slices: DataFrame | None = None) -> DataFrame:
    """Contours with k: the plane of the first reference (in order) among ``slices`` (sop_uid,
    k), else the plane nearest to the first point; ``via_sop``, ``unresolved`` (there are
    references, none is known), ``k_geo``, ``distance_mm`` and ``tolerance_mm`` (half the
    thickness; null on a single plane)."""
    first = _xyz(F.get("points", F.lit(0)))
    s = grid.projection(first)
    out = contours.withColumn("k_geo", grid.nearest(s))
    if slices is None:
        out = out.withColumns({"k_sop": F.lit(None).cast("int"), "unresolved": F.lit(False)})
    else:
        # a UID that occurs twice means its last plane
        known = slices.groupBy("sop_uid").agg(F.max("k").alias("_k"))
        refs = contours.select("mask_id", "contour_no", F.posexplode("sop_refs").alias("pos", "sop_uid")).join(known, "sop_uid", "left")
        hits = refs.groupBy("mask_id", "contour_no").agg(F.min_by("_k", F.when(F.col("_k").isNotNull(), F.col("pos"))).alias("k_sop"))
        out = out.join(hits, ["mask_id", "contour_no"], "left").withColumn("unresolved", (F.coalesce(F.size("sop_refs"), F.lit(0)) > 0) & F.col("k_sop").isNull())
    at = F.array(*map(F.lit, grid.projections))
    half = grid.thickness_of(F.col("k")) / 2 if len(grid.planes) > 1 else F.lit(None).cast("double")
    out = out.withColumns({"via_sop": F.col("k_sop").isNotNull(), "k": F.coalesce("k_sop", "k_geo")})
    return out.withColumns({"distance_mm": F.abs(at[F.col("k")] - s), "tolerance_mm": half}).drop("k_sop")


def association_summary(associated: DataFrame) -> DataFrame:
    """mask_id, contours, by_sop, by_geometry, unresolved, all_by_sop."""
    return associated.groupBy("mask_id").agg(F.count("*").alias("contours"), F.count_if("via_sop").alias("by_sop"), F.count_if(~F.col("via_sop")).alias("by_geometry"), F.count_if("unresolved").alias("unresolved"), F.bool_and("via_sop").alias("all_by_sop"))


def edges(placed: DataFrame, grid: Grid) -> DataFrame:
    """mask_id, contour_no, k, x0, y0, x1, y1: the closed outline of each contour in pixel space."""
    n = F.size("points")

    def pixel(p):
        x, y = grid.pixel(_xyz(p), F.col("k"))
        return F.struct(x.alias("x"), y.alias("y"))

    flat = placed.select("mask_id", "contour_no", "k", F.transform("points", pixel).alias("points"))
    ring = F.transform("points", lambda p, i: F.struct(p.alias("a"), F.col("points")[(i + 1) % n].alias("b")))
    out = flat.select("mask_id", "contour_no", "k", F.explode(ring).alias("e"))
    return out.select("mask_id", "contour_no", "k", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))


def crossings(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Adds r and x for each integer row that an edge crosses (half-open: its lower end counts).
    Each edge makes its own rows, so finding them takes no join."""
    first = F.greatest(F.ceil(F.least("y0", "y1")), F.lit(low))
    last = F.least(F.ceil(F.greatest("y0", "y1")) - 1, F.lit(high))
    out = rows.filter(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    return out.withColumns({"r": F.col("r").cast("int"), "x": F.col("x0") + (F.col("r") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))})


def rasterize(placed: DataFrame, grid: Grid) -> DataFrame:
    """Masks of fillable contours with a plane k: a voxel is inside if an odd number of crossings
    of all contours of its plane lies to its right. Only rows that edges touch are made."""
    cross = crossings(edges(placed.filter(fillable()), grid), 0, grid.rows - 1)
    per = cross.groupBy("mask_id", "k", "r").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda i: F.struct(F.col("xs")[i - 1].alias("a"), F.col("xs")[i].alias("b")))
    runs = per.filter(F.size("xs") > 1).select("mask_id", "k", "r", F.explode(pairs).alias("p"))
    first, last = F.greatest(F.ceil("p.a"), F.lit(0)), F.least(F.ceil("p.b") - 1, F.lit(grid.cols - 1))
    return runs.filter(first <= last).select("mask_id", "k", "r", F.explode(F.sequence(first, last).cast("array<int>")).alias("c"))


def nesting(placed: DataFrame, grid: Grid) -> DataFrame:
    """mask_id, k, contour_no, inside: whether the first point of a contour lies in another one of
    its mask and plane. Points meet only edges that touch their row of pixels (what is off the grid
    on one side is one row)."""
    shapes = placed.filter(fillable())
    x, y = grid.pixel(_xyz(F.get("points", F.lit(0))), F.col("k"))
    firsts = shapes.select("mask_id", "k", "contour_no", x.alias("px"), y.alias("py"))
    row = lambda y: F.least(F.greatest(F.floor(y), F.lit(-1)), F.lit(grid.rows)).cast("int")
    firsts = firsts.withColumn("row", row(F.col("py")))
    other = edges(shapes, grid).withColumnRenamed("contour_no", "other_no").filter("y0 <> y1").withColumn("row", F.explode(F.sequence(row(F.least("y0", "y1")), row(F.greatest("y0", "y1")))))
    meets = (F.least("y0", "y1") <= F.col("py")) & (F.col("py") < F.greatest("y0", "y1"))
    right = F.col("px") < F.col("x0") + (F.col("py") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    met = firsts.join(other, ["mask_id", "k", "row"]).filter((F.col("other_no") != F.col("contour_no")) & meets)
    parity = met.groupBy("mask_id", "k", "contour_no", "other_no").agg((F.count_if(right) % 2 == 1).alias("inside"))
    flags = parity.groupBy("mask_id", "k", "contour_no").agg(F.bool_or("inside").alias("inside"))
    return shapes.select("mask_id", "k", "contour_no").join(flags, ["mask_id", "k", "contour_no"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def hole_interpretation(placed: DataFrame, grid: Grid) -> DataFrame:
    """mask_id, interpretation: xor, nested-even-odd or none."""
    xor = placed.groupBy("mask_id").agg(F.bool_or(F.col("geometric_type") == "CLOSEDPLANAR_XOR").alias("xor"))
    nested = nesting(placed, grid).groupBy("mask_id").agg(F.bool_or("inside").alias("nested"))
    kind = F.when(F.col("xor"), "xor").when(F.coalesce("nested", F.lit(False)), "nested-even-odd").otherwise("none")
    return xor.join(nested, "mask_id", "left").select("mask_id", kind.alias("interpretation"))


#: Sides of a cell in the order they are traced: neighbour (row, column), then start and end corner.
SIDES = ((-1, 0, -0.5, -0.5, 0.5, -0.5), (0, 1, 0.5, -0.5, 0.5, 0.5), (1, 0, 0.5, 0.5, -0.5, 0.5), (0, -1, -0.5, 0.5, -0.5, -0.5))


def boundary_edges(masks: DataFrame) -> DataFrame:
    """mask_id, k, r, c, side, x0, y0, x1, y1: cell sides whose neighbour is not in the mask."""
    sides = F.array(*(F.struct(F.lit(i).alias("side"), *(F.lit(v).alias(n) for v, n in zip(s, ("dr", "dc", "ax", "ay", "bx", "by"), strict=True))) for i, s in enumerate(SIDES)))
    every = masks.select(*ID, F.explode(sides).alias("s")).select(*ID, "s.*").withColumns({"nr": F.col("r") + F.col("dr"), "nc": F.col("c") + F.col("dc")})
    filled = masks.select("mask_id", "k", F.col("r").alias("nr"), F.col("c").alias("nc"))
    out = every.join(filled, ["mask_id", "k", "nr", "nc"], "left_anti")
    return out.select(*ID, "side", (F.col("c") + F.col("ax")).alias("x0"), (F.col("r") + F.col("ay")).alias("y0"), (F.col("c") + F.col("bx")).alias("x1"), (F.col("r") + F.col("by")).alias("y1"))


def trace(starts: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Closed loops over unit edges given in tracing order. At a corner with a choice the walk goes
    straight on, else turns clockwise, back, or counter-clockwise (y points down)."""
    leaving: dict[tuple[float, float], list[int]] = {}
    for i, e in enumerate(starts):
        leaving.setdefault(e[:2], []).append(i)
    used = [False] * len(starts)
    loops = []
    for i, first in enumerate(starts):
        if used[i]:
            continue
        loop, at = [first[:2]], i
        while True:
            used[at] = True
            x0, y0, x1, y1 = starts[at]
            if (x1, y1) == first[:2]:
                break
            loop.append((x1, y1))
            dx, dy = x1 - x0, y1 - y0
            turns = {(dx, dy): 0, (-dy, dx): 1, (-dx, -dy): 2}
            at = min((j for j in leaving[x1, y1] if not used[j]), key=lambda j: turns.get((starts[j][2] - x1, starts[j][3] - y1), 3))
        if len(loop) > 2:
            loops.append(loop)
    return loops


def vectorize(masks: DataFrame, grid: Grid) -> DataFrame:
    """Contours of masks: CLOSED_PLANAR loops on cell borders with a vertex at each cell corner.
    The sides come from an anti-join; only the walk along them is a kernel, a plane at a time."""
    schema = "mask_id string, k int, loop int, xs array<double>, ys array<double>"

    def walk(table):
        import pyarrow as pa

        t = table.sort_by([("r", "ascending"), ("c", "ascending"), ("side", "ascending")]).to_pydict()
        loops = trace(list(zip(t["x0"], t["y0"], t["x1"], t["y1"], strict=True)))
        n = len(loops)
        return pa.table({"mask_id": pa.array(t["mask_id"][:1] * n, pa.string()), "k": pa.array(t["k"][:1] * n, pa.int32()), "loop": pa.array(range(n), pa.int32()), "xs": pa.array([[p[0] for p in x] for x in loops], pa.list_(pa.float64())), "ys": pa.array([[p[1] for p in x] for x in loops], pa.list_(pa.float64()))})

    sides = boundary_edges(masks).withColumns({n: F.col(n).cast("double") for n in ("x0", "y0", "x1", "y1")})
    loops = sides.groupBy("mask_id", "k").applyInArrow(walk, schema)

    def point(p):
        x, y, z = grid.patient(F.col("k"), p["ys"], p["xs"])
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    number = F.row_number().over(Window.partitionBy("mask_id").orderBy("k", "loop")).cast("int")
    return loops.select("mask_id", number.alias("contour_no"), F.lit("CLOSED_PLANAR").alias("geometric_type"), F.transform(F.arrays_zip("xs", "ys"), point).alias("points"), F.array().cast("array<string>").alias("sop_refs"), "k")
