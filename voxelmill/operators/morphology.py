"""Distance transforms, dilation, erosion and connected components of masks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.operators.grid import Grid
from voxelmill.operators.masks import ID, KEY, complement, every_voxel, inside, linear_index, listed

#: The distance where a mask has no voxel to be distant from.
NOWHERE = 1e10


def min_plus(squares, step: float, within: float = math.inf):
    """For each place of the last axis the least of squares[j] + (step * (i - j))^2. Shifts the
    whole array by one distance after another until no shift can improve anything, or only to
    values over ``within``."""
    import numpy as np

    out = squares.copy()
    for d in range(1, squares.shape[-1]):
        cost = (step * d) ** 2
        if cost > within or cost >= out.max():
            break
        np.minimum(out[..., d:], squares[..., :-d] + cost, out=out[..., d:])
        np.minimum(out[..., :-d], squares[..., d:] + cost, out=out[..., :-d])
    return out


def squares_along(seeds, step: float):
    """For each place of the last axis the squared distance to the nearest seed on its line, by one
    pass each way (infinite without any)."""
    import numpy as np

    n = seeds.shape[-1]
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(seeds, at, -np.inf), axis=-1)
    after = np.minimum.accumulate(np.where(seeds, at, np.inf)[..., ::-1], axis=-1)[..., ::-1]
    return (np.minimum(at - before, after - at) * step) ** 2


def squared_distances(masks: DataFrame, grid: Grid, within: float = math.inf) -> DataFrame:
    """mask_id, k, r, c, d2 for every voxel of the grid whose squared distance in mm to the mask is at
    most ``within``. Two passes: within each plane, then through the planes for each row of pixels;
    each task holds one plane, or one row of all planes. Planes are at their mean distance."""
    grid.require_budget()
    rows, cols, planes, (pr, pc) = grid.rows, grid.cols, len(grid.planes), grid.spacing

    def in_plane(t):
        """One row for each row of pixels of a plane that anything is near, its squared distances as
        an array."""
        import numpy as np
        import pyarrow as pa

        seed = np.zeros((rows, cols), bool)
        seed[t.column("r").to_numpy(), t.column("c").to_numpy()] = True
        d2 = min_plus(np.ascontiguousarray(squares_along(seed, pc).T), pr, within).T
        near = np.flatnonzero(d2.min(axis=1) <= within)
        line = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * cols), pa.array(np.ascontiguousarray(d2[near]).ravel()))
        return pa.table({"mask_id": pa.repeat(t.column("mask_id")[0], len(near)), "k": pa.repeat(t.column("k")[0], len(near)), "r": pa.array(near.astype(np.int32)), "line": line})

    def through(t):
        import numpy as np
        import pyarrow as pa

        lines = np.full((cols, planes), np.inf)
        lines[:, t.column("k").to_numpy()] = t.column("line").combine_chunks().flatten().to_numpy().reshape(-1, cols).T
        d2 = (lines if planes == 1 else min_plus(lines, grid.mean_spacing, within)).ravel()
        at = np.flatnonzero(d2 <= within)
        c, k = np.divmod(at.astype(np.int32), np.int32(planes))
        n = len(at)
        return pa.table({"mask_id": pa.repeat(t.column("mask_id")[0], n), "k": pa.array(k), "r": pa.repeat(t.column("r")[0], n), "c": pa.array(c), "d2": pa.array(d2[at])})

    flat = masks.select(*ID).groupBy("mask_id", "k").applyInArrow(in_plane, "mask_id string, k int, r int, line array<double>")
    return flat.groupBy("mask_id", "r").applyInArrow(through, "mask_id string, k int, r int, c int, d2 double")


def distance_transform(masks: DataFrame, grid: Grid, *, signed: bool = False, names: list[str] | DataFrame | None = None) -> DataFrame:
    """mask_id, k, r, c, v (float): the distance in mm to the mask; ``signed``: inside the mask minus
    the distance to its outside, or minus 1e10 if there is none. Named masks without voxels are 1e10
    away from everywhere."""
    out = squared_distances(masks, grid).select(*ID, F.sqrt("d2").alias("d"))
    if names is not None:
        without = listed(masks, names).join(listed(masks), "mask_id", "left_anti")
        out = out.union(every_voxel(without, grid).select(*ID, F.lit(NOWHERE)))
    if not signed:
        return out.select(*ID, F.col("d").cast("float").alias("v"))
    back = squared_distances(complement(masks, grid), grid).select(*ID, F.sqrt("d2").alias("b"))
    both = out.join(back, ID, "left").withColumn("b", F.coalesce("b", F.lit(NOWHERE)))
    return both.select(*ID, F.when(F.col("d") == 0, -F.col("b")).otherwise(F.col("d")).cast("float").alias("v"))


def _ball(grid: Grid, mm: float) -> list[tuple[int, int, int]]:
    """Index offsets (k, r, c) within ``mm``."""
    step = (grid.mean_spacing or math.inf, *grid.spacing)
    reach = [0 if math.isinf(s) else int(mm / s + 1e-9) for s in step]
    spans = [range(-n, n + 1) for n in reach]
    size = lambda d, s: 0.0 if d == 0 else (d * s) ** 2
    return [(k, r, c) for k in spans[0] for r in spans[1] for c in spans[2] if size(k, step[0]) + size(r, step[1]) + size(c, step[2]) <= mm * mm]


def _check(mm: float) -> None:
    if not (math.isfinite(mm) and mm >= 0):
        raise ValueError("the radius must be finite and not negative")


#: Up to so many offsets a ball is spread by a join-free explode; beyond, the distance decides.
BALL = 64


def dilate(masks: DataFrame, grid: Grid, mm: float) -> DataFrame:
    """Voxels within ``mm`` of the mask."""
    _check(mm)
    offsets = _ball(grid, mm)
    if len(offsets) > BALL:
        return squared_distances(masks, grid, mm * mm).select(*ID)
    ball = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, ("dk", "dr", "dc"), strict=True))) for o in offsets))
    moved = masks.select(*ID, F.explode(ball).alias("o")).select("mask_id", (F.col("k") + F.col("o.dk")).alias("k"), (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    return moved.filter(inside(grid)).distinct()


def erode(masks: DataFrame, grid: Grid, mm: float) -> DataFrame:
    """Voxels over ``mm`` from the grid's voxels outside the mask; what is off the grid is not outside."""
    _check(mm)
    return masks.select(*ID).join(dilate(complement(masks, grid), grid, mm), ID, "left_anti")


def half_stencil(connectivity: int) -> list[tuple[int, int, int]]:
    """Neighbour offsets (k, r, c), one of each opposite pair."""
    if connectivity not in (6, 26):
        raise ValueError("connectivity is 6 or 26")
    every = [(k, r, c) for k in (-1, 0, 1) for r in (-1, 0, 1) for c in (-1, 0, 1) if (k, r, c) > (0, 0, 0)]
    return every if connectivity == 26 else [o for o in every if sum(map(abs, o)) == 1]


def neighbour_pairs(masks: DataFrame, grid: Grid, connectivity: int = 26) -> DataFrame:
    """mask_id, u, v: linear indices of touching voxels, each pair once, by an equi-join."""
    offsets = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, ("dk", "dr", "dc"), strict=True))) for o in half_stencil(connectivity)))
    own = masks.select("mask_id", *KEY, linear_index(grid).alias("u"))
    steps = own.select("mask_id", "u", F.explode(offsets).alias("o"), *KEY).select("mask_id", "u", (F.col("k") + F.col("o.dk")).alias("k"), (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    return steps.join(own.withColumnRenamed("u", "v"), ID).select("mask_id", "u", "v")


def components(masks: DataFrame, grid: Grid, connectivity: int = 26) -> DataFrame:
    """mask_id, k, r, c, label, size. Labels go from 1 by falling size; of equal sizes the component
    with the least linear index comes first. A mask is labelled in one task (its voxels' indices,
    8 bytes each, within the voxel budget)."""
    grid.require_budget()
    stencil, rows, cols, planes = half_stencil(connectivity), grid.rows, grid.cols, len(grid.planes)

    def label(t):
        import numpy as np
        import pyarrow as pa

        k, r, c = (t.column(x).to_numpy().astype(np.int64) for x in KEY)
        order = np.argsort((k * rows + r) * cols + c)
        k, r, c = k[order], r[order], c[order]
        index = (k * rows + r) * cols + c
        ends = []
        for dk, dr, dc in stencil:
            good = (k + dk < planes) & (r + dr >= 0) & (r + dr < rows) & (c + dc >= 0) & (c + dc < cols)
            target = index + (dk * rows + dr) * cols + dc
            at = np.minimum(np.searchsorted(index, target), len(index) - 1)
            good &= index[at] == target
            ends.append(np.stack([np.flatnonzero(good), at[good]]))
        u, v = np.concatenate(ends, axis=1)
        root = np.arange(len(index))
        while True:
            # hook the greater root of each pair on the lesser, then shorten all paths
            a, b = root[u], root[v]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
        names, of, sizes = np.unique(root, return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int32)
        rank[np.lexsort((names, -sizes))] = np.arange(1, len(names) + 1)
        out = {"mask_id": pa.repeat(t.column("mask_id")[0], len(index))}
        return pa.table(out | {n: pa.array(x.astype(np.int32)) for n, x in (("k", k), ("r", r), ("c", c), ("label", rank[of]))} | {"size": pa.array(sizes[of].astype(np.int64))})

    return masks.select(*ID).groupBy("mask_id").applyInArrow(label, "mask_id string, k int, r int, c int, label int, size long")


def largest_component(masks: DataFrame, grid: Grid, connectivity: int = 26) -> DataFrame:
    return components(masks, grid, connectivity).filter("label = 1").select(*ID)


def component_ranks(rooted: DataFrame) -> DataFrame:
    """mask_id, root, label, size of voxels that know their component's least index (root)."""
    sizes = rooted.groupBy("mask_id", "root").agg(F.count("*").alias("size"))
    return sizes.withColumn("label", F.row_number().over(Window.partitionBy("mask_id").orderBy(F.desc("size"), "root")))
