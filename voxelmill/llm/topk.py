"""Exact top-k search by inner product as a Voronoi join.

Components become integers. Data vectors are grouped by the nearest of some pivots, queries by
the nearest of others. With g the pivot of a query group, r its radius and m its greatest norm,
every query q of it and every vector x of the data group of pivot p satisfy

    |q.x - g.p| <= r |p| + m |x - p|.

So the summaries of the data groups (their radius and the distances of their vectors nearest to
the pivot) give each query group a score that its k-th best reaches at least, and only vectors
whose upper bound reaches it are sent to the group. There the scores are computed exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm.vectors import bounded_sample, matrix, one_query_each, ranked, shard_of, usable

#: Doubles from here on hold integers only, so their floor is themselves.
ALL_WHOLE = float(1 << 52)


def integers(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and x: floor(scale * component) as doubles that hold integers, however great."""
    whole = lambda v: F.when(F.abs(v) < ALL_WHOLE, F.floor(F.when(F.abs(v) < ALL_WHOLE, v)).cast("double")).otherwise(v)
    return usable(embeddings, zero=True).select("vec_id", F.transform("x", lambda v: whole(v * scale)).alias("x"))


def pivots_of(x, n: int, rounds: int = 5):
    """At most ``n`` pivots: some vectors of the sample, moved to the means of their cells."""
    import numpy as np

    p = np.unique(x, axis=0)
    p = p[np.random.default_rng(11).permutation(len(p))[:n]].astype(np.float64)
    for _ in range(rounds if len(p) > 1 else 0):
        cell, _ = nearest_pivot(x, p)
        for j in np.unique(cell):
            p[j] = x[cell == j].mean(axis=0)
    return p


def nearest_pivot(x, pivots):
    """The cell of each vector and its distance to the pivot, rounded up a little."""
    import numpy as np

    far = (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    cell = np.argmin(far, axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)) * (1 + 1e-9)


def with_cells(rows: DataFrame, pivots) -> DataFrame:
    def kernel(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                cell, far = nearest_pivot(matrix(pa.Table.from_batches([b])), pivots)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype("int32")), pa.array(far)], ["vec_id", "x", "cell", "far"])

    return rows.mapInArrow(kernel, "vec_id long, x array<double>, cell int, far double")


def inner_products(q, x):
    """Exact integer scores, one row for each row of ``q``. A row whose greatest component is below
    ``sqrt(2^53 / d)`` needs doubles only, one below ``sqrt(2^62 / d)`` longs; the rows beyond, if
    there are any, are computed in Python's integers, and the scores are then Python's integers."""
    import numpy as np

    of = lambda m: np.abs(m).max(axis=1, initial=0.0)
    most_q, most_x, d = of(q), of(x), q.shape[1]
    easy, wide = (2**53 / d) ** 0.5, (2**62 / d) ** 0.5
    if max(most_q.max(initial=0.0), most_x.max(initial=0.0)) < easy:
        return (q @ x.T).astype(np.int64)
    great_q, great_x = np.flatnonzero(most_q >= wide), np.flatnonzero(most_x >= wide)
    longs = lambda m, great: np.where(np.isin(np.arange(len(m)), great)[:, None], 0.0, m).astype(np.int64)
    out = longs(q, great_q) @ longs(x, great_x).T
    if len(great_q) or len(great_x):
        out = out.astype(object)
        exact = lambda m: [[int(v) for v in row] for row in m.tolist()]
        dot = lambda a, b: sum(v * w for v, w in zip(a, b, strict=True))
        for i, a in zip(great_q.tolist(), exact(q[great_q]), strict=True):
            out[i] = [dot(a, b) for b in exact(x)]
        for j, b in zip(great_x.tolist(), exact(x[great_x]), strict=True):
            out[:, j] = [dot(a, b) for a in exact(q)]
    return out


def best_of(scores, names, k: int):
    """Places of the ``k`` best scores, ties to the smaller name."""
    import numpy as np

    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], names[i]))[:k], dtype=np.int64)
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((names[at], -scores[at]))[:k]]


def top_k(embeddings: DataFrame, queries: DataFrame, *, k: int = 20, scale: int = 64, cells: int = 64, sample_rows: int = 8192, query_rows: int = 8192, shard_rows: int = 32768, least_shards: int = 12) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (long) of the ``k`` greatest inner products of
    each query with all vectors but those of its own vec_id, ties to the smaller vec_id.

    Components become ``floor(scale * component)``. Vectors that are null, of an unusual length,
    or that hold null or non-finite components take no part, nor do rows without vec_id. Finite
    ones take part, however great; the job fails if a score among the ``k`` greatest of some shard
    of the data doesn't fit a long. Zero vectors take part. Rows that repeat are candidates each;
    of queries that share a vec_id the one with the least vector counts. Without usable vectors
    there is no row. Other columns are not read.

    A vector is copied once for each block of ``4 * query_rows`` queries whose bound it can reach, a
    query once for each shard of ``shard_rows`` vectors.
    """
    import numpy as np

    rows = integers(embeddings, scale)
    _, sample = bounded_sample(rows, sample_rows)
    schema = "query_id long, vec_id long, score long"
    empty = rows.sparkSession.createDataFrame([], schema)
    if not len(sample):
        return ranked(empty, k, F.desc("score"))
    asked = one_query_each(integers(queries, scale).filter(F.size("x") == sample.shape[1]))
    n, n_asked = rows.count(), asked.count()
    if not n_asked:
        return ranked(empty, k, F.desc("score"))
    pivots = pivots_of(sample, cells)
    # query groups: at most ``cells`` of them by pivots; a group of very many queries is dealt into blocks
    centres = pivots_of(bounded_sample(asked, sample_rows)[1], min(cells, -(-n_asked // query_rows)))
    data, asks = with_cells(rows, pivots), with_cells(asked, centres)
    # summaries: for each cell its radius and the ids nearest to the pivot. A query may be none but
    # one of k + 1 different ids, so k of them are its candidates
    need = k + 1
    order = Window.partitionBy("cell").orderBy("far", "vec_id")
    salted = Window.partitionBy("cell", "salt").orderBy("far", "vec_id")
    few = data.groupBy("cell", "vec_id").agg(F.min("far").alias("far")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32))).withColumn("i", F.row_number().over(salted)).filter(F.col("i") <= need)
    least = few.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= need).select("cell", "vec_id", "far").toArrow().to_pydict()
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    groups = asks.groupBy("cell").agg(F.max("far").alias("r"), F.max(norm).alias("m"), F.count("*").alias("n")).toArrow().to_pydict()
    pivot_norm = np.linalg.norm(pivots, axis=1)
    slack = 1 + 1e-9
    centre_norm = np.linalg.norm(centres, axis=1)
    bound, reach = {}, {}
    ids, of_id = np.unique(np.array(least["vec_id"], dtype=np.int64), return_inverse=True)
    for g, r, m, _ in zip(*(groups[c] for c in ("cell", "r", "m", "n")), strict=True):
        middle, rounding = pivots @ centres[g], 1e-9 * pivot_norm * centre_norm[g]
        cell, far = np.array(least["cell"], dtype=np.int64), np.array(least["far"])
        low = np.nan_to_num(middle[cell] - rounding[cell] - (r * pivot_norm[cell] + m * far) * slack, nan=-np.inf, posinf=-np.inf)
        # of an id that is in several cells, its best bound
        best = np.full(len(ids), -np.inf)
        np.maximum.at(best, of_id, low)
        kth = np.partition(best, len(best) - need)[len(best) - need] if len(best) >= need else -np.inf
        bound[g] = kth - 1e-9 * abs(kth) if np.isfinite(kth) else -np.inf
        reach[g] = (middle + rounding + r * pivot_norm * slack, m * slack)
    blocks = {g: max(1, -(-c // (4 * query_rows))) for g, c in zip(groups["cell"], groups["n"], strict=True)}
    shards = max(-(-n // shard_rows), min(least_shards, -(-n // 1024)))

    def send(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            cell, far = b.column(2).to_numpy(), b.column(3).to_numpy()
            for g, (upper, m) in reach.items():
                keep = np.flatnonzero(~(upper[cell] + m * far < bound[g]))  # what can't be compared stays
                for block in range(blocks[g] if len(keep) else 0):
                    part = b.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(keep), g, np.int32)), pa.array(np.full(len(keep), block, np.int32))], ["vec_id", "x", "g", "block"])

    sent = data.mapInArrow(send, "vec_id long, x array<double>, g int, block int").withColumn("shard", shard_of(shards))
    of = F.create_map(*(F.lit(v) for item in blocks.items() for v in item))
    asks = asks.select("vec_id", "x", F.col("cell").alias("g"), F.pmod(F.xxhash64("vec_id"), of[F.col("cell")]).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def solve(key, asks, data):
        import numpy as np
        import pyarrow as pa

        out: list = [[], [], []]
        if asks.num_rows and data.num_rows:
            q, x = matrix(asks), matrix(data)
            names, known = asks.column("vec_id").to_numpy(), data.column("vec_id").to_numpy()
            for i in range(0, len(q), 256):
                for name, scores in zip(names[i : i + 256], inner_products(q[i : i + 256], x), strict=True):
                    other = np.flatnonzero(known != name)
                    at = other[best_of(scores[other], known[other], k)]
                    got = scores[at]
                    if got.dtype == object and any(not -(1 << 63) <= v < 1 << 63 for v in got):
                        raise OverflowError(f"a score of query {name} doesn't fit a long")
                    for c, v in zip(out, (np.full(len(at), name), known[at], got.astype(np.int64)), strict=True):
                        c.append(v)
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))

    keys = ["g", "block", "shard"]
    found = asks.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, schema)
    return ranked(found, k, F.desc("score"))
