"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation is learned on a bounded sample (principal axes, then iterative quantisation), and the
signs of a rotated vector are its 64-bit code. Codes are split into eight substrings, each with
an index of its own. Two codes within Hamming radius r agree in some substring up to r // 8 bits,
so probing all substring values that near retrieves every code within r; these are reranked by
their exact distance.

The sample also tells how far codes are apart for vectors at a given distance: ``Rotation.reach``
is the Hamming radius that holds the wanted share of them. Every query first probes the radius that
suits most of the sample. Once it knows k vectors, the distance of the k-th says which radius would
hold the nearer ones; a query that needs more than it probed, as outliers do, is probed again with
a radius of its own. One that found fewer than k is searched over all rows.

Every vector is indexed. The index is dealt into shards by a hash of the id, each with all eight
tables of its vectors, and queries go to the shards in blocks; neither a frequent code nor a
frequent vector makes a shard larger than the rest. A table of n vectors and q queries is copied
q / ``query_block`` times and the queries n / ``shard_rows`` times, both of them at most 64 MB a task
at 128 components.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._shared import settle
from voxelmill.llm.vectors import bounded_sample, matrix, one_query_each, ranked, shard_of, usable

BITS, SUBSTRINGS = 64, 8


@dataclass
class Rotation:
    """Mean and matrix of the learned rotation; rising distances with the radius for each (the last
    one for all distances beyond), and the radius to begin with."""

    mean: object
    axes: object
    edges: list[float]
    radii: list[int]
    radius: int

    def reach(self, distance: Column) -> Column:
        """The radius that holds the wanted share of the vectors nearer than ``distance``."""
        below = F.size(F.filter(F.array(*map(F.lit, self.edges)), lambda e: e < distance))
        return F.element_at(F.array(*map(F.lit, self.radii)), below + 1)

    def codes(self, x):
        import numpy as np

        bits = ((x - self.mean) @ self.axes > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def learn(x, *, k: int, recall: float, rounds: int = 40, probes: int = 256, steps: int = 48) -> Rotation:
    """Fit the rotation on a sample, and the radii that hold ``recall`` of the sample's pairs at
    up to ``steps`` distances. Vectors shorter than 64 components get random directions for the
    remaining bits."""
    import numpy as np

    random = np.random.default_rng(7)
    mean, d = x.mean(axis=0), x.shape[1]
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    base = np.zeros((d, BITS))
    base[:, : min(len(axes), BITS)] = axes[:BITS].T
    if (missing := BITS - min(len(axes), BITS)) > 0:
        base[:, -missing:] = random.normal(size=(d, missing)) / np.sqrt(d)
    v = (x - mean) @ base
    turn = np.linalg.qr(random.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    out = Rotation(mean, base @ turn, [], [BITS], BITS)
    codes, chosen = out.codes(x), random.permutation(len(x))[:probes]
    pairs, kth = [], []
    for i in chosen if len(x) > 1 else ():
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        order = order[order != i]
        kth.append(far[order[min(k, len(order)) - 1]])
        # the nearest, where neighbours lie, and a thinning selection of those farther away
        some = order[np.unique(np.geomspace(1, len(order), min(len(order), 400)).astype(int)) - 1]
        pairs.append(np.stack([far[some], np.bitwise_count(codes[some] ^ codes[i])]))
    if pairs:
        far, bits = np.concatenate(pairs, axis=1)
        order = np.argsort(far, kind="stable")
        parts = [part for part in np.array_split(order, steps) if len(part)]
        held = np.maximum.accumulate([int(np.quantile(bits[part], recall, method="higher")) for part in parts])
        out.edges, out.radii = [float(far[part].max()) for part in parts], [*held.tolist(), BITS]
        out.radius = out.radii[int(np.searchsorted(out.edges, np.quantile(kth, 0.9)))]
    return out


class MultiIndex:
    """The eight substring tables over some codes, probed together."""

    def __init__(self, codes):
        import numpy as np

        self.codes = codes
        parts = codes.view(np.uint8).reshape(-1, SUBSTRINGS).astype(np.int64) + 256 * np.arange(SUBSTRINGS)
        flat = parts.ravel()
        self.rows = np.argsort(flat, kind="stable") // SUBSTRINGS
        self.ends = np.cumsum(np.bincount(flat, minlength=256 * SUBSTRINGS))

    def within(self, code, radius: int):
        """Rows whose code is within the radius of ``code``."""
        import numpy as np

        if radius >= BITS:
            return np.arange(len(self.codes))
        values = np.arange(256)
        masks = values[np.bitwise_count(values) <= radius // SUBSTRINGS]
        parts = np.asarray([code], "<u8").view(np.uint8).astype(np.int64)
        probes = ((parts[:, None] ^ masks) + 256 * np.arange(SUBSTRINGS)[:, None]).ravel()
        ends, starts = self.ends[probes], np.where(probes > 0, self.ends[probes - 1], 0)
        sizes = ends - starts
        places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        hit = np.zeros(len(self.codes), bool)
        hit[self.rows[places]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def nearest(embeddings: DataFrame, queries: DataFrame, *, k: int = 10, recall: float = 0.97, sample_rows: int = 8192, shard_rows: int = 65536, least_shards: int = 48, query_block: int = 32768) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in double precision) of the
    ``k`` nearest vectors found for each query, nearest first, ties to the smaller vec_id.

    Both tables have vec_id and embedding. Vectors that are null, zero, of an unusual length, or
    that hold null or non-finite components take no part, nor do rows without vec_id. A query
    never finds rows of its own vec_id, and finds ``k`` rows wherever there are so many others.
    Rows that repeat are candidates each; of queries that share a vec_id the one with the least
    vector counts. Without usable vectors there is no row. Other columns are not read.
    """
    rows = usable(embeddings, zero=False)
    ids, x = bounded_sample(rows, sample_rows)
    schema = "query_id long, vec_id long, score double"
    if not len(ids):
        return ranked(rows.sparkSession.createDataFrame([], schema), k, F.col("score"))
    rotation, d = learn(x, k=k, recall=recall), x.shape[1]
    asked = one_query_each(usable(queries, zero=False).filter(F.size("x") == d))
    n, n_asked = rows.count(), asked.count()
    shards = max(-(-n // shard_rows), min(least_shards, -(-n // 512)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def search(asks, data):
        import numpy as np
        import pyarrow as pa

        out: list = [[], [], []]
        if asks.num_rows and data.num_rows:
            q, x = matrix(asks), matrix(data)
            names, known = asks.column("vec_id").to_numpy(), data.column("vec_id").to_numpy()
            index = MultiIndex(rotation.codes(x))
            for name, vector, code, radius in zip(names, q, rotation.codes(q), asks.column("radius").to_pylist(), strict=True):
                at = index.within(code, radius)
                at = at[known[at] != name]
                far = np.sqrt(((x[at] - vector) ** 2).sum(axis=1))
                if len(far) > k:
                    keep = far <= np.partition(far, k - 1)[k - 1]
                    at, far = at[keep], far[keep]
                best = np.lexsort((known[at], far))[:k]
                for c, v in zip(out, (np.full(len(best), name), known[at[best]], far[best]), strict=True):
                    c.append(v)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float64))})

    def searched(asked: DataFrame, count: int, name: str) -> DataFrame:
        """The best ``k`` rows of each of the ``count`` queries (vec_id, x, radius)."""
        blocks = max(-(-count // query_block), 1)
        data = rows.select("vec_id", "x", shard_of(shards).alias("shard"), every(blocks).alias("block"))
        asks = asked.select("vec_id", "x", "radius", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
        found = asks.groupBy("block", "shard").cogroup(data.groupBy("block", "shard")).applyInArrow(lambda key, asks, data: search(asks, data), schema)
        return settle(ranked(found, k, F.col("score")), name)

    found = searched(asked.withColumn("radius", F.lit(rotation.radius)), n_asked, "neighbours")
    last = found.filter(F.col("rank") == k).select("query_id", rotation.reach(F.col("score")).alias("radius"))
    wider = asked.join(last, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "x", F.coalesce("radius", F.lit(BITS)).alias("radius"))
    wider = settle(wider.filter(F.col("radius") > rotation.radius), "wider_queries")
    more = wider.count()
    if not more:
        return found
    other = found.join(wider.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return other.unionByName(searched(wider, more, "wider_neighbours"))
