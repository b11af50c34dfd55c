"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into ``radius // 2 + 1`` segments: if two fingerprints differ in
at most ``radius`` bits, they differ in at most one bit in some segment. Each segment is indexed
as it is and once for each of its bits with that bit deleted; equal keys meet, fingerprints that
meet are compared. A pair is compared where a segment is equal, or where just the deleted bit
differs, so the many variants of an equal segment cost nothing.

Equal fingerprints are one class from the start. Within a bucket only the edges of a spanning
forest of its links leave the task, so neither copies nor dense groups give all their pairs.
Buckets over ``bucket_limit`` are known before anything gathers them; they are split into blocks,
and every pair of blocks is compared in a task of its own: exact, however large the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm._shared import HOT_ROWS, join_counted, partitions, settle, text_or_empty
from voxelmill.llm.components import components

MASK = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, words: int):
    """XXH64 with seed 42 of each shingle of a text, in order; none without words."""
    import numpy as np
    import xxhash

    # bytes.lower() changes A-Z only, and bytes.split() splits at 0x20 and 0x09-0x0D only
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    clean, n = b" ".join(parts), min(words, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(clean[s:e], 42) for s, e in zip(starts[: len(parts) - n + 1].tolist(), (starts[n:] - 1).tolist(), strict=True)], dtype="<u8")


def fold(hashes, tables: int) -> list[int]:
    """The fingerprint of some shingles as ``tables`` unsigned 64-bit numbers. The first is the
    contract's: a bit is set if it is in over half of the hashes. The others take the same hashes
    times fixed odd numbers, folded, so each is a sketch of its own."""
    import numpy as np

    out = []
    for t in range(tables):
        h = hashes if t == 0 else hashes * np.uint64((0x9E3779B97F4A7C15 * (2 * t + 1)) & MASK)
        h = h if t == 0 else h ^ (h >> np.uint64(32))
        counts = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little"))
    return out


def fingerprint_bits(text: bytes, words: int, tables: int) -> list[int]:
    """The fingerprint of a text; of one without words, zeros."""
    return fold(shingle_hashes(text, words), tables)


def fingerprints(docs: DataFrame, *, words: int = 4, tables: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and f0 (f1, ...): the fingerprints as signed longs. Null text is empty."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), *(f"f{t} long" for t in range(tables))])

    def kernel(batches):
        import pyarrow as pa

        for rows in batches:
            prints = [fingerprint_bits(x.as_py().encode(), words, tables) for x in rows.column(rows.num_columns - 1)]
            columns = [*rows.columns[:-1], *(pa.array([signed(p[t]) for p in prints], pa.int64()) for t in range(tables))]
            yield pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(len(keep))), *(f"f{t}" for t in range(tables))])

    out = docs.select(*kept, text_or_empty().alias("text")).mapInArrow(kernel, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(f"f{t}" for t in range(tables)))


def signature_masks(radius: int) -> list[tuple[int, int]]:
    """(bits that form the key, the deleted bit or 0) for each slot of the index."""
    n = radius // 2 + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    slots = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        segment = ((1 << (hi - lo)) - 1) << lo
        slots += [(segment, 0), *((segment & ~(1 << b), 1 << b) for b in range(lo, hi))]
    return slots


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """The pairs that join two trees when they are taken in order."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


class Rule:
    """When two fingerprints of a bucket are linked there (numpy arrays, broadcast)."""

    def __init__(self, radius: int, total: int):
        self.radius, self.total = radius, total

    def __call__(self, differ, deleted):
        """differ: (..., tables) unsigned; deleted: the deleted bit, or 0."""
        import numpy as np

        first = differ[..., 0]
        far = np.bitwise_count(first)
        good = (far <= self.radius) & ((deleted == 0) | ((first & deleted) != 0))
        if differ.shape[-1] > 1:
            good &= np.bitwise_count(differ).sum(axis=-1) <= self.total
        return good


#: Runs up to SHORT rows are compared by shifting the batch against itself; BLOCK: the edge of the
#: squares that longer runs are compared in.
SHORT, BLOCK = 32, 512


def short_links(prints, side, deleted, position, size, rule: Rule):
    """Row pairs (i, j) of all linked pairs in the runs of up to SHORT rows, all runs at once.
    position, size: of each row in its run, and of its run."""
    import numpy as np

    found = []
    for lag in range(1, SHORT):
        i = np.flatnonzero((size <= SHORT) & (position + lag < size))
        if not len(i):
            break
        good = rule(prints[i] ^ prints[i + lag], deleted[i]) & ((side[i] == 0) | (side[i] != side[i + lag]))
        found.append(np.stack([i[good], i[good] + lag], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def run_links(prints, side, deleted, rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links in one run. Few links are gathered from squares of the
    comparison matrix; if there are many, the run is searched breadth first instead, which
    looks at each row once and keeps only tree edges."""
    import numpy as np

    n, found, count = len(prints), [], 0
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
            good = rule(prints[a, None] ^ prints[None, b], deleted)
            if side.any():
                good &= side[a, None] != side[None, b]
            x, y = np.nonzero(good)
            x, y = x + i, y + j
            found.append(np.stack([x, y], axis=1)[x < y])
            count += len(found[-1])
        if count > 8 * n:
            break
    else:
        return _forest(n, np.concatenate(found).tolist())
    out, left = [], np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            good = rule(prints[left] ^ prints[at], deleted)
            if side.any():
                good &= side[left] != side[at]
            reached, left = left[good].tolist(), left[~good]
            out += [(at, x) for x in reached]
            queue += reached
    return out


def large_buckets(prints: DataFrame, indexed: DataFrame, slots: list[tuple[int, int]] | None, limit: int) -> DataFrame:
    """slot, key, size of buckets that may hold more than ``limit`` rows; size may be too great.

    Buckets by segments need counts of the whole segments only, a small part of the index: a
    bucket with a deleted bit holds two values of its segment, so it is large only if one of them
    has over half the limit."""
    if slots is None:
        return indexed.groupBy("slot", "key").agg(F.count("*").alias("size")).filter(F.col("size") > limit)
    masks = F.array(*(F.lit(signed(m)) for m, _ in slots))
    whole = [i for i, (_, deleted) in enumerate(slots) if not deleted]
    values = prints.select(F.explode(F.array(*map(F.lit, whole))).alias("slot"), "f0").select("slot", F.col("f0").bitwiseAND(masks[F.col("slot")]).alias("key"))
    heavy = values.groupBy("slot", "key").agg(F.count("*").alias("size")).filter(F.col("size") > limit // 2)
    last = F.array(*(F.lit(b - 1) for b in [*whole[1:], len(slots)]))[F.array_position(F.array(*map(F.lit, whole)), F.col("slot")).cast("int") - 1]
    every = heavy.select(F.explode(F.sequence("slot", last)).alias("slot"), "key", "size", F.col("slot").alias("own"))
    every = every.select("slot", F.col("key").bitwiseAND(masks[F.col("slot")]).alias("key"), F.when(F.col("slot") == F.col("own"), F.col("size")).otherwise(F.col("size") + limit // 2).alias("size"))
    return every.groupBy("slot", "key").agg(F.sum("size").alias("size"))


def links(prints: DataFrame, *, radius: int = 4, tables: int = 1, total: int | None = None, bucket_limit: int = 16384, keys: str | None = None) -> DataFrame:
    """Edges (u, v: long) among the rows of ``prints`` (node long, f0, ...; distinct fingerprints):
    a spanning forest, bucket by bucket, of all pairs whose f0 differ in at most ``radius`` bits
    and all tables together in at most ``total``. ``keys`` names an array of longs: then just the
    rows that agree at one of its places meet, and not those by the segments of f0."""
    slots = signature_masks(radius)
    total = radius if total is None else total
    values = ["node", *(f"f{t}" for t in range(tables))]
    if keys is None:
        masks = F.array(*(F.lit(signed(m)) for m, _ in slots))
        indexed = prints.select(*values, F.explode(F.sequence(F.lit(0), F.lit(len(slots) - 1))).alias("slot"))
        indexed = indexed.withColumn("key", F.col("f0").bitwiseAND(masks[F.col("slot")]))
    else:
        indexed = prints.select(*values, F.posexplode(keys).alias("slot", "key"))
    # few, if any: Spark broadcasts them if they are small by their size when it is known
    crowded = settle(large_buckets(prints, indexed, slots if keys is None else None, bucket_limit), "large_buckets")
    schema = "u long, v long"

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        def edges_of(columns, last: bool):
            """Edges of all runs (the last one only if nothing follows), and the rows of that last run."""
            slot, key, pair, side, nodes = columns[:5]
            new = np.ones(len(slot), bool)
            new[1:] = (slot[1:] != slot[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            starts = np.append(np.flatnonzero(new), len(slot))
            rest = [] if last else [c[starts[-2] :] for c in columns]
            if not last:
                starts = starts[:-1]
            n, sizes = int(starts[-1]), np.diff(starts)
            prints_ = np.stack([c[:n] for c in columns[5:]], axis=1).view(np.uint64)
            deleted = dropped[slot[:n]] if keys is None else np.zeros(n, np.uint64)
            position, size = np.arange(n) - np.repeat(starts[:-1], sizes), np.repeat(sizes, sizes)
            found = short_links(prints_, side[:n], deleted, position, size, rule)
            out = _forest(n, found.tolist()) if len(found) else []
            for k in np.flatnonzero(sizes > SHORT):
                s, e = int(starts[k]), int(starts[k + 1])
                out += [(s + i, s + j) for i, j in run_links(prints_[s:e], side[s:e], deleted[s], rule)]
            ends = np.array(out, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[ends[:, 0]]), pa.array(nodes[ends[:, 1]])], ["u", "v"]), rest

        dropped, rule = np.array([d for _, d in slots], dtype=np.uint64), Rule(radius, total)
        held: list = []
        for rows in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in rows.columns]
            if len(columns[0]):
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)] if held else columns
                edges, held = edges_of(columns, False)
                yield edges
        if held:
            yield edges_of(held, True)[0]

    def solved(rows: DataFrame) -> DataFrame:
        return rows.select("slot", "key", "pair", "side", *values).mapInArrow(kernel, schema)

    small = indexed.join(crowded.select("slot", "key"), ["slot", "key"], "left_anti")
    small = small.withColumn("size", F.count("*").over(Window.partitionBy("slot", "key"))).filter("size > 1").select("*", F.lit(0).alias("pair"), F.lit(0).alias("side"))
    small = solved(small.sortWithinPartitions("slot", "key"))
    if crowded.isEmpty():
        return small
    # pair of blocks i <= j as i * blocks + j; a row of block b takes part in every pair with b
    blocks = F.ceil(F.col("size") * 2 / bucket_limit).cast("int")
    large = indexed.join(crowded, ["slot", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(*values), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.withColumn("pair", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    large = large.withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
    large = large.repartition(partitions(prints.sparkSession), "slot", "key", "pair").sortWithinPartitions("slot", "key", "pair")
    return small.union(solved(large))


def duplicate_groups(docs: DataFrame, *, words: int = 4, radius: int = 4, bucket_limit: int = 16384, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the least doc_id of its component
    (null only if all its doc_ids are null). One row per row of ``docs``.

    Null text is empty text, and texts without words share the fingerprint zero and are linked.
    Rows that repeat fall into one component. An empty table gives no row. Columns other than
    text and doc_id are not read.
    """
    marked = settle(fingerprints(docs, words=words), "fingerprints")
    # rows that share a fingerprint become one before anything is compared or joined
    per = settle(marked.groupBy(F.col("f0").alias("node")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct_fingerprints")
    found = components(links(per.select("node", F.col("node").alias("f0")), radius=radius, bucket_limit=bucket_limit))
    labelled = per.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    labelled = settle(labelled.select("node", "n", "least", F.coalesce("label", "node").alias("component")), "labels")
    groups = settle(labelled.groupBy(F.col("component").alias("group")).agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "groups")
    named = settle(join_counted(labelled, "component", groups, "group", "members", hot_rows).select(F.col("node").alias("_print"), "n", "component_id"), "named")
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return join_counted(marked, "f0", named, "_print", "n", hot_rows).select("doc_id", hexed.alias("fingerprint"), "component_id")
