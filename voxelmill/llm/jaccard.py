"""Near-duplicates by exact Jaccard similarity of word shingles.

Candidates come first. The SimHash fingerprints of the texts meet through their deletion-variant
signatures, as in ``simhash``: all pairs within four bits. Pairs of similarity 0.8 mostly differ in more,
so the least hashes of a text's shingles under 128 fixed functions, in 32 bands of four, find the rest.
Texts of similarity s meet in a band with probability s^4, so at 0.8 one pair in twenty
million meets in none. Of texts that meet there, those whose fingerprints of 256 bits differ in more than
88 (38.7 on average at 0.8, spread some 6) are no candidates. Each group that candidates connect is
then solved exactly: two texts are linked if and only if their sets of shingles are as similar as
asked. Very large groups are split into blocks, and every pair of blocks is solved by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._shared import HOT_ROWS, join_counted, settle, small_side, text_or_empty
from voxelmill.llm.components import components
from voxelmill.llm.simhash import fold, links, shingle_hashes, signed

BANDS, BAND_ROWS, TABLES, CANDIDATE_BITS, RADIUS = 32, 4, 4, 88, 4


def shingle_set(text: bytes, words: int):
    """The different shingles of a text as sorted 64-bit hashes; none without words."""
    import numpy as np

    return np.unique(shingle_hashes(text, words))


def bands_of(shingles):
    """A 64-bit key for each band: a mix of the least hashes of its functions. Sets are not empty."""
    import numpy as np

    factors = np.random.default_rng(5).integers(1 << 30, 1 << 32, BANDS * BAND_ROWS).astype(np.uint32) | np.uint32(1)
    high, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(high), 4096):
        least = np.minimum(least, (factors[:, None] * high[None, i : i + 4096]).min(axis=1))
    keys = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def sketches(docs: DataFrame, *, words: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, node (a hash of the set of shingles), n (its size), f0 to f3 and bands."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    kinds, names = dict(docs.dtypes), [*(f"k{i}" for i in range(len(keep))), "node", "n", *(f"f{t}" for t in range(TABLES)), "bands"]
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "node long, n long", *(f"f{t} long" for t in range(TABLES)), "bands array<long>"])

    def kernel(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for rows in batches:
            columns: list = [[] for _ in range(2 + TABLES)]
            bands = []
            for x in rows.column(rows.num_columns - 1):
                hashes = shingle_hashes(x.as_py().encode(), words)
                own = np.unique(hashes)
                for c, v in zip(columns, (xxhash.xxh64_intdigest(own.tobytes(), 7), len(own), *fold(hashes, TABLES)), strict=True):
                    c.append(signed(int(v)))
                bands.append(bands_of(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array(c, pa.int64()) for c in columns), pa.array(bands, pa.list_(pa.int64()))], names)

    out = docs.select(*kept, text_or_empty().alias("text")).mapInArrow(kernel, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *names[len(keep) :])


class Postings:
    """The rows of some sets by shingle."""

    def __init__(self, sets, rows):
        import numpy as np

        flat = np.concatenate([sets[i] for i in rows])
        owner = np.repeat(rows, [len(sets[i]) for i in rows])
        order = np.argsort(flat, kind="stable")
        self.keys, self.starts = np.unique(flat[order], return_index=True)
        self.ends, self.rows = np.append(self.starts[1:], len(flat)), owner[order]

    def sharing(self, shingles, least: int):
        """Rows that can share all but ``least - 1`` of the shingles: those with one of its ``least`` rarest."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        known = self.keys[at] == shingles
        sizes = np.where(known, self.ends[at] - self.starts[at], 0)
        rare = np.argsort(sizes, kind="stable")[:least]
        found = [self.rows[self.starts[a] : self.ends[a]] for a in at[rare[sizes[rare] > 0]]]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def similar_links(sets, least: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of (sorted, not empty) sets whose Jaccard similarity is
    ``least`` (a fraction) or more. A search breadth first; the postings are made again whenever
    half of their rows are reached, so a group of near copies costs little more than its size."""
    import numpy as np

    a, b = least
    n, out = len(sets), []
    unseen, indexed, rest = np.ones(n, bool), n, n
    postings = Postings(sets, np.arange(n)) if n else None
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root], queue, rest = False, [root], rest - 1
        while queue and rest:
            if 2 * rest < indexed:
                postings, indexed = Postings(sets, np.flatnonzero(unseen)), rest
            i = queue.pop()
            size = len(sets[i])
            # of similar sets, each holds all but size - ceil(size * a / b) of the other's shingles
            for j in postings.sharing(sets[i], size - -(-size * a // b) + 1).tolist():
                if unseen[j]:
                    other = len(sets[j])
                    if b * min(size, other) >= a * max(size, other):
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if b * both >= a * (size + other - both):
                            unseen[j], rest = False, rest - 1
                            out.append((i, j))
                            queue.append(j)
    return out


def candidates(distinct: DataFrame, *, bucket_limit: int) -> DataFrame:
    """Edges (u, v: long) that connect the texts of ``distinct`` (see ``sketches``) which may be similar:
    those whose fingerprints differ in at most ``RADIUS`` bits, by their deletion-variant signatures, and
    those that meet in a band. Texts without words are one node, similar to no other."""
    named = distinct.filter("n > 0")
    signed_ = links(named.select("node", "f0"), radius=RADIUS, bucket_limit=bucket_limit)
    return signed_.union(links(distinct, radius=64, tables=TABLES, total=CANDIDATE_BITS, bucket_limit=bucket_limit, keys="bands"))


def verified(chosen: DataFrame, texts: DataFrame, *, words: int, least: tuple[int, int], block_shingles: int, hot_rows: int) -> DataFrame:
    """Edges (u, v: long) among ``chosen`` (settled: node, n, row, label; distinct nodes): within each
    label a spanning forest of the pairs that are similar. ``texts``: row and text."""
    totals = chosen.groupBy(F.col("label").alias("_label")).agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("parts"), F.count("*").alias("size"))
    # two blocks of half the size make one task
    dealt = join_counted(chosen, "label", settle(totals, "group_sizes"), "_label", "size", hot_rows).withColumn("blocks", F.when(F.col("parts") > 1, 2 * F.col("parts")).otherwise(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", F.explode(others)).filter((F.col("blocks") == 1) | (F.col("own") != F.col("other")))
    dealt = dealt.withColumn("pair", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).select("label", "pair", "node", F.col("row").alias("_row"))
    # texts stay where they are as long as the rows that ask for them are few
    members = texts.join(small_side(settle(dealt, "dealt")), F.col("row") == F.col("_row")).select("label", "pair", "node", "text")

    def solve(table):
        import numpy as np
        import pyarrow as pa

        nodes = table.column("node").to_numpy()
        sets = [shingle_set(x.as_py().encode(), words) for x in table.column("text")]
        ends = np.array(similar_links(sets, least), dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(nodes[ends[:, 0]], pa.int64()), "v": pa.array(nodes[ends[:, 1]], pa.int64())})

    return members.groupBy("label", "pair").applyInArrow(solve, "u long, v long")


def classes(docs: DataFrame, *, row: str, words: int = 5, least: tuple[int, int] = (4, 5), keep: tuple[str, ...] = (), bucket_limit: int = 16384, block_shingles: int = 4_000_000, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Two settled tables: the sketches of ``docs`` with ``row``, ``keep`` and node, and for every node
    its number of rows and its component (node, copies, component).

    ``row`` names a column that no two rows of ``docs`` share; ``docs`` is read more than once and has to
    give a row the same value each time. Null text is empty text, and texts without words are alike."""
    prints = [f"f{t}" for t in range(TABLES)]
    marked = settle(sketches(docs, words=words, keep=(row, *keep)), "sketches")
    distinct = settle(marked.groupBy("node").agg(F.count("*").alias("copies"), F.min(row).alias("row"), F.min("n").alias("n"), *(F.min(c).alias(c) for c in prints), F.min("bands").alias("bands")), "distinct_texts")
    near = components(candidates(distinct, bucket_limit=bucket_limit))
    near = near.select(F.col("node").alias("_node"), "label")
    chosen = settle(distinct.select("node", "n", "row").join(near, F.col("node") == F.col("_node")).drop("_node"), "candidates")
    texts = docs.select(F.col(row).alias("row"), text_or_empty().alias("text"))
    found = components(verified(chosen, texts, words=words, least=least, block_shingles=block_shingles, hot_rows=hot_rows))
    found = found.select(F.col("node").alias("_node"), "label")
    named = distinct.select("node", "copies").join(found, F.col("node") == F.col("_node"), "left").select("node", "copies", F.coalesce("label", "node").alias("component"))
    return marked, settle(named, "classes")


def similar_groups(docs: DataFrame, *, row: str, keep: tuple[str, ...] = (), hot_rows: int = HOT_ROWS, **options) -> DataFrame:
    """``row``, ``keep`` and ``component``: a long that documents share if and only if pairs of
    Jaccard similarity ``least`` (a fraction) or more connect them. One row per row of ``docs``; an
    empty table gives none. See ``classes``."""
    marked, named = classes(docs, row=row, keep=keep, hot_rows=hot_rows, **options)
    named = named.withColumnRenamed("node", "_node")
    return join_counted(marked, "node", named, "_node", "copies", hot_rows).select(row, *keep, "component")


def others(docs: DataFrame, *, row: str, first: str, **options) -> DataFrame:
    """The ``row`` of every document but one of each group of ``similar_groups``: the one left out has
    the least ``first``, nulls last; of equal ones the least node, then the least ``row``.

    Only one row of each text, and then of each group, is ever joined with its group: both are
    partial minima."""
    marked, named = classes(docs, row=row, keep=(first,), **options)
    order = F.struct(F.col(first).isNull().alias("last"), F.col(first).alias("first"), "node", F.col(row).alias("row"))
    one = marked.groupBy("node").agg(F.min(order).alias("best"))
    met = one.join(named.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"))
    chosen = met.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("_row"))
    return marked.select(row).join(chosen, F.col(row) == F.col("_row"), "left_anti")
