"""Packing of token sequences by non-negative least squares.

Documents longer than a window give whole windows first. What remains of each is put in a bin
of ``unit`` tokens; every way to fill the window with at most three bins is enumerated, and
non-negative least squares finds how often each way has to be used to match the histogram of
bins. The counts are rounded and carried out, the rest is packed best-fit decreasing, and the
emptiest windows are cut up to fill the others. So all windows but a group's tail are full;
the tail is cut into windows whose lengths are powers of two, which need no padding.

A partition is packed in groups of about ``group_tokens`` tokens, each with the histogram of
all its documents. Groups are independent: nothing is shuffled or sent to the driver, memory
is bounded by a group (and by the longest document), and a lost task is simply run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._shared import default_tokenizer, text_or_empty, word_ids

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def combinations(bins: int) -> list[tuple[int, ...]]:
    """Every multiset of one to three bins (1..bins) that fills ``bins`` exactly, largest first."""
    out: list[tuple[int, ...]] = [(bins,)]
    for a in range(bins - 1, 0, -1):
        rest = bins - a
        if rest <= a:
            out.append((a, rest))
        out += [(a, b, rest - b) for b in range(min(a, rest - 1), 0, -1) if 0 < rest - b <= b]
    return out


def nonnegative_least_squares(a, b, tolerance: float = 1e-7):
    """x >= 0 that minimises |a x - b|: an active-set method on the normal equations. Every round
    lowers the residual; it ends when none of the columns can, or a round gains no more."""
    import numpy as np

    # sums instead of products of matrices: a library that spreads those over threads makes them
    # spin, which costs more than the work
    target = (a * b[:, None]).sum(axis=0)
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    gram: dict = {}

    def gram_of(chosen):
        """The rows of a'a of some columns; a column has few entries, so each is a sum of few rows."""
        for j in chosen.tolist():
            if j not in gram:
                rows = np.flatnonzero(a[:, j])
                gram[j] = (a[rows] * a[rows, j][:, None]).sum(axis=0)
        return np.array([gram[j] for j in chosen.tolist()]).reshape(-1, len(x))

    def solve(chosen):
        k = np.flatnonzero(chosen)
        s = np.zeros(len(x))
        s[k] = np.linalg.solve(gram_of(k)[:, k] + 1e-9 * np.eye(len(k)), target[k])
        return s

    best = np.inf
    while True:
        used = np.flatnonzero(x)
        product = (gram_of(used) * x[used][:, None]).sum(axis=0)
        residual = (x * (product - 2 * target)).sum()
        if not residual < best - 1e-12 * (1 + abs(residual)):
            break
        best = residual
        gradient = np.where(passive, -np.inf, target - product)
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance * (1 + abs(target).max()):
            break
        passive[j] = True
        s = solve(passive)
        while passive.any() and s[passive].min() <= 0:
            low = passive & (s <= 0)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > tolerance
            x[~passive] = 0
            s = solve(passive) if passive.any() else np.zeros(len(x))
        x = s
    return x


def planned(lengths, window: int, unit: int):
    """Windows as lists of indices into ``lengths`` (each 1..window), and what is left over."""
    import numpy as np

    bins = window // unit
    of = (np.asarray(lengths) + unit - 1) // unit
    stock: list[list[int]] = [[] for _ in range(bins + 1)]
    for i in np.argsort(lengths, kind="stable"):
        stock[of[i]].append(int(i))
    present = [b for b in range(1, bins + 1) if stock[b]]
    ways = [w for w in combinations(bins) if all(stock[b] for b in w)]
    windows: list[list[int]] = []
    if ways:
        row = {b: r for r, b in enumerate(present)}
        a = np.zeros((len(present), len(ways)))
        for j, way in enumerate(ways):
            for b in way:
                a[row[b], j] += 1
        times = nonnegative_least_squares(a, np.array([len(stock[b]) for b in present], dtype=float))
        for j in np.argsort(-times, kind="stable"):
            if (n := int(round(times[j]))) == 0:
                break
            for _ in range(n):
                if any(len(stock[b]) < ways[j].count(b) for b in ways[j]):
                    break
                windows.append([stock[b].pop() for b in ways[j]])
    return windows, [i for b in range(bins, 0, -1) for i in reversed(stock[b])]


def best_fit(lengths, items, window: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest window that still has room."""
    from bisect import bisect_left, insort

    windows: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(items, key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            windows.append([i])
            left, w = window - lengths[i], len(windows) - 1
        else:
            left, w = room.pop(at)
            windows[w].append(i)
            left -= lengths[i]
        if left:
            insort(room, (left, w))
    return windows


def pack(lengths: list[int], window: int, unit: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each token of each document once."""
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // window * window
        out += [[(d, s, window)] for s in range(0, whole, window)]
        if n > whole:
            rest.append((d, whole, n - whole))
    sizes = [n for _, _, n in rest]
    windows, residual = planned(sizes, window, unit) if rest else ([], [])
    windows += best_fit(sizes, residual, window)
    windows.sort(key=lambda w: -sum(sizes[i] for i in w))
    full, tail = divmod(sum(sizes), window)
    donors = [rest[i] for w in windows[full:] for i in w][::-1]

    def take(n: int) -> list[tuple[int, int, int]]:
        got = []
        while n:
            d, s, k = donors.pop()
            got.append((d, s, min(n, k)))
            if k > n:
                donors.append((d, s + n, k - n))
            n -= got[-1][2]
        return got

    for w in windows[:full]:
        out.append([rest[i] for i in w] + take(window - sum(sizes[i] for i in w)))
    return out + [take(1 << p) for p in range(tail.bit_length() - 1, -1, -1) if tail >> p & 1]


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, window: int = 4096, eos: int = 2, unit: int = 32, group_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece: document, where it starts there, its ids (little-endian unsigned
    32-bit), the sequence that holds it and its place in that sequence.

    ``eos`` is added to every document. Null text is empty text (one token); a null doc_id
    stays null; rows that repeat are packed each for itself; an empty table gives no row;
    columns other than doc_id and text are not read.
    """
    if window % unit or window & (window - 1):
        raise ValueError("window must be a power of two and a multiple of unit")
    path = tokenizer or default_tokenizer()

    def kernel(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = word_ids(path).encode, eos.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        names: list = []
        ids: list[bytes] = []

        def flush():
            nonlocal sequence
            columns: list[list] = [[] for _ in range(7)]
            size = 0
            for pieces in pack([len(x) // 4 for x in ids], window, unit):
                offset = 0
                for d, start, n in pieces:
                    for c, v in zip(columns, (names[d], start, n, ids[d][4 * start : 4 * (start + n)], len(ids[d]) // 4, sequence, offset), strict=True):
                        c.append(v)
                    offset += n
                sequence += 1
                size += offset
                if size >= 1_000_000:
                    yield batch(columns)
                    columns, size = [[] for _ in range(7)], 0
            if columns[0]:
                yield batch(columns)
            names.clear()
            ids.clear()

        def batch(columns):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        held = 0
        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                names.append(doc_id)
                ids.append(encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= group_tokens:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(kernel, SCHEMA)
