"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles of the training rows. Boosting goes round the
features in cycles: each turn fits a shallow tree on one feature's bins to the gradient of the
logistic loss and adds a small step to that feature's look-up table. Then the pairs whose
residuals gain most from a joint table get theirs in the same way. A score is a sum of table
entries, so whole batches are scored by indexed additions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._shared import text_or_empty

FEATURES = (
    "log_chars", "word_length", "letters", "upper", "digits", "punctuation", "symbols", "non_ascii", "blanks", "lines",
    "line_words", "repeated_lines", "distinct_words", "commonest_word", "repeats_in_a_row", "marked_words", "shouted_words", "short_words", "bars", "ends_in_stop",
)


def features_of(text: str) -> list[float]:
    """The features of one whole text; all zero but for the defaults of an empty one."""
    import numpy as np

    raw = text.encode()
    n = max(len(raw), 1)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    w = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    upper, lower, digits = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    plain = int(c[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    printable = int(c[33:127].sum())
    return [
        float(np.log1p(len(text))), len(text) / w, (upper + lower) / n, upper / max(upper + lower, 1), digits / n, plain / n, (printable - upper - lower - digits - plain) / n, int(c[128:].sum()) / n, int(c[[9, 10, 13, 32]].sum()) / n, float(np.log1p(len(lines))),
        w / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), len(counts) / w, max(counts.values(), default=0) / w, sum(map(str.__eq__, words, words[1:])) / w, sum(not (x[-1].isalnum() or x[-1] in ".,") for x in words) / w, sum(map(str.isupper, words)) / w, sum(len(x) < 4 for x in words) / w, int(c[124]) / w, int(c[46]) / max(len(lines), 1),
    ]


@dataclass
class AdditiveModel:
    """Bin edges of each feature, a table for each feature and each chosen pair, and an intercept."""

    edges: list
    tables: list
    pairs: list
    pair_tables: list
    intercept: float

    def bins(self, x):
        import numpy as np

        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x):
        """The probability of label 1 for each row of features."""
        import numpy as np

        b = self.bins(x)
        logit = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            logit += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            logit += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-logit))


def shallow_tree(gradient, hessian, leaves: int = 3, least: float = 2.0, ridge: float = 1.0):
    """Steps per bin of a tree with at most ``leaves`` leaves over ordered bins."""
    import numpy as np

    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    cuts = [0, len(gradient)]
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = np.arange(a + 1, b)
            m = m[(h[m] - h[a] >= least) & (h[b] - h[m] >= least)]
            if len(m):
                gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return step


def fit(x, y, *, bins: int = 32, rounds: int = 150, pairs: int = 6, pair_bins: int = 8, rate: float = 0.1) -> AdditiveModel:
    """Fit the tables; deterministic for given rows in a given order. Without rows, or with one
    label only, the model is an intercept."""
    import numpy as np

    n, d = x.shape
    share = (y.sum() + 1) / (n + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], [], [], float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    logit = np.full(n, model.intercept)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-logit))
            k = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(b[:, j], y - p, k), np.bincount(b[:, j], p * (1 - p), k))
            model.tables[j] += step
            logit += step[b[:, j]]
    # pairs: coarse joint bins, ranked by how much of the residual they explain
    coarse = [np.minimum(np.arange(len(e) + 1) * pair_bins // max(len(e) + 1, 1), pair_bins - 1) for e in edges]
    c = [coarse[j][b[:, j]] for j in range(d)]
    p = 1 / (1 + np.exp(-logit))
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            joint = c[i] * pair_bins + c[j]
            gains.append((float((np.bincount(joint, y - p) ** 2 / (np.bincount(joint, p * (1 - p)) + 1)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    tables = [np.zeros(pair_bins * pair_bins) for _ in model.pairs]
    for _ in range(rounds // 3):
        for t, (i, j) in zip(tables, model.pairs, strict=True):
            p, joint = 1 / (1 + np.exp(-logit)), c[i] * pair_bins + c[j]
            step = rate * np.bincount(joint, y - p, len(t)) / (np.bincount(joint, p * (1 - p), len(t)) + 4.0)
            t += step
            logit += step[joint]
    model.pair_tables = [t.reshape(pair_bins, pair_bins)[np.ix_(coarse[i], coarse[j])] for t, (i, j) in zip(tables, model.pairs, strict=True)]
    return model


def held_out(column="doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled documents that are not held out: those whose ids
    have the least hashes, so the sample is the same at any partitioning.

    A doc_id labelled more than once counts once, with its mean label rounded (0.5 up). Null
    ids and labels don't train. The features of the sample, some 3 MB, go to the driver.
    """
    import numpy as np

    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    known = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "_id")
    text = docs.select(F.col("doc_id").alias("_doc"), text_or_empty().alias("text"))
    # the sample has a fixed bound, so it may be broadcast: no text is shuffled
    labelled = text.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("_doc", "y", "text")

    def kernel(batches):
        import pyarrow as pa

        for rows in batches:
            x = [features_of(t.as_py()) for t in rows.column(2)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc", "y", "x"])

    # rows that repeat a doc_id count once
    measured = labelled.mapInArrow(kernel, "doc long, y double, x array<double>").groupBy("doc", "y").agg(F.min("x").alias("x"))
    rows = measured.toArrow().to_pydict()
    order = sorted(range(len(rows["doc"])), key=lambda i: rows["doc"][i])
    x = np.array([rows["x"][i] for i in order], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([rows["y"][i] for i in order], dtype=np.float64))


def score_documents(docs: DataFrame, model: AdditiveModel, *, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The ``keep`` columns and the score (0 to 1, as ``name``) of every whole text. Null text is empty text,
    which has a score like any other; rows that repeat repeat; an empty table gives no row."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "score double"])

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        for rows in batches:
            x = np.array([features_of(t.as_py()) for t in rows.column(rows.num_columns - 1)], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(model.score(x))], [*(f"k{i}" for i in range(len(keep))), "score"])

    out = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), text_or_empty().alias("text")).mapInArrow(kernel, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("score").alias(name))
