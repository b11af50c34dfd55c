"""Secret scans with corpus-wide ownership frequency.

Base spans come from three patterns. Besides, opaque strings (long, of mixed characters, of high
entropy) are candidates. The hash of every candidate's value is counted over the distinct
repositories and owners that hold it: a value that many owners share is a copied example, one
that few owners hold looks live. Opaque candidates that look live become spans as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._shared import HOT_ROWS, Taken, fresh, join_counted, numbered, settle, small_side, text_or_empty

#: The patterns of the base kinds, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as runs of any length of which those under 24 are dropped
KINDS = ("assign", "access", "hex", "opaque")
KEYWORDS = ("passw", "secret", "token", "api")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

SCAN = "row long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base string, spans array<struct<kind:int,start:int,end:int,value_start:int,value_end:int,hash:long>>"


def base_spans(text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) of the base kinds, kind by kind."""
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield 0, m.start(), m.end(), m.start(2), m.end(2)
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield 1, m.start(), m.end(), m.start(), m.end()
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end(), m.start(), m.end()


def entropy(value: str) -> float:
    """Bits a character."""
    from collections import Counter
    from math import log2

    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def opaque_spans(text: str, taken: Taken, least_entropy: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Strings of 20 and more characters with lower and upper case and digits, and of at least
    ``least_entropy`` bits a character, that touch no base span."""
    for m in OPAQUE.finditer(text):
        value = m.group()
        if any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value) and entropy(value) >= least_entropy and not taken.touches(*m.span()):
            yield 3, m.start(), m.end(), m.start(), m.end()


def scan(docs: DataFrame, *, owner: Column | str = "source", repository: Column | str | None = None, least_entropy: float = 3.5, key: str | None = None) -> DataFrame:
    """One row per document with all its candidates (``SCAN``, and the column ``key`` as ``key``);
    spans count code points."""
    owner = F.col(owner) if isinstance(owner, str) else owner
    repository = F.concat_ws("/", owner, F.col("lang")) if repository is None else F.col(repository) if isinstance(repository, str) else repository

    def kernel(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        names = [*(c.split()[0] for c in SCAN.split(", ")), *(["key"] if key else [])]
        span = pa.struct([(n, pa.int64() if n == "hash" else pa.int32()) for n in ("kind", "start", "end", "value_start", "value_end", "hash")])
        for rows in batches:
            counts, bases, spans = [], [], []
            for text in rows.column(rows.num_columns - 1):
                text = text.as_py()
                base = sorted(base_spans(text), key=lambda s: (s[1], s[0]))
                more = opaque_spans(text, Taken(s[1:3] for s in base), least_entropy)
                counts.append([sum(s[0] == k for s in base) for k in range(3)])
                bases.append(",".join(f"{KINDS[s[0]]}:{s[1]}:{s[2]}" for s in base))
                spans.append([dict(zip(("kind", "start", "end", "value_start", "value_end"), s, strict=True), hash=xxhash.xxh64_intdigest(text[s[3] : s[4]]) - (1 << 63)) for s in sorted([*base, *more], key=lambda s: (s[1], s[0]))])
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), *rows.columns[:3], *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(bases, pa.string()), pa.array(spans, pa.list_(span)), *rows.columns[3:-1]], names)
            row += n

    carried = [F.col(key).alias("key")] if key else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), *carried, text_or_empty().alias("text"))
    return rows.mapInArrow(kernel, SCAN + (f", key {dict(rows.dtypes)['key']}" if key else ""))


def ownership(found: DataFrame, example_owners: int) -> DataFrame:
    """hash, spans (how many have it), owners, repositories, live: over all documents. Spans of the
    same owner and repository are counted where they are read, so a value that a third of all
    documents hold is a few rows before anything gathers it."""
    held = found.select("owner", "repository", F.explode("spans.hash").alias("hash")).groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    counted = by_owner.groupBy("hash").agg(F.sum("n").alias("spans"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    return counted.withColumn("live", F.col("owners") < example_owners)


def find_secrets(docs: DataFrame, *, owner: Column | str = "source", repository: Column | str | None = None, example_owners: int = 3, least_entropy: float = 3.5, key: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: doc_id (and the column ``key`` as ``key``), counts of the base kinds, ``base`` (kind:start:end of the
    base spans, by start, then kind) and ``spans``: an array of kind, start, end, value_start,
    value_end, owners, repositories and live for the base spans and for opaque candidates that
    fewer than ``example_owners`` owners hold.

    Null text is empty text; null owners are one owner; rows that repeat repeat, and count once
    for ownership; an empty table gives no row. Kinds may overlap each other.
    """
    found = settle(scan(docs, owner=owner, repository=repository, least_entropy=least_entropy, key=key), "secrets")
    counts = settle(ownership(found, example_owners).withColumnRenamed("spans", "held"), "owners")
    kept = ["row", *(["key"] if key else []), "doc_id", "n_assign", "n_access", "n_hex", "base"]
    names = F.array(*map(F.lit, KINDS))
    spans = found.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s", F.col("s.hash").alias("_hash"))
    # a value that very many spans share is no one task's
    single = join_counted(spans, "_hash", counts, "hash", "held", hot_rows).filter((F.col("s.kind") < 3) | F.col("live"))
    span = F.struct("s.start", F.col("s.kind").alias("order"), names[F.col("s.kind")].alias("kind"), "s.end", "s.value_start", "s.value_end", "owners", "repositories", "live")
    some = single.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    joined = found.select(*kept).join(some.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    empty = F.array().cast(dict(some.dtypes)["spans"])
    return joined.select(*kept[1:], F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, *, mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with the values of live-looking secrets masked in ``text``, and ``n_chars`` (if
    there) to match. Documents without any are left as they are. Rows are matched by their place in
    their file, so rows that repeat, or have no doc_id, stay apart."""
    row, found_, spans = (fresh(n, docs.columns) for n in ("_row", "_found", "_spans"))
    marked = numbered(docs, row)
    found = find_secrets(marked, key=row, **options)
    live = found.select(F.col("key").alias(found_), F.filter("spans", lambda s: s["live"]).alias(spans)).filter(F.size(spans) > 0)
    live = small_side(settle(live, "live_secrets"))
    joined = marked.join(live, F.col(row) == F.col(found_), "left")
    # from left to right; a span that starts inside the one before only adds what sticks out
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        gap = F.substring("text", acc["at"] + 1, F.greatest(s["value_start"] - acc["at"], F.lit(0)))
        masked = F.when(s["value_start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(masked.alias("out"), F.greatest(acc["at"], s["value_end"]).alias("at"))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    untouched = F.col(found_).isNull()
    out = joined.withColumn("text", F.when(untouched, F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
