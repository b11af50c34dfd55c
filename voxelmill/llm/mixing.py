"""Mixing of sources to target weights by iterative proportional fitting, in DataFrame functions.

Documents fall into cells of source, language and topic. The token weight of each cell is raked
to the target shares of the three margins in turn, again and again; a cell's factor is its raked
weight over its own. Factors times one scale, at most 1, are sampling probabilities; the scale is
calibrated so that the expected tokens are the wanted share of all. A document stays if a draw
from its id lies below its cell's probability.

Clipped at 1, scarce cells give less than their targets: no more of them is there. With ``repeat``
the factors are not clipped: a document of a cell whose rate is 2.3 stays twice, and a third time
if its draw lies below 0.3, so the margins keep their targets at the same expected tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm._shared import settle, text_or_empty

MARGINS = ("source", "lang", "topic")
NONE = "(none)"


def word_count(text: Column) -> Column:
    """Words between ASCII white space: the token weight of a text."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def topic_of(text: Column, words: Column) -> Column:
    """The default topic, by form: no topic is stored with the documents."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(F.instr(text, " | ") > 0, "table").when(words < 50, "short").when(words < 8 * lines, "listing").otherwise("prose")


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the three margins (null: ``(none)``) and the tokens of each document."""
    text = text_or_empty()
    extra = [c for c in keep if c not in ("doc_id", *MARGINS)]
    out = docs.select("doc_id", *extra, *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in MARGINS[:2]), text.alias("_text"), word_count(text).alias("tokens"))
    return out.withColumn("topic", topic_of(F.col("_text"), F.col("tokens"))).drop("_text")


def rates(cells: DataFrame, *, temper: float = 0.8, targets: dict[str, dict[str, float]] | None = None, sweeps: int = 8, share: float = 0.8, scalings: int = 8, repeat: bool = False) -> DataFrame:
    """source, lang, topic, rate for each cell of ``cells`` (source, lang, topic, tokens).

    ``targets`` gives the share of each value of a margin; values that it doesn't name, and
    margins without targets, get their own share to the power ``temper``. Shares are scaled to
    sum to one. ``share`` (below 1) of the tokens is to stay. Rates are at most 1, at the cost of the
    targets of scarce values, unless ``repeat`` lets documents stay more than once. All cells are raked in one task: there are as many as combinations of source,
    language and topic, however many documents. Cells without tokens have rate 1.
    """
    everything = Window.partitionBy()
    out = cells.coalesce(1).withColumn("factor", F.lit(1.0)).withColumn("all", F.sum("tokens").over(everything).cast("double"))
    for m in MARGINS:
        inside = Window.partitionBy(m)
        own = F.pow(F.sum("tokens").over(inside) / F.greatest("all", F.lit(1.0)), F.lit(temper))
        given = (targets or {}).get(m, {})
        named = F.create_map(*(F.lit(x) for kv in given.items() for x in kv)) if given else None
        out = out.withColumn(f"aim_{m}", F.coalesce(F.try_element_at(named, F.col(m)), own) if given else own).withColumn("_n", F.count("*").over(inside))
        out = out.withColumn(f"aim_{m}", F.col(f"aim_{m}") / F.sum(F.col(f"aim_{m}") / F.col("_n")).over(everything))
    for _ in range(sweeps):
        for m in MARGINS:
            now = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(m)) / F.greatest("all", F.lit(1.0))
            out = out.withColumn("_now", now).withColumn("factor", F.when(F.col("_now") > 0, F.col("factor") * F.col(f"aim_{m}") / F.col("_now")).otherwise(F.col("factor")))
    out = out.withColumn("scale", F.lit(1.0))
    clipped = (lambda rate: rate) if repeat else (lambda rate: F.least(F.lit(1.0), rate))
    for _ in range(1 if repeat else scalings):
        out = out.withColumn("_now", F.sum(F.col("tokens") * clipped(F.col("scale") * F.col("factor"))).over(everything) / F.greatest("all", F.lit(1.0)))
        out = out.withColumn("scale", F.when(F.col("_now") > 0, F.col("scale") * share / F.col("_now")).otherwise(F.col("scale")))
    rate = clipped(F.col("scale") * F.col("factor"))
    return out.select(*MARGINS, F.when(F.col("tokens") > 0, rate).otherwise(1.0).alias("rate"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of the seed and the id: the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _drawn(docs: DataFrame, doc_id: str, seed: str) -> DataFrame:
    """The rows of ``docs`` (with a rate) that stay, each as often as it does."""
    whole = F.floor("rate")
    times = whole + (draw(F.col(doc_id), seed) < F.col("rate") - whole).cast("long")
    return docs.withColumn("_times", times).filter("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_times")


def _join_rates(docs: DataFrame, table: DataFrame) -> DataFrame:
    named = table.select(*(F.col(c).alias(f"_{c}") for c in MARGINS), "rate")
    on = [F.col(c) == F.col(f"_{c}") for c in MARGINS]
    return docs.join(named, on)


def mix(docs: DataFrame, *, seed: str = "mix", **options) -> DataFrame:
    """The sampled documents: doc_id, source, lang, topic, tokens, ``rate`` (the expected number of
    times that a document stays: a probability, unless ``repeat`` lets it pass 1) and ``copy``
    (from 1: which of its times a row is).

    Null text has no tokens; null sources and languages are the value ``(none)``; rows that
    repeat an id share its draw, null ids one draw; an empty table gives no row; columns other
    than doc_id, text, source and lang are not read. See ``rates`` for the options.
    """
    rows = settle(measured(docs), "mixing")
    cells = settle(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    table = settle(rates(cells, **options), "rates")
    return _drawn(_join_rates(rows, table), "doc_id", seed).select("doc_id", *MARGINS, "tokens", "rate", F.col("_time").alias("copy"))


def sample(docs: DataFrame, *, seed: str = "mix", **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` would keep, with the columns of ``docs``."""
    cells = settle(measured(docs).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    table = settle(rates(cells, **options), "rates")
    text = text_or_empty()
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in MARGINS[:2]), topic_of(text, word_count(text)).alias("topic"))
    return _drawn(_join_rates(packed, table), "_id", seed).select("_row.*")


def oracle(temper: float = 0.8, sweeps: int = 8, seed: str = "mix", share: float = 0.8, scalings: int = 8, repeat: bool = False) -> str:
    """``mix`` as SQL over ``documents``."""
    clipped = "{}" if repeat else "least(1.0, {})"
    scalings = 1 if repeat else scalings
    steps = [
        "rows_ AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS tokens FROM documents)",
        "docs AS (SELECT doc_id, source, lang, tokens, CASE WHEN contains(t, ' | ') THEN 'table' WHEN tokens < 50 THEN 'short' WHEN tokens < 8 * (length(t) - length(replace(t, chr(10), '')) + 1) THEN 'listing' ELSE 'prose' END AS topic FROM rows_)",
        "c0 AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, 1.0::DOUBLE AS factor, greatest(sum(sum(tokens)) OVER (), 1)::DOUBLE AS total FROM docs GROUP BY ALL)",
        "c1 AS (SELECT *, " + ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {m}) / total, {temper}) AS own_{m}, count(*) OVER (PARTITION BY {m}) AS n_{m}" for m in MARGINS) + " FROM c0)",
        "s0 AS (SELECT source, lang, topic, tokens, factor, total, " + ", ".join(f"own_{m} / sum(own_{m} / n_{m}) OVER () AS aim_{m}" for m in MARGINS) + " FROM c1)",
    ]
    n = 0
    for _ in range(sweeps):
        for m in MARGINS:
            now = f"(sum(tokens * factor) OVER (PARTITION BY {m}) / total)"
            steps.append(f"s{n + 1} AS (SELECT source, lang, topic, tokens, CASE WHEN {now} > 0 THEN factor * aim_{m} / {now} ELSE factor END AS factor, total, aim_source, aim_lang, aim_topic FROM s{n})")
            n += 1
    steps.append(f"k0 AS (SELECT source, lang, topic, tokens, factor, total, 1.0::DOUBLE AS scale FROM s{n})")
    for i in range(scalings):
        now = f"(sum(tokens * {clipped.format('scale * factor')}) OVER () / total)"
        steps.append(f"k{i + 1} AS (SELECT source, lang, topic, tokens, factor, total, CASE WHEN {now} > 0 THEN scale * {share} / {now} ELSE scale END AS scale FROM k{i})")
    steps.append(f"r AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN {clipped.format('scale * factor')} ELSE 1.0 END AS rate FROM k{scalings})")
    drawn = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0"
    steps.append(f"d AS (SELECT *, floor(rate)::BIGINT + CASE WHEN {drawn} < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM docs JOIN r USING (source, lang, topic))")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, tokens, round(rate, 6) AS rate, unnest(range(1, copies + 1)) AS copy FROM d"
