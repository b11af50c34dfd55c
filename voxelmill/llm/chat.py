"""Chat formatting in budgeted windows, in DataFrame functions.

Prefix sums of the turns' token counts cut a conversation into turn-aligned spans: a turn is new
in window ``floor(tokens before it / span)``. A window holds the system turn (if the first turn is
one), the last turns of the window before it that fit in ``history`` tokens, and its new turns.
Only the texts of new assistant turns are targets; repeated ones are masked.

A turn is ``<|im_start|>role`` + newline + text + ``<|im_end|>`` + newline. Inside roles and texts
every ``<|`` gets a second bar, so a control string never occurs there, and dropping one bar of
each ``<||`` gives the text back; a newline in a role is written ``<|n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns whose prefix sums are made in one task; sums of such chunks are summed up in turn.
CHUNK = 256


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<|n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<|n"), F.lit("\n")))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up, and four for the control strings."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def format_conversations(conversations: DataFrame, *, budget: int = 2048, tokens=estimated_tokens) -> DataFrame:
    """One row per window: conv_id, ``win`` (ascending through the conversation), ``text``,
    ``n_context`` (repeated turns at its start), ``n_new``, ``tokens``, ``over_budget`` and
    ``loss_spans`` (start and end of each target, in code points, end exclusive).

    Half the budget is for new turns and a quarter for history. No turn is cut: a window whose
    turns are longer than that may pass the budget, and says so. Turns are ordered by turn,
    role, text, nulls first; null roles and texts are empty; rows that repeat are turns of their
    own; null conv_ids are one conversation; an empty table gives no row; columns other than
    conv_id, turn, role and text are not read.
    """
    span, history = budget // 2, budget // 4
    role, body = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), escaped(body).alias("body"), F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / CHUNK).alias("chunk"))
    turns = turns.withColumn("head", F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))).withColumn("cost", tokens(F.col("body")))
    # prefix sums in two levels, so that a very long conversation is never one task's
    sums = turns.groupBy("conv_id", "chunk").agg(F.sum("cost").alias("c"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("b_conv"), F.col("chunk").alias("b_chunk"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base_cost"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"))
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "body")
    placed = turns.join(bases, _same("conv_id", "b_conv") & (F.col("chunk") == F.col("b_chunk")))
    placed = placed.withColumn("pos", F.col("base_n") + F.row_number().over(order)).withColumn("ahead", F.col("base_cost") + F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("win", F.floor(F.col("ahead") / span)).withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    line = Window.partitionBy("conv_id").orderBy("win")
    windows = placed.groupBy("conv_id", "win").agg(F.min("ahead").alias("first"))
    windows = windows.select(F.col("conv_id").alias("w_conv"), F.col("win").alias("w_win"), F.lead("win").over(line).alias("next"), F.lead("first").over(line).alias("next_first"))
    met = placed.join(windows, _same("conv_id", "w_conv") & (F.col("win") == F.col("w_win")))
    repeat = F.col("next").isNotNull() & (F.col("ahead") >= F.col("next_first") - history) & ~F.col("system")
    # kind 0: system, 1: history, 2: new
    here = F.struct(F.col("win").alias("to"), F.lit(2).alias("kind"))
    there = F.when(repeat, F.struct(F.col("next").alias("to"), F.lit(1).alias("kind")))
    parts = met.select("conv_id", F.explode(F.array_compact(F.array(here, there))).alias("p"), "pos", "head", "body", "role", "cost").select("conv_id", F.col("p.to").alias("win"), F.col("p.kind").alias("kind"), "pos", "head", "body", "role", "cost")
    system = placed.filter("system").select("conv_id", "pos", "head", "body", "role", "cost")
    parts = parts.union(windows.filter("w_win > 0").join(system, _same("w_conv", "conv_id")).select("w_conv", "w_win", F.lit(0), "pos", "head", "body", "role", "cost"))
    target = (F.col("kind") == 2) & (F.col("role") == "assistant")
    item = F.struct("kind", "pos", F.concat("head", "body", F.lit(END)).alias("shown"), F.length("head").alias("skip"), F.length("body").alias("size"), target.alias("target"))
    grouped = parts.groupBy("conv_id", "win").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum((F.col("kind") < 2).cast("long")).alias("n_context"), F.sum((F.col("kind") == 2).cast("long")).alias("n_new"), F.sum("cost").alias("tokens"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc, x):
        start = acc["at"] + x["skip"]
        grown = F.when(x["target"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"))))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(x["shown"])).alias("at"), grown.alias("spans"))

    return grouped.select(
        "conv_id", F.col("win").cast("long").alias("win"), F.array_join(F.transform("items", lambda x: x["shown"]), "").alias("text"), "n_context", "n_new", "tokens", (F.col("tokens") > budget).alias("over_budget"), F.aggregate("items", empty, add, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per window of ``format_conversations``, parsed from its text: conv_id, win,
    ``turns`` (role and text of its new turns, unescaped), ``targets`` (the texts under the loss
    mask, unescaped) and ``chars`` (the length of the formatted text)."""
    pieces = F.split("text", r"<\|im_end\|>\n")
    new = F.slice(pieces, (F.col("n_context") + 1).cast("int"), F.greatest(F.size(pieces) - 1 - F.col("n_context").cast("int"), F.lit(0)))
    body = F.transform(new, lambda p: F.substring(p, len(START) + 1, F.length(p)))

    def parsed(p):
        name = F.substring_index(p, "\n", 1)
        return F.struct(unescaped_role(name).alias("role"), unescaped(F.substring(p, F.length(name) + 2, F.length(p))).alias("text"))

    targets = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "win", F.transform(body, parsed).alias("turns"), targets.alias("targets"), F.length("text").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """The digest of each conversation, read back from its windows."""
    text = read_back(windows)
    joined = lambda column: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("win", column))), lambda x: x[column]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = text.select("conv_id", "win", F.size("turns").cast("long").alias("n"), said.alias("said"), F.array_join("targets", "").alias("target"), "chars")
    return per.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sha2(joined("said").cast("binary"), 256).alias("turns_sha256"), F.sum(F.length("target")).cast("long").alias("loss_chars"), F.sha2(joined("target").cast("binary"), 256).alias("loss_sha256"), F.sum("chars").cast("long").alias("formatted_chars"),
    )


#: ``digests`` of all conversations and conversation -1 as SQL.
ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, replace(text, '<|', '<||') AS body, length(replace(text, '<|', '<||')) + length('<|im_start|>') + length(replace(replace(role, '<|', '<||'), chr(10), '<|n')) + 1 + length('<|im_end|>') + 1 AS chars,
    ceil(length(replace(text, '<|', '<||')) / 4.0)::BIGINT + 4 AS cost
  FROM turns
), placed AS (
  SELECT *, row_number() OVER w AS pos, (sum(cost) OVER w - cost)::BIGINT AS ahead FROM sized
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING)
), cut AS (SELECT *, ahead // 1024 AS win, pos = 1 AND role = 'system' AS sys FROM placed),
wins AS (
  SELECT conv_id, win, lead(win) OVER (PARTITION BY conv_id ORDER BY win) AS next, lead(min(ahead)) OVER (PARTITION BY conv_id ORDER BY win) AS next_first
  FROM cut GROUP BY conv_id, win
), repeated AS (
  SELECT c.conv_id, sum(c.chars) AS chars FROM cut c JOIN wins w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.win = w.win
  WHERE w.next IS NOT NULL AND c.ahead >= w.next_first - 512 AND NOT c.sys GROUP BY c.conv_id
), systems AS (
  SELECT c.conv_id, sum(c.chars) AS chars FROM cut c JOIN wins w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.win > 0 WHERE c.sys GROUP BY c.conv_id
), per AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos)) AS loss_sha256, sum(chars) AS chars
  FROM cut GROUP BY conv_id
)
SELECT per.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (per.chars + coalesce(r.chars, 0) + coalesce(s.chars, 0))::BIGINT AS formatted_chars
FROM per LEFT JOIN repeated r ON per.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN systems s ON per.conv_id IS NOT DISTINCT FROM s.conv_id
"""
