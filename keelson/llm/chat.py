"""Chat formatting into budgeted windows, in DataFrame operations only.

Turns of a conversation get prefix sums of their tokens.  A window takes turns as long as the sum since its start fits into the
budget, less what the system turn and the repeated history may take (``room``); then the next window starts, so windows are turn-aligned and
nearly full.  A turn longer than the room is a window of its own, marked ``over_budget`` if it is too long for the budget too.
Each window holds the system turn, the last turns before the span (up to ``history`` tokens), and the span.  Its
loss mask covers assistant texts of the span only: what is repeated as history is masked.

No task ever holds a conversation.  Turns are dealt out by ranges of their order; each range is summed by itself and moved by the
sums of the ranges before it.  The sums cut a conversation into blocks of ``BLOCK_ROOMS`` rooms; windows are chosen block by block, so only
the last one of a block may be less full.  A block has at most as many turns as its tokens have room for, each
turn costing ``TURN_TOKENS`` at least; the last turns before a block are sent to it as well, for its history.

The template writes ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``; neither can then form a mark, and ``unescape`` undoes both.

Defined results for odd input: null roles and texts are empty; a null conversation id is a conversation of its
own; turns are ordered by number (null first), then role, then text, and equal rows all stay; the
system turn is the first row if its role is ``system``; other columns are ignored, whatever their names; an empty table gives no windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import input_tasks, stage

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that the marks and the role of a turn take.
TURN_TOKENS = 4
#: What counts as a token of a text: a run of letters and digits, or another visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Windows that a block of a conversation has room for.
BLOCK_ROOMS = 16
#: Code points of a text that decide which range its turn goes to; turns that agree so far stay together.
RANGE_CHARS = 64


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and how many of them repeated history may take."""

    window: int = 1024
    history: int = 128
    least_room: int = 128


def escape(text: Column) -> Column:
    """``text`` without anything that could be read as a mark."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def marked_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def _ranges(turns: DataFrame) -> DataFrame:
    """Turns with their tokens, dealt out by ranges of their order and written once; ``conv`` is the conversation as a string, never null."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("`conv_id`").cast("string")), F.lit("")).alias("conv"), F.col("`conv_id`").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), (F.regexp_count(text, F.lit(TOKEN)).cast("long") + TURN_TOKENS).alias("tokens"),
    )
    ranged = rows.repartitionByRange(input_tasks(turns.sparkSession), F.col("conv"), F.col("turn"), F.col("role"), F.substring("text", 1, RANGE_CHARS))
    return stage(ranged.withColumn("range", F.spark_partition_id()), "turns")


def _placed(turns: DataFrame, budget: Budget) -> DataFrame:
    """Turns with their place ``at`` (tokens before them, the system turn not counted), the room of their windows, and the system turn."""
    rows = _ranges(turns)
    head = F.struct("turn", "role", F.when(F.col("role") == "system", F.col("text")).alias("text"), "tokens")
    by_range = rows.groupBy("conv", "range").agg(F.sum("tokens").alias("total"), F.min(head).alias("head"))
    before = Window.partitionBy("conv").orderBy("range")
    first = F.first("head").over(before)
    sums = by_range.select(F.col("conv").alias("sum_conv"), F.col("range").alias("sum_range"), F.coalesce(F.sum("total").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), first.alias("head"))
    sums = sums.withColumn("system", F.when(F.col("head.role") == "system", F.struct("head.text", "head.tokens"))).drop("head")
    sums = stage(sums.withColumn("system_tokens", F.coalesce("system.tokens", F.lit(0).cast("long"))), "turn-sums")
    inside = Window.partitionBy("conv", "range").orderBy("turn", "role", "text")
    summed = rows.withColumns({"before": F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "previous": F.lag("tokens").over(inside)})
    joined = summed.join(sums, (F.col("conv") == F.col("sum_conv")) & (F.col("range") == F.col("sum_range")))
    at = F.col("offset") + F.col("before") - F.col("system_tokens")
    room = F.greatest(F.lit(budget.window - budget.history) - F.col("system_tokens"), F.lit(budget.least_room))
    return joined.withColumns({"at": at, "room": room}).select("conv", "conv_id", "role", "text", "tokens", "at", "room", "previous", "system")


def _blocks(placed: DataFrame, budget: Budget) -> DataFrame:
    """One row per block of a conversation: its turns in order (``own`` false: history of its first windows), and the system turn."""
    width = F.col("room") * BLOCK_ROOMS
    is_system = F.col("at") < 0
    block = F.when(is_system, F.lit(0)).otherwise(F.floor(F.col("at") / width))
    # A block gets the system turn from its first row, which is the first of its range or follows a row of another block.
    opens = F.col("previous").isNull() | is_system | (F.floor((F.col("at") - F.col("previous")) / width) < block)
    also = ~is_system & (F.col("at") >= (block + 1) * width - budget.history)
    rows = placed.select(
        "conv", "conv_id", "room", F.when(opens, F.col("system")).alias("system"), F.explode(F.when(also, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"),
        F.struct("at", "role", "text", "tokens", block.alias("of")).alias("t"),
    )
    grouped = rows.groupBy("conv", "block").agg(F.first("conv_id").alias("conv_id"), F.first("room").alias("room"), F.max("system").alias("system"), F.sort_array(F.collect_list("t")).alias("turns"))
    ordinary = F.filter("turns", lambda t: t["at"] >= 0)
    own = F.filter(ordinary, lambda t: t["of"] == F.col("block"))
    return grouped.select("conv", "conv_id", "block", "room", "system", ordinary.alias("turns"), own.alias("own")).where((F.size("own") > 0) | (F.size("turns") == 0))


def _starts(own: Column, room: Column) -> Column:
    """Places at which the windows of a block start: the first turn that passes the room starts the next one."""
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("all"))

    def step(acc: Column, t: Column) -> Column:
        new = acc["last"].isNull() | (t["at"] + t["tokens"] - acc["last"] > room)
        return F.struct(F.when(new, t["at"]).otherwise(acc["last"]).alias("last"), F.when(new, F.concat(acc["all"], F.array(t["at"]))).otherwise(acc["all"]).alias("all"))

    return F.aggregate(own, zero, step, lambda acc: acc["all"])


def format_chats(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Windows of all conversations: conv_id, block and nth (their order), n_tokens, over_budget, n_context (leading
    turns that repeat or were placed before), formatted, and loss: spans (start, end) of code points in formatted."""
    if budget.history >= BLOCK_ROOMS * budget.least_room:
        raise ValueError("the history must be shorter than a block")
    blocks = _blocks(_placed(turns, budget), budget)
    # A conversation that is nothing but a system turn is one window without a start.
    starts = F.when(F.size("own") > 0, _starts(F.col("own"), F.col("room"))).otherwise(F.array(F.lit(None).cast("long")))
    listed = blocks.withColumn("starts", starts).select("*", F.posexplode("starts").alias("nth", "start"))
    stop = F.try_element_at("starts", F.col("nth") + 2)
    span = F.filter("own", lambda t: (t["at"] >= F.col("start")) & (F.col("stop").isNull() | (t["at"] < F.col("stop"))))
    history = F.filter("turns", lambda t: (t["at"] + t["tokens"] <= F.col("start")) & (t["at"] >= F.col("start") - budget.history))
    part = lambda ts, n: F.transform(ts, lambda t: F.struct(F.lit(n).alias("part"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens")))
    lead = F.array_compact(F.array(F.when(F.col("system").isNotNull(), F.struct(F.lit(0).alias("part"), F.lit("system").alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens")))))
    windows = listed.withColumn("stop", stop).select("conv_id", "block", "nth", "start", F.concat(lead, part(history, 1), part(span, 2)).alias("turns"))
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    is_first = F.coalesce(F.col("start"), F.lit(0)) == 0
    context = F.size(F.filter("turns", lambda t: (t["part"] == 1) | ((t["part"] == 0) & ~is_first)))
    return windows.select(
        "conv_id", "block", "nth", n_tokens.alias("n_tokens"), (n_tokens > budget.window).alias("over_budget"), context.alias("n_context"),
        F.array_join(F.transform("turns", lambda t: marked_turn(t["role"], t["text"])), "").alias("formatted"), _loss(F.col("turns")).alias("loss"),
    )


def _loss(turns: Column) -> Column:
    """Spans of the escaped assistant texts of a window's own turns inside its formatted text."""
    span = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(TURN) + F.length(escape(t["role"])) + len(TEXT)
        end = start + F.length(escape(t["text"]))
        target = (t["part"] == 2) & (t["role"] == "assistant")
        new = F.array(F.struct(start.alias("start"), end.alias("end"))).cast(span)
        return F.struct((end + len(END)).alias("at"), F.when(target, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, zero, step, lambda acc: acc["out"])


def read_turns(formatted: Column, skip: Column) -> Column:
    """Array of (role, text) parsed from a window's formatted text, without its first ``skip`` turns."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    new = F.slice(pieces, skip + 1, F.size(pieces))

    def parse(p: Column) -> Column:
        inner = F.substring(p, F.lit(len(TURN) + 1), F.length(p))
        cut = F.instr(inner, TEXT)
        role, text = F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + len(TEXT), F.length(inner))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(new, parse)


def read_targets(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask of a window, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
