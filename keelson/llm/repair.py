"""Conversation structure repair: the cheapest edits that make the roles of a conversation an optional system turn and pairs of user and assistant.

Turns get fault flags; sorted turns of a conversation are folded by ``aggregate()``, which carries one (cost, audit) struct for each of four states (nothing
yet, after the system turn, after a user, after an assistant) and takes the ``least`` of what leads into a state.  An audit is one letter an edit: ``K`` keep, ``R`` rerole to
user or assistant, ``D`` delete, ``I`` insert an empty turn.  Letters decide the states, so two audits of one cost never extend each other, and the least
struct of a state stays the least whatever follows.

No task holds a conversation.  Turns are dealt out by ranges of their order and numbered; ``PIECE`` numbers in a row are a piece.  The fold of a piece starts from the first state if its conversation starts
there, else from each of the four: that gives a table of 4 x 4 structs, and tables of adjacent pieces compose in the same way, first ``SPAN`` pieces at a time, then the rest.  What windows over a
conversation would tell (repeats, neighbours, gaps) comes from aggregates by text and from the borders of pieces.  Texts take no part in this: turns travel with a digest of their text, which is
joined to what is left.

Defined results for odd input: null roles and texts are one space, so such a text is blank; a null conversation id is a conversation of its own; turns are ordered by number
(null first), then role, then the digest of the text; equal rows all count, all but the first as duplicates; a role's initial is its first character, an empty role has none; texts of any length are read whole; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import input_tasks, stage, unstage

#: Turns of a piece, as a power of two; pieces that are composed at once, likewise.
PIECE_BITS, SPAN_BITS = 9, 6
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the fold.
START, SYSTEM, USER, ASSISTANT = range(4)
VISIBLE, SENTENCE_END = r"[^\x20\x09-\x0D]", ".!?"

_STATE = "struct<cost:bigint,audit:string,path:array<struct<length:int,state:int>>>"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rows(turns: DataFrame) -> DataFrame:
    """One row a turn: its key (conversation, number, role, digest of the text) and the text."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.struct(F.col("`conv_id`").alias("id")).alias("conv"), F.struct(F.col("`turn`").cast("long").alias("no")).alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", _digest(F.col("text")))


def _turns(rows: DataFrame) -> DataFrame:
    """Turns in order with their flags, numbered by ``at``: close together in a range of the order, without a meaning between ranges."""
    last = F.regexp_extract("text", rf"({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    flagged = rows.select("conv", "turn", "role", "digest", (last == "").alias("blank"), (~F.contains(F.lit(SENTENCE_END), last)).alias("cut"))
    counted = flagged.groupBy("conv", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut"))
    firsts = counted.groupBy("conv", "role", "digest").agg(F.min("turn").alias("first"))
    joined = counted.join(firsts, ["conv", "role", "digest"])
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    # A fault takes the place of the later ones.
    duplicate = ~F.col("blank") & ((F.col("turn") != F.col("first")) | (F.col("copy") > 1))
    fault = F.when(F.col("blank"), "blank").when(duplicate, "duplicate").when(F.col("cut"), "truncated")
    order = ("conv", "turn", "role", "digest", "copy")
    ranged = each.select(*order, fault.alias("fault")).repartitionByRange(input_tasks(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stage(ranged.withColumn("at", F.monotonically_increasing_id()), "repair-turns")


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _plus(state: Column, cost: int | Column, letter: str) -> Column:
    """``state`` after one more edit; null stays null."""
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"), state["path"].alias("path")))


def _let(value: Column, f) -> Column:
    """``f`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), f)[0]


def _with_inserts(s: Column) -> Column:
    """States after inserts of empty turns: a user after anything but a user, an assistant after a user."""
    user = F.least(s[USER], *(_plus(s[i], INSERT, "I") for i in (START, SYSTEM, ASSISTANT)))
    return _let(user, lambda u: F.array(s[START], s[SYSTEM], u, F.least(s[ASSISTANT], _plus(u, INSERT, "I"))))


def _row_step(states: Column, turn: Column) -> Column:
    """States after one turn was deleted, kept or reroled in each state that inserts may lead to."""
    extra = F.when(turn["fault"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0))
    may_stay = ~F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    kept = lambda state, wanted: F.when(may_stay & (_initial(turn["role"]) == wanted), _plus(state, extra, "K"))
    reroled = lambda state: F.when(may_stay, _plus(state, extra + REROLE, "R"))

    def after(s: Column, before_user: Column) -> Column:
        gone = [_plus(s[i], DELETE, "D") for i in range(4)]
        user = F.least(gone[USER], kept(before_user, "u"), reroled(before_user))
        return F.array(gone[START], F.least(gone[SYSTEM], kept(s[START], "s")), user, F.least(gone[ASSISTANT], kept(s[USER], "a"), reroled(s[USER])))

    return _let(_with_inserts(states), lambda s: _let(F.least(s[START], s[SYSTEM], s[ASSISTANT]), lambda before_user: after(s, before_user)))


def _fold(turns: Column, opens: Column) -> Column:
    """Table of a piece: for each state that it may start from (the first alone if it ``opens`` a conversation) the states that it may end in."""
    none = F.lit(None).cast(_STATE)
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<struct<length:int,state:int>>").alias("path")).cast(_STATE)
    starts = F.when(opens, F.array(F.lit(0))).otherwise(F.array(*(F.lit(i) for i in range(4))))

    def run(i: Column) -> Column:
        first = F.array(*(F.when(i == k, zero).otherwise(none) for k in range(4)))
        # The piece's own part of the path: how long its audit is and where it ends.
        step = lambda state, k: F.array(F.struct(F.length(state["audit"]).alias("length"), F.lit(k).alias("state")))
        ended = lambda state, k: F.when(state.isNotNull(), F.struct(state["cost"].alias("cost"), state["audit"].alias("audit"), step(state, k).alias("path")).cast(_STATE))
        return F.aggregate(turns, first, _row_step, lambda done: F.array(*(ended(done[k], k) for k in range(4))))

    return F.transform(starts, run)


def _compose(tables: Column) -> Column:
    """Table of adjacent pieces (an array of tables in order) as of one."""

    def joined(a: Column, b: Column) -> Column:
        both = F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["path"], b["path"]).alias("path"))
        return F.when(a.isNotNull() & b.isNotNull(), both)

    def step(acc: Column, table: Column) -> Column:
        return F.transform(acc, lambda s: F.array(*(F.least(*(joined(s[i], table[i][k]) for i in range(4))) for k in range(4))))

    return F.aggregate(F.slice(tables, F.lit(2), F.size(tables)), tables[0], step)


def _gathered(parts: DataFrame, bits: int) -> DataFrame:
    """Pieces of a conversation that agree above ``bits`` of their number as one; all that come without ``bits``."""
    key = F.shiftright("piece", bits) if bits else F.lit(0).cast("long")
    fields = ("table", "first", "last", "counts", "illegal", "seen")
    rows = parts.groupBy("conv", key.alias("above")).agg(F.sort_array(F.collect_list(F.struct("piece", *fields))).alias("parts"))
    pairs = F.zip_with(F.slice("parts", F.lit(1), F.size("parts") - 1), F.slice("parts", F.lit(2), F.size("parts")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    total = lambda name: F.aggregate(F.col("parts"), F.lit(0).cast("long"), lambda n, p: n + p[name])
    across = F.size(F.filter(pairs, lambda p: ~_legal(p["a"]["last"]["role"], p["b"]["first"]["role"]))).cast("long")
    same = F.size(F.filter(pairs, lambda p: p["a"]["last"]["no"] == p["b"]["first"]["no"])).cast("long")
    counts = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0]["counts"], lambda n, p: F.zip_with(n, p["counts"], lambda x, y: x + y))
    return rows.select(
        "conv", F.col("above").alias("piece"), _compose(F.transform("parts", lambda p: p["table"])).alias("table"), F.col("parts")[0]["first"].alias("first"), F.element_at("parts", -1)["last"].alias("last"),
        counts.alias("counts"), (total("illegal") + across).alias("illegal"), (total("seen") - same).alias("seen"), F.transform("parts", lambda p: p["piece"]).alias("members"),
    )


def _legal(before: Column, after: Column) -> Column:
    return F.concat(_initial(before), F.lit("|"), _initial(after)).isin("s|u", "u|a", "a|u")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and what to do, and the turns that this leaves.

    The first table: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  The second: conv_id, piece and place (their order), role, text.
    ``turns`` (conv_id, turn, role, text) is read twice.
    """
    rows = _rows(turns)
    numbered = _turns(rows)
    piece = F.shiftright("at", PIECE_BITS)
    turn = F.struct("at", F.col("turn.no").alias("no"), "role", "digest", "fault")
    grouped = numbered.groupBy("conv", piece.alias("piece")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    opening = numbered.groupBy("conv").agg(F.shiftright(F.min("at"), PIECE_BITS).alias("opening"))
    t = F.col("turns")
    pairs = F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    of_kind = lambda k: F.size(F.filter(t, lambda x: F.coalesce(x["fault"] == k, F.lit(False)))).cast("long")
    kinds = F.array(*map(of_kind, ("blank", "duplicate", "truncated")))
    pieces = stage(
        grouped.join(opening, "conv").select(
            "conv", "piece", "turns", _fold(t, F.col("piece") == F.col("opening")).alias("table"), t[0].alias("first"), F.element_at(t, -1).alias("last"), kinds.alias("counts"),
            F.size(F.filter(pairs, lambda p: ~_legal(p["a"]["role"], p["b"]["role"]))).cast("long").alias("illegal"), F.size(F.array_distinct(F.filter(F.transform(t, lambda x: x["no"]), lambda n: n.isNotNull()))).cast("long").alias("seen"),
        ),
        "repair-pieces",
    )
    spans = _gathered(pieces.drop("turns"), SPAN_BITS)
    whole = stage(_gathered(spans.drop("members"), 0).withColumn("states", _with_inserts(F.col("table")[0])), "repair-whole")
    unstage(numbered)
    best = F.least(F.col("states")[START], F.col("states")[ASSISTANT])
    # The lowest number of a conversation is that of its first turn with one.
    lowest = pieces.groupBy("conv").agg(F.min(F.array_min(F.transform("turns", lambda x: x["no"]))).alias("low"))
    gaps = F.coalesce(F.col("last.no") - F.col("low") + 1 - F.col("seen"), F.lit(0).cast("long"))
    judged = whole.join(lowest, "conv").select("conv", gaps.alias("gaps"), *(F.col("counts")[i].alias(n) for i, n in enumerate(("blank", "duplicate", "truncated"))), "illegal", best.alias("best"))
    audits = judged.select(F.col("conv.id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))

    # Where each piece's part of the audit begins and ends, and the state it starts from.
    path, audit = F.col("best.path"), F.col("best.audit")
    numbers = pieces.groupBy("conv").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    ends = F.aggregate(path, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["length"])))
    listed = judged.join(numbers, "conv").select("conv", "pieces", path.alias("path"), audit.alias("audit"), ends.alias("ends")).select("*", F.posexplode("pieces").alias("nth", "piece"))
    is_last = F.col("nth") + 1 == F.size("pieces")
    stop = F.when(is_last, F.length("audit")).otherwise(F.try_element_at("ends", F.col("nth") + 2))
    begin = F.try_element_at("ends", F.col("nth") + 1)
    entered = F.when(F.col("nth") == 0, F.lit(START)).otherwise(F.try_element_at("path", F.col("nth"))["state"])
    orders = listed.select("conv", "piece", F.substring("audit", begin + 1, stop - begin).alias("edits"), entered.alias("state"))
    lines = pieces.select("conv", "piece", "turns").join(orders, ["conv", "piece"]).withColumn("line", F.explode(_lines()))
    texts = rows.select("conv", "turn", "role", "digest", "text")
    needed = lines.select("conv", "piece", "line.*").where("NOT gone")
    inserted = needed.where("inserted").select(F.col("conv.id").alias("conv_id"), "piece", "place", "said", F.lit("").alias("text"))
    key = ["conv", "turn", "role", "digest"]
    # Rows that repeat a key would bring its text once each; the join has dealt them out by that key, so dropping them moves no row.
    kept = needed.where("NOT inserted").withColumn("turn", F.struct(F.col("no"))).join(texts, key).dropDuplicates([*key, "piece", "place"])
    kept = kept.select(F.col("conv.id").alias("conv_id"), "piece", "place", "said", "text")
    return audits, kept.unionByName(inserted).withColumnRenamed("said", "role")


def _lines() -> Column:
    """What each edit of a piece (edits, state, turns) leaves: place, role, whether the turn is gone or inserted, and the turn it takes."""
    line = "struct<place:int,said:string,gone:boolean,inserted:boolean,no:bigint,role:string,digest:binary>"
    zero = F.struct(F.lit(0).alias("i"), F.col("state").alias("state"), F.array().cast(f"array<{line}>").alias("out"))
    letters = F.filter(F.split("edits", ""), lambda x: x != "")
    numbered = F.transform(letters, lambda x, i: F.struct(x.alias("edit"), i.alias("place")))

    def step(acc: Column, e: Column) -> Column:
        t, edit = F.col("turns")[acc["i"]], e["edit"]
        other = F.when(acc["state"] == USER, F.lit(ASSISTANT)).otherwise(F.lit(USER))
        other_role = F.when(acc["state"] == USER, F.lit("assistant")).otherwise(F.lit("user"))
        is_insert, is_gone = edit == "I", edit == "D"
        kept = F.when(_initial(t["role"]) == "s", F.lit(SYSTEM)).otherwise(other)
        state = F.when(is_gone, acc["state"]).when(edit == "K", kept).otherwise(other)
        said = F.when(edit == "K", t["role"]).otherwise(other_role)
        own = lambda name: F.when(~is_insert, t[name]).alias(name)
        new = F.struct(e["place"].alias("place"), said.alias("said"), is_gone.alias("gone"), is_insert.alias("inserted"), own("no"), own("role"), own("digest")).cast(line)
        return F.struct((acc["i"] + F.when(is_insert, 0).otherwise(1)).alias("i"), state.alias("state"), F.concat(acc["out"], F.array(new)).alias("out"))

    return F.aggregate(numbered, zero, step, lambda acc: acc["out"])
