"""Conversation structure repair: faults by windows, the cheapest edits by one fold over each conversation.

A sound conversation is empty, or a system turn or none, then user and assistant turns in turn, ending with
an assistant. ``role initials`` are the first characters of the roles; a sound row of them matches ``(s?(ua)+)?``.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an edit costs. Blank and repeated turns must go; a truncated turn that stays costs ``TRUNCATED`` more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: More than any repair costs.
NEVER = 1 << 40
#: White space, and ends of sentences.
SPACE, ENDS = " \t\n\v\f\r", (".", "!", "?")
#: What has been put out so far ends with: nothing yet, a system, a user, an assistant turn.
STATES = ("none", "system", "user", "assistant")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def option(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("bigint").alias("cost"), audit.alias("audit"))


def edit(before: Column, letter: str, cost: Column | int) -> Column:
    return option(before["cost"] + cost, F.concat(before["audit"], F.lit(letter)))


def states(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(*(c.alias(s) for s, c in zip(STATES, (none, system, user, assistant))))


def with_inserts(v: Column) -> Column:
    """The cheapest option of each state after any inserts; more than two in a row come back to a state at a higher cost."""
    user = F.least(v["user"], *(edit(v[s], "I", INSERT) for s in ("none", "system", "assistant")))
    return bind(user, lambda u: states(v["none"], v["system"], u, F.least(v["assistant"], edit(u, "I", INSERT))))


def with_turn(w: Column, turn: Column) -> Column:
    """The cheapest option of each state after one more turn: deleted, kept where its initial fits, or given the role that fits."""
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    stays = ~turn["fault"].isin("blank", "duplicate")
    gone = {s: edit(w[s], "D", DELETE) for s in STATES}

    def put(before: Column, initial: str) -> Column:
        kept = turn["initial"] == initial
        return F.when(kept, edit(before, "K", extra + KEEP)).otherwise(edit(before, "R", extra + REROLE))

    first = F.when(turn["initial"] == "s", edit(w["none"], "K", extra + KEEP))  # a null isn't least
    user = put(F.least(w["none"], w["system"], w["assistant"]), "u")
    return F.when(
        stays, states(gone["none"], F.least(gone["system"], first), F.least(gone["user"], user), F.least(gone["assistant"], put(w["user"], "a")))
    ).otherwise(states(*gone.values()))


def cheapest(turns: Column) -> Column:
    """The least (cost, audit) of a conversation whose turns are structs with initial and fault, in order.

    Options of one state are compared by cost, then audit. A state's option may be chosen before the rest is known:
    of two audits with one cost neither begins the other, as each letter for a turn is in both and inserts cost.
    """
    start, never = option(F.lit(0), F.lit("")), option(F.lit(NEVER), F.lit(""))
    return F.aggregate(
        turns,
        states(start, never, never, never),
        lambda v, turn: bind(with_inserts(v), lambda w: with_turn(w, turn)),
        lambda v: bind(with_inserts(v), lambda w: F.least(w["none"], w["assistant"])),
    )


def repaired(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that the edits of ``audit`` give. Each turn has one letter of K, R and D, with the inserts before it.

    What comes out at a place has the role of that place, as user and assistant alternate after a system turn.
    """
    letters = F.regexp_extract_all(audit, F.lit("I*[KRD]|I+$"), F.lit(0))
    blank = F.struct(F.lit("I").alias("by"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("initial"))

    def put(piece: Column, i: Column) -> Column:
        by = F.right(piece, F.lit(1))
        inserts = F.array_repeat(blank, F.length(piece) - F.when(by == "I", 0).otherwise(1))
        turn = F.get(turns, i)
        own = F.struct(by.alias("by"), turn["role"].alias("role"), turn["text"].alias("text"), turn["initial"].alias("initial"))
        return F.when(by.isin("K", "R"), F.concat(inserts, F.array(own))).otherwise(inserts)

    out = F.flatten(F.transform(letters, put))

    def role(rows: Column) -> Column:
        system = F.coalesce((F.get(rows, F.lit(0))["by"] == "K") & (F.get(rows, F.lit(0))["initial"] == "s"), F.lit(False)).cast("int")
        place = lambda i: F.when((i - system) % 2 == 0, "user").otherwise("assistant")
        return F.transform(rows, lambda t, i: F.struct(F.when(t["by"] == "K", t["role"]).otherwise(place(i)).alias("role"), t["text"].alias("text")))

    return bind(out, role)


def repair_chats(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row a conversation: counts of faults, the cheapest repair and its turns.

    ``rows`` has conv_id, turn, role and text; other columns don't matter. Rows for which ``present`` isn't true
    only name their conversation. Turns are taken by turn number, null ones first, then role, then text, so repeated
    rows come one after the other and ties have one order. Null roles and texts are empty; a role without a first
    character is never kept as it is. Rows without a conv_id are one conversation. An empty table gives no rows.

    Each turn has one fault at most: ``blank`` (white space only), ``duplicate`` (role and text seen earlier in the
    conversation), ``truncated`` (its last character but white space ends no sentence). Columns: gaps (numbers
    missing between the least and the greatest turn), blank, duplicate, truncated, illegal (neighbours whose initials
    aren't su, ua or au), cost, audit (initials of the edits Keep, Rerole, Delete, Insert in order; of the cheapest
    the one that sorts first), turns (role, text).

    One shuffle by conversation serves the windows and the fold. A conversation is in one task, as its audit and its
    turns are one value; the fold's state is four options, whatever its length.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    known = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), here.alias("here")
    ).repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    same = Window.partitionBy("conv_id", "here", "role", "text").orderBy("place")
    talk = Window.partitionBy("conv_id", "here").orderBy(*order)
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(talk), initial)
    faults = F.when(end == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~end.isin(*ENDS), "truncated").otherwise("")
    fresh = F.col("here") & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(talk))
    placed = known.withColumns({"place": F.row_number().over(talk), "fresh": fresh, "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})
    flagged = placed.withColumn("fault", faults).select(
        "conv_id", F.when(F.col("here"), F.col("turn")).alias("turn"), "here", "fault", "fresh", "illegal",
        F.struct("place", initial.alias("initial"), "fault", "role", "text").alias("row"),
    )
    count = lambda test: F.count(F.when(F.col("here") & test, 1))
    talks = flagged.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count(F.when(F.col("fresh"), 1)), F.lit(0)).cast("bigint").alias("gaps"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
        F.array_sort(F.collect_list(F.when(F.col("here"), F.col("row")))).alias("rows"),
    )
    best = talks.withColumn("best", cheapest(F.col("rows")))
    return best.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"),
        repaired(F.col("rows"), F.col("best.audit")).alias("turns"),
    )
