r"""Chat formatting in budgeted windows, in DataFrame operations only.

A turn is written as <|role|>text</s>. Inside texts a backslash is doubled and the control strings <| </s> [INST] [/INST] get one
after their first character; removing the backslash before any character undoes both.

A window holds the system turn, history and fresh turns, within the budget of tokens altogether. What the system turn and the history
leave is the room for fresh turns. Prefix sums of the turns' tokens cut a conversation into cells: a turn lies in the cell in which it
starts, and cells are as long as the room less the longest turn, so that what starts in a cell fits. A turn of over half the room is a window by
itself and parts its cell. So windows are whole turns, and only one turn that is over the room by itself can exceed the budget. A window
repeats the system turn and then the turns before it that start within the history budget, or within what its fresh turns leave of the
budget. Only fresh assistant texts are under the loss mask, so every one is a target once. Prefix sums are taken in two steps,
over blocks of turns and within a block, so that a long conversation is not summed by one task; turns are written once with their window.

Defined results: null text or role counts as empty; turns are ordered by turn (nulls first), role, text, so repeated rows and ties have a
fixed order; a turn over the room is kept whole, in a window of its own; a system turn that leaves no room is retained, and every other turn is a
window; a null conv_id is a conversation of its own; an empty table gives an empty result; other columns are not read.
read_back() puts each conversation's texts into one row, as their digests ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planar.llm.common import WORD, stored

BUDGET, HISTORY, TURN_TOKENS, BLOCK_TURNS = 2048, 512, 4, 512
#: role and text of a turn in the formatted string.
TURN = r"(?s)<\|((?:[^|\\]|\\.)*+)\|>(.*?)</s>"


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, r"<(?=\||/s>)", r"<\\")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"[\\")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), r"(?<!<\\)\|", r"\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def numbered(turns: DataFrame, block_turns: int) -> DataFrame:
    """Turns with their ordinal, the tokens before them (`start`), and of their conversation the tokens of its system turn and of its longest other turn."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    t = turns.select("conv_id", key.alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(WORD)) + TURN_TOKENS).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**62))))
    within = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("place", F.row_number().over(within) - 1)
    t = t.withColumn("inner", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    first_system = F.max(F.when((F.col("place") == 0) & (F.col("role") == "system"), F.col("tokens")))
    longest = F.max(F.when((F.col("place") > 0) | (F.col("role") != "system"), F.col("tokens")))
    blocks = t.groupBy("key", "block").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows"), first_system.alias("first_system"), longest.alias("longest"), F.max("tokens").alias("most"))
    along = Window.partitionBy("key").orderBy("block")
    before, whole = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A block after the first may begin with a turn of the role system that is none for the conversation.
    other = F.when(F.row_number().over(along) == 1, F.col("longest")).otherwise(F.col("most"))
    blocks = blocks.withColumn("other", other).select(
        "key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.first("first_system").over(whole), F.lit(0)).alias("system_tokens"), F.coalesce(F.max("other").over(whole), F.lit(0)).alias("longest"),
    )
    t = t.join(blocks, ["key", "block"]).withColumn("ordinal", F.col("first") + F.col("place"))
    system = (F.col("ordinal") == 0) & (F.col("system_tokens") > 0)
    start = F.when(system, F.lit(0)).otherwise(F.col("base") + F.col("inner") - F.col("system_tokens"))
    return t.select("conv_id", "key", "ordinal", "role", "text", "tokens", "system_tokens", "longest", system.alias("system"), start.alias("start"))


def assigned(turns: DataFrame, budget: int, history: int, block_turns: int) -> DataFrame:
    """Turns, formatted, with the ordinal of the first turn of the window in which they are fresh."""
    t = numbered(turns, block_turns)
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("system_tokens"))
    room = F.greatest(F.lit(1), left - F.least(F.lit(history), F.floor(left / 2)))
    t = t.withColumn("half", F.floor(room / 2)).withColumn("step", F.greatest(F.lit(1), room - F.least(F.col("longest"), F.floor(room / 2))))
    t = t.withColumn("cell", F.floor(F.col("start") / F.col("step"))).withColumn("big", ~F.col("system") & (F.col("tokens") > F.col("half")))
    along = Window.partitionBy("key", "cell").orderBy("ordinal")
    large = F.col("big").cast("int")
    t = t.withColumn("part", 2 * (F.sum(large).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - large) + large)
    t = t.withColumn("part", F.when(F.col("system"), F.coalesce(F.lead("part").over(along), F.lit(0))).otherwise(F.col("part")))
    t = t.withColumn("window", F.min("ordinal").over(Window.partitionBy("key", "cell", "part")))
    head = F.concat(F.lit("<|"), escaped_role(F.col("role")), F.lit("|>"))
    fresh = F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens"))
    return t.select("conv_id", "key", "ordinal", "start", "window", "system", "system_tokens", fresh.alias("tokens"), (F.col("role") == "assistant").alias("target"), head.alias("head"), escaped(F.col("text")).alias("body"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, window (the ordinal of its first fresh turn), formatted, repeated (turns at its start that earlier windows had) and loss
    (spans: first code point from 1, code points)."""
    t = stored(assigned(turns, budget, history, block_turns), "chat-turns")
    begin = F.min(F.when(~F.col("system"), F.col("start")))
    each = t.groupBy("key", "window").agg(begin.alias("begin"), F.sum("tokens").alias("fresh"), F.first("system_tokens").alias("system_tokens"), F.max("system").alias("with_system"))
    each = each.withColumn("allowed", F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("system_tokens") - F.col("fresh"))))
    # A turn is repeated by windows that begin within the history budget behind its start: in its own or the next stretch of that length.
    stretch = lambda at: F.floor(at / max(history, 1))
    asked = each.where("begin > 0 AND allowed > 0").select("key", F.col("window").alias("later"), "begin", "allowed", F.explode(F.array(stretch(F.col("begin")), stretch(F.col("begin")) - 1)).alias("stretch"))
    columns = ("key", "ordinal", "target", "head", "body")
    again = t.where("NOT system").withColumn("stretch", stretch(F.col("start"))).join(asked, ["key", "stretch"])
    again = again.where("ordinal < later AND begin - start <= allowed").select("conv_id", *columns, F.col("later").alias("window"), F.lit(True).alias("again"))
    system = t.where("system").select("conv_id", *columns).join(each.where("NOT with_system").select("key", "window"), "key").withColumn("again", F.lit(True))
    rows = t.select("conv_id", *columns, "window", F.lit(False).alias("again")).unionByName(again).unionByName(system)
    before = Window.partitionBy("key", "window").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + 4
    rows = rows.withColumn("at", F.sum(size).over(before) - size)
    span = F.when(F.col("target") & ~F.col("again"), F.struct((F.col("at") + F.length("head") + 1).cast("int").alias("first"), F.length("body").alias("length")))
    turn = F.struct("ordinal", F.concat("head", "body", F.lit("</s>")).alias("turn"), span.alias("span"))
    made = rows.groupBy("key", "window").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"), F.count_if("again").alias("repeated"))
    return made.select("conv_id", "window", F.array_join("turns.turn", "").alias("formatted"), F.col("repeated").cast("int").alias("repeated"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of each conversation, from the formatted windows alone."""
    fresh = lambda group: F.expr(f"slice(regexp_extract_all(formatted, pattern, {group}), repeated + 1, 2147483647)")
    w = formatted.withColumn("pattern", F.lit(TURN)).withColumn("turns", F.arrays_zip(fresh(1).alias("r"), fresh(2).alias("t")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(unescaped(x["r"]), F.lit("\n"), unescaped(x["t"]), F.lit("\n"))), "")
    under = F.array_join(F.transform("loss", lambda s: unescaped(F.substring("formatted", s["first"], s["length"]))), "")
    w = w.select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), under.alias("under"), F.length("formatted").alias("chars"))
    per = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "under"))).alias("all"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    join = lambda c: F.array_join(F.col("all")[c], "")
    return per.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(join("said"), 256).alias("turns_sha256"), F.length(join("under")).cast("long").alias("loss_chars"), F.sha2(join("under"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_windows")
