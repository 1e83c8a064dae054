"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into windows at turns: a turn belongs to the window in whose stride its
prefix sum falls, a turn longer than a stride has a window of its own. Each window shows the system turn again, then
the last turns of the window before it that fit the history allowance, then its own turns. The loss mask covers the
assistant texts of a window's own turns, so that each is a target once; what is repeated is masked.

Sums are taken in two levels (blocks of BLOCK turn numbers, then blocks), and windows are grouped by conversation and
first prefix sum, so that a long conversation is spread over tasks by its turn numbers (turns that share one number
share a block); a task holds one window at a time. A text of any length is one turn, in a window of its own.

A window holds at most `budget` tokens: system turn, history and twice the stride. Only a system turn of over a
quarter of the budget, or a turn of over a stride, can make its window larger, as turns are never cut.

Texts are escaped: a backslash is doubled and one is put between the characters that begin a control string, so that
no text holds one; taking each backslash away with what it guards gives the text back.

Defined results: null roles and texts are empty; null turn numbers come first; equal turn numbers are ordered by role,
then text; a conversation with a null id is one conversation; repeated rows are turns of their own; an empty table has
no windows; results have columns of their own, and columns besides the four are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET, HISTORY, BLOCK = 512, 96, 64
#: Tokens of a turn's marks.
MARKS = 4
START, END = "<|im_start|>", "<|im_end|>\n"
#: A token is a run of letters and digits or another character that isn't white space.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF} \t\n\r\f\x0B]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)) + MARKS


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, first (the prefix sum at which a window begins), formatted, spans and tokens of every window.

    A span has the places of a turn's role and text in `formatted` (from 0, in code points), whether the turn is the
    window's own, and whether its text is under the loss mask.
    """
    base = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("turn") / BLOCK).alias("block")
    ).withColumn("n", token_count(F.col("text")).cast("long"))
    order = ["turn", "role", "text"]
    within = W.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    is_system = F.col("role") == "system"
    blocks = placed.groupBy("conv_id", "block").agg(F.sum("n").alias("sum"), F.min(F.when(is_system, F.struct("turn", "role", "text", "n", "inner"))).alias("sys"))
    earlier = W.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    blocks = blocks.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    system = F.min(F.when(F.col("sys").isNotNull(), F.struct("before", "sys"))).over(whole)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before", system.alias("sys"))
    joined = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    from_ = F.col("before") + F.col("inner")
    system_n = F.coalesce(F.least(F.col("sys.sys.n"), F.lit(budget // 4)), F.lit(0))
    stride = F.greatest(F.floor((F.lit(budget - history) - system_n) / 2), F.lit(1))
    keyed = joined.select("conv_id", "role", "text", "n", from_.alias("p"), stride.alias("stride"), F.struct((F.col("sys.before") + F.col("sys.sys.inner")).alias("p"), F.col("sys.sys.n").alias("n"), F.col("sys.sys.text").alias("text")).alias("sys")).withColumn(
        "key", 2 * F.floor(F.col("p") / F.col("stride")) + F.when(F.col("n") > F.col("stride"), 1).otherwise(0)
    )
    own = W.partitionBy("conv_id", "key")
    cut = keyed.withColumn("first", F.min("p").over(own)).withColumn("last", F.max(F.col("p") + F.col("n")).over(own))
    fresh = F.struct(F.col("first"), F.lit(True).alias("own"))
    repeated = F.when(F.col("last") - F.col("p") <= history, F.struct(F.col("last").alias("first"), F.lit(False).alias("own")))
    shown = cut.select("conv_id", F.explode(F.array_compact(F.array(fresh, repeated))).alias("in"), "p", "n", "role", "text", "sys")
    # one row of a window brings the system turn along
    leads = F.col("in.own") & (F.col("p") == F.col("in.first")) & F.col("sys.p").isNotNull()
    grouped = shown.groupBy("conv_id", F.col("in.first").alias("first")).agg(
        F.array_sort(F.collect_list(F.struct("p", F.col("in.own").alias("own"), "n", "role", "text"))).alias("turns"), F.max(F.when(leads, F.col("sys"))).alias("sys")
    )
    kept = grouped.where(F.exists("turns", lambda x: x["own"]))
    again = F.struct(F.col("sys.p").alias("p"), F.lit(False).alias("own"), F.col("sys.n").alias("n"), F.lit("system").alias("role"), F.col("sys.text").alias("text"))
    needs = F.col("sys").isNotNull() & ~F.exists("turns", lambda x: x["p"] == F.col("sys.p"))
    all_turns = F.when(needs, F.concat(F.array(again), F.col("turns"))).otherwise(F.col("turns"))
    written = F.transform(all_turns, lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"), x["own"].alias("own"), (x["own"] & (x["role"] == "assistant")).alias("loss"), x["n"].alias("n")))
    made = kept.select("conv_id", "first", written.alias("w"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role_at:int,role_len:int,text_at:int,text_len:int,own:boolean,loss:boolean>>").alias("spans"))

    def place(a: Column, x: Column) -> Column:
        role_at = a["at"] + len(START)
        text_at = role_at + F.length(x["role"]) + 1
        span = F.struct(role_at.alias("role_at"), F.length(x["role"]).alias("role_len"), text_at.alias("text_at"), F.length(x["text"]).alias("text_len"), x["own"].alias("own"), x["loss"].alias("loss"))
        return F.struct((text_at + F.length(x["text"]) + len(END)).alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    return made.select(
        "conv_id",
        "first",
        F.array_join(F.transform("w", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END))), "").alias("formatted"),
        F.aggregate("w", empty, place, lambda a: a["spans"]).alias("spans"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and targets of every conversation, read from its windows: n_turns, turns, loss and formatted_chars.

    Each is one row, so a conversation's text has to fit one task here; `windows` itself has no such need.
    """
    own = F.filter("spans", lambda s: s["own"])

    def cut(at: str, size: str):
        return lambda s: unescape(F.substring(F.col("formatted"), s[at] + 1, s[size]))

    turns = F.array_join(F.transform(own, lambda s: F.concat(cut("role_at", "role_len")(s), F.lit("\n"), cut("text_at", "text_len")(s), F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("spans", lambda s: s["loss"]), cut("text_at", "text_len")), "")
    parts = formatted.select("conv_id", "first", F.size(own).cast("long").alias("n"), turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("first", "turns", "loss"))).alias("all"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.array_join("all.turns", "").alias("turns"), F.array_join("all.loss", "").alias("loss"), "formatted_chars")
