"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans.  Each span becomes a window: the system turn,
as many whole turns before the span as the history budget allows, and the span's own turns.  Only the assistant's own
turns of a span bear loss; what a window repeats is masked, so each target counts once.

A turn is written ``<|role|>text<|end|>`` and a line feed.  Inside roles and texts a backslash is put before each
backslash and into each control string, so no text can end or begin a turn; reading drops one backslash of each pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of this template and of others in use, each with the place of its backslash; fixed values.
CONTROL = r"(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])"
END = "<|end|>\n"
#: What counts as a token: up to six letters of a word, a digit, or up to three other signs; white space is free.
TOKEN = r"\p{L}{1,6}|\p{N}|[^\s\p{L}\p{N}]{1,3}"


@dataclass(frozen=True)
class Budget:
    #: Tokens of a window, of which so many may repeat earlier turns; see TOKEN.
    window: int = 1024
    history: int = 256


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\|<\[])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_windows(turns: DataFrame, budget: Budget | None = None) -> DataFrame:
    """``conv_id, window_id, text, loss_spans, repeated_turns, tokens, over_budget`` of each window.

    ``turns`` has ``conv_id, turn, role, text``; other columns are left out.  ``loss_spans`` are (start, size) in code
    points of ``text``; the first ``repeated_turns`` turns of it repeat earlier windows.  Turns are ordered by ``turn``,
    then role and text; repeated rows are turns of their own.  A null text or role is empty; null ids are one
    conversation.  Turns are never cut: a window is ``over_budget`` where single turns of over half its room force it, or a
    system turn of over three quarters of the room, beside which spans have a quarter.  A turn is copied to those windows
    that repeat it, and to no others.
    """
    budget = budget or Budget()
    room = max(1, budget.window - budget.history)
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    rows = rows.select("conv_id", "role", F.row_number().over(order).alias("i"), F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>")).alias("head"), escape(F.col("text")).alias("body"))
    size = tokens(F.col("head")) + tokens(F.col("body")) + tokens(F.lit(END))
    rows = rows.withColumn("is_system", (F.col("i") == 1) & (F.col("role") == "system")).withColumn("size", size)
    # the system turn is in each window: it takes room, not a place in the prefix sums
    rows = rows.withColumn("system", F.max(F.when(F.col("is_system"), F.col("size")).otherwise(0)).over(whole)).withColumn("size", F.when(F.col("is_system"), 0).otherwise(F.col("size")))
    rows = rows.withColumn("before", F.sum("size").over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    left = F.greatest(F.lit(-(-room // 4)), F.lit(room) - F.col("system"))
    stride = F.greatest(F.lit(1), F.ceil(left / 2), left - F.max("size").over(whole))
    rows = rows.withColumn("stride", stride).withColumn("span", F.floor(F.col("before") / F.col("stride")))
    # a turn is also history of the next spans with turns of their own that begin soon enough after it
    reached = F.collect_set("span").over(whole.orderBy("before").rangeBetween(0, budget.history))
    spans = F.when(F.col("is_system"), F.array("span")).otherwise(F.filter(reached, lambda s: s >= F.col("span")))
    rows = rows.withColumn("spans", spans)
    placed = rows.withColumn("at", F.explode("spans")).withColumn("new", F.col("at") == F.col("span"))
    own = F.struct("i", "before", "size", "new", "is_system", (F.col("role") == "assistant").alias("target"), "head", "body")
    windows = placed.groupBy("conv_id", F.col("at").alias("window_id")).agg(F.array_sort(F.collect_list(own)).alias("all"), F.min(F.when(F.col("new"), F.col("before"))).alias("begin"), F.max("system").alias("system"))
    windows = windows.withColumn("turns", F.filter("all", lambda t: t["new"] | (F.col("begin") - t["before"] <= budget.history)))
    first = rows.filter("is_system").select(F.col("conv_id").alias("system_conv"), F.concat("head", "body", F.lit(END)).alias("system_text"))
    windows = windows.join(first, F.col("conv_id").eqNullSafe(F.col("system_conv")), "left")
    retained = F.col("system_text").isNotNull() & ~F.exists("turns", lambda t: t["is_system"])
    lead = F.when(retained, F.col("system_text")).otherwise("")
    written = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    windows = windows.withColumn("lead", lead).withColumn("repeated_turns", F.size(F.filter("turns", lambda t: ~t["new"])) + F.when(retained, 1).otherwise(0))
    windows = windows.withColumn("text", F.concat("lead", F.array_join(F.transform("turns", written), "")))
    # where each turn begins: its predecessors' sizes, summed turn by turn
    begin = F.struct(F.length("lead").alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("found"))

    def step(state: Column, t: Column) -> Column:
        span = F.struct((state["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("size"))
        found = F.when(t["new"] & t["target"], F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct((state["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"), found.alias("found"))

    windows = windows.withColumn("loss_spans", F.aggregate("turns", begin, step, lambda s: s["found"]))
    windows = windows.withColumn("tokens", F.aggregate("turns", F.col("system").cast("long"), lambda a, t: a + t["size"]))
    return windows.select("conv_id", "window_id", "text", "loss_spans", "repeated_turns", "tokens", (F.col("tokens") > budget.window).alias("over_budget"))


def read_windows(windows: DataFrame) -> DataFrame:
    """The windows with ``turns``, (role, text) of what each adds, and ``loss``, the text under its mask, both read from ``text``."""
    parts = F.split("text", r"<\|end\|>\n")
    parts = F.slice(parts, F.col("repeated_turns") + 1, F.greatest(F.lit(0), F.size(parts) - 1 - F.col("repeated_turns")))
    head = lambda x: F.regexp_extract(x, r"(?s)^<\|((?:[^\\|]++|\\.)*+)\|>", 0)

    def turn(x: Column) -> Column:
        return F.struct(unescape(head(x).substr(F.lit(3), F.length(head(x)) - 4)).alias("role"), unescape(x.substr(F.length(head(x)) + 1, F.length(x))).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("text").substr(s["start"] + 1, s["size"]))), "")
    return windows.withColumn("turns", F.transform(parts, turn)).withColumn("loss", loss)


def chat_digests(windows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the windows.

    The digests need a conversation's text in one value; nothing else joins its windows.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_windows(windows).select("conv_id", "window_id", F.size("turns").alias("n"), said.alias("said"), "loss", F.length("text").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window_id", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    loss = F.array_join("w.loss", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
