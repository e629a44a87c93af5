"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans, the system turn is retained,
limited history is repeated, and only new targets stand under the loss mask. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, and how many of them repeated history may take.
BUDGET, HISTORY = 1024, 256
#: Tokens that a turn's marks and role count.
OVERHEAD = 4
#: Turn numbers of a conversation whose sums are made in one task; sums of these blocks are then added up.
BLOCK = 256
#: ``%`` stands for itself as ``%25``, so what these put in can be told apart from a text that already holds it.
ESCAPES = [("%", "%25"), ("<|", "%3C|"), ("\n", "%0A")]


#: Code points that count as one token at least, so a text without blanks isn't one token.
LETTERS = 4


def token_count(text: Column) -> Column:
    """Words, or code points over ``LETTERS``, whichever is more."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.ceil(F.char_length(text) / LETTERS))


def escape(text: Column, newlines: bool = False) -> Column:
    for plain, coded in ESCAPES if newlines else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, newlines: bool = False) -> Column:
    for plain, coded in reversed(ESCAPES if newlines else ESCAPES[:-1]):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def plan_spans(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=token_count) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with ``pos`` (from 1, in the order of turn, role and text), ``n_turns``,
    ``is_system`` (the first turn, if it has that role), ``tokens``, the span's ``first`` and ``last`` position, and ``after``, the tokens from this turn to
    the span's end.

    A turn longer than half of what a window may hold besides history and the system turn is a span of its own. A cell is
    what a window may hold less the conversation's longest other turn. A turn belongs to the cell in which its prefix sum starts; so a span
    nearly fills a window and never goes beyond it unless a single turn does. Sums are made per block of turn numbers and then over the
    blocks, so a conversation with very many turns is not one task; spans do not end with a block."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", (tokens(F.col("text")) + OVERHEAD).cast("bigint")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_pos", F.row_number().over(inside)).withColumn("_before", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    blocks = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum"), F.max(F.when((F.col("_pos") == 1) & (F.col("role") == "system"), F.col("tokens"))).alias("system"))
    order = Window.partitionBy("conv_id").orderBy("block")
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pos0"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"),
        F.sum("n").over(all_of).alias("n_turns"), F.first("system").over(all_of).alias("system"),
    )
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block"))).select(
        "conv_id", "turn", "role", "text", "tokens", (F.col("pos0") + F.col("_pos")).alias("pos"), (F.col("sum0") + F.col("_before")).alias("before"), "n_turns",
        F.coalesce("system", F.lit(0)).alias("system"), "block",
    )
    t = t.withColumn("room", F.greatest(F.lit(budget - history) - F.col("system"), F.lit(max(2, budget // 4))))
    t = t.withColumn("alone", (F.col("tokens") * 2 > F.col("room")).cast("int"))
    longest = t.groupBy("conv_id", "block").agg(F.max(F.when(F.col("alone") == 0, F.col("tokens"))).alias("longest"))
    longest = longest.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.coalesce(F.max("longest").over(Window.partitionBy("conv_id")), F.lit(0)).alias("longest"))
    t = t.join(longest, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block"))).drop("_conv", "_block")
    t = t.withColumn("cell", F.floor(F.col("before") / (F.col("room") - F.col("longest"))))
    span = Window.partitionBy("conv_id", "cell").orderBy("pos")
    # within a cell, turns after a long one are another span than those before it
    t = t.withColumn("run", F.coalesce(F.sum("alone").over(span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy("conv_id", "cell", "run", "alone").orderBy("pos")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.select(
        "conv_id", "turn", "role", "text", "tokens", "pos", "n_turns", ((F.col("pos") == 1) & (F.col("role") == "system")).alias("is_system"),
        F.min("pos").over(every).alias("first"), F.max("pos").over(every).alias("last"), F.sum("tokens").over(whole.rowsBetween(0, Window.unboundedFollowing)).alias("after"),
    )


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=token_count) -> DataFrame:
    """One row per window: ``conv_id``, ``window`` (position of its first new turn), ``formatted``, ``loss`` (start and
    length in code points of each new assistant text as it stands there), ``n_repeated`` (turns at the front that earlier windows had), ``n_tokens``
    and ``over_budget``.

    Every turn is new in exactly one window. The system turn opens every window; the last turns of the span before, up
    to ``history`` tokens, follow it, and their texts are not under the mask again. Marks inside texts and roles are
    escaped. Null texts and roles count as empty, null conversations as one conversation; repeated rows are turns like any other."""
    t = plan_spans(turns, budget, history, tokens)
    again = (F.col("after") <= history) & (F.col("last") < F.col("n_turns")) & ~F.col("is_system")
    body = ["role", "text", "tokens", "pos"]
    own = t.select("conv_id", *body, F.explode(F.filter(F.array(F.struct(F.col("first").alias("window"), F.lit(True).alias("new")), F.when(again, F.struct((F.col("last") + 1).alias("window"), F.lit(False).alias("new")))), lambda x: x.isNotNull())).alias("w"))
    own = own.select("conv_id", "w.window", "w.new", *body)
    later = t.where((F.col("pos") == F.col("first")) & (F.col("first") > 1)).select("conv_id", F.col("first").alias("window"))
    system = t.where("is_system").select(F.col("conv_id").alias("_conv"), *body)
    kept = later.join(system, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "window", F.lit(False).alias("new"), *body)
    rows = own.unionByName(kept).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "role", "text", "tokens"))).alias("turns"))
    rows = rows.withColumn("turns", F.transform("turns", lambda x: F.struct(x.new.alias("new"), x.role.alias("role"), x.tokens.alias("tokens"), F.concat(F.lit(START), escape(x.role, True), F.lit("\n")).alias("head"), escape(x.text).alias("body"))))
    tail = F.lit(END + "\n")
    nothing = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start, size = acc.at + F.char_length(x.head), F.char_length(x.body).cast("bigint")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END) + 1).alias("at"), F.when(x.new & (x.role == "assistant"), F.concat(acc.loss, span)).otherwise(acc.loss).alias("loss"))

    return rows.select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda x: F.concat(x.head, x.body, tail)), "").alias("formatted"),
        F.aggregate("turns", F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("loss")), step).loss.alias("loss"),
        F.size(F.filter("turns", lambda x: ~x.new)).alias("n_repeated"), F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, x: a + x.tokens).alias("n_tokens"),
    ).withColumn("over_budget", F.col("n_tokens") > budget)


def read_windows(windows: DataFrame) -> DataFrame:
    """Each window's new turns and loss texts, unescaped, read from ``formatted``, ``loss`` and ``n_repeated`` alone:
    ``conv_id, window, turns(role, text), loss_texts, formatted_chars``."""
    parts = F.split("formatted", F.lit(r"<\|im_start\|>"), -1)
    new = F.slice(parts, F.col("n_repeated") + 2, F.size(parts))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.char_length(role) + 2, F.char_length(x) - F.char_length(role) - len(END) - 2)
        return F.struct(unescape(role, True).alias("role"), unescape(body).alias("text"))

    return windows.select(
        "conv_id", "window", F.transform(new, turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))).alias("loss_texts"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def conversation_digests(read: DataFrame) -> DataFrame:
    """Counts and digests per conversation. A digest is over one text, so this last step alone needs a conversation whole."""
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    each = read.select("conv_id", "window", F.size("turns").alias("n"), lines.alias("lines"), F.array_join("loss_texts", "").alias("loss"), "formatted_chars")
    per = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "lines", "loss"))).alias("w"), F.sum("formatted_chars").alias("formatted_chars"))
    per = per.withColumn("lines", F.array_join("w.lines", "")).withColumn("loss", F.array_join("w.loss", ""))
    return per.select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.sha2("lines", 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
