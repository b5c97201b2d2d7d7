"""Chat formatting: conversations to token-budgeted training windows.

A turn is rendered as "### role: text</turn>" and a line feed. Prefix sums of
the turns' tokens cut a conversation into spans of whole turns; each span is a
window. Windows after the first repeat the system turn and as many of the last
turns as the history budget allows. Only assistant texts that are new in a
window are under its loss mask, so that each is a target once.

Texts are escaped so that no template mark can occur inside them: a backslash
becomes \\s, a # that two more follow \\h, and the < of </turn> \\l. unescape()
undoes it exactly.

Nulls and ties. A null text or role is empty; a null conv_id is a conversation.
Turns go by (turn, role, text), a null turn first; repeated rows are turns of
their own. A turn longer than the budget is a window by itself, never cut. An
empty table gives no windows. Other columns are ignored. Turns of one
conversation meet in one task, since its windows are made of its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
HISTORY_TURNS = 4
END = "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.regexp_replace(F.regexp_replace(text, "#(?=##)", r"\\h"), "<(?=/turn>)", r"\\l")


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def turn_tokens(text: Column) -> Column:
    """The default estimate: a token for every four characters, and four for the marks."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, tokens=turn_tokens) -> DataFrame:
    """conv_id, window, text, n_turns (new ones), n_repeated (turns repeated at the
    window's start), n_tokens, loss (array of start and length in text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "__role", "__raw").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("__role"), F.coalesce("text", F.lit("")).alias("__raw"))
    rows = rows.withColumn("x", escape(F.col("__raw"))).withColumn("head", F.concat(F.lit("### "), _role(F.col("__role")), F.lit(": ")))
    rows = rows.withColumn("r", F.concat("head", "x", F.lit(END))).withColumn("t", tokens(F.col("x")))
    # t0, c0: tokens and characters before the turn
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("t0", F.sum("t").over(order) - F.col("t")).withColumn("c0", F.sum(F.length("r")).over(order) - F.length("r"))
    piece = F.struct("n", "t", "t0", "c0", F.length("head").alias("h"), F.length("x").alias("k"), "r", (F.col("__role") == "assistant").alias("goal"), (F.col("__role") == "system").alias("sys"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("ts"))
    convs = convs.withColumn("s0", F.when(F.col("ts")[0]["sys"], 1).otherwise(0)).withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.col("s0") * F.col("ts")[0]["t"]))
    # spans: the number of the first turn of each, counted from 1
    starts = F.expr("""aggregate(slice(ts, s0 + 1, size(ts)), named_struct('a', cast(array() as array<int>), 'base', 0L),
        (s, p) -> if(size(s.a) = 0 or p.t0 + p.t - s.base > room, named_struct('a', concat(s.a, array(p.n)), 'base', p.t0), s), s -> if(size(s.a) = 0, array(s0 + 1), s.a))""")
    convs = convs.withColumn("a", starts)
    spans = convs.select("conv_id", "ts", "s0", F.size("a").alias("w_n"), F.posexplode("a").alias("w", "first"), F.col("a").alias("a"))
    spans = spans.withColumn("last", F.when(F.col("w") + 1 < F.col("w_n"), F.expr("get(a, w + 1) - 1")).otherwise(F.size("ts"))).drop("a")
    # back: how many of the turns before the span are repeated
    fits = " + ".join(f"if(w > 0 and first - {k} > s0 and get(ts, first - 1).t0 - get(ts, first - 1 - {k}).t0 <= {history}, 1, 0)" for k in range(1, history_turns + 1)) or "0"
    spans = spans.withColumn("back", F.expr(fits))
    spans = spans.withColumn("lead", F.expr("if(w > 0 and s0 = 1, length(get(ts, 0).r), 0)")).withColumn("from", F.expr("if(w = 0, 1, first - back)"))
    body = F.expr("array_join(transform(slice(ts, from, last - from + 1), p -> p.r), '')")
    text = F.concat(F.expr("if(lead > 0, get(ts, 0).r, '')"), body)
    loss = F.expr("transform(filter(slice(ts, if(w = 0, 1, first), last - if(w = 0, 1, first) + 1), p -> p.goal), p -> named_struct('start', cast(lead + p.c0 - get(ts, from - 1).c0 + p.h as int), 'length', cast(p.k as int)))")
    n_tokens = F.expr("if(lead > 0, get(ts, 0).t, 0L) + if(last >= from, get(ts, last - 1).t0 + get(ts, last - 1).t - get(ts, from - 1).t0, 0L)")
    return spans.select(
        "conv_id", F.col("w").alias("window"), text.alias("text"), F.expr("last - if(w = 0, 1, first) + 1").alias("n_turns"), F.expr("if(w > 0, s0 + back, 0)").alias("n_repeated"), n_tokens.alias("n_tokens"), loss.alias("loss")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and targets (all text under the loss
    mask, unescaped), read from the windows' texts alone."""
    marks = F.slice(F.split("text", END, -1), F.col("n_repeated") + 1, F.col("n_turns"))
    colon = lambda m: F.position(F.lit(": "), m)  # noqa: E731  the first one ends the role
    decode = lambda m: F.struct(unescape(F.replace(F.substr(m, F.lit(5), colon(m) - 5), F.lit("\\c"), F.lit(":"))).alias("role"), unescape(F.substr(m, colon(m) + 2)).alias("text"))
    targets = F.array_join(F.transform("loss", lambda p: unescape(F.substr(F.col("text"), p["start"] + 1, p["length"]))), "")
    each = windows.select("conv_id", F.struct("window", F.transform(marks, decode).alias("turns"), targets.alias("targets")).alias("x"), F.length("text").alias("c"))
    gathered = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"), F.sum("c").alias("formatted_chars"))
    return gathered.select("conv_id", F.flatten(F.transform("x", lambda w: w["turns"])).alias("turns"), F.array_join(F.transform("x", lambda w: w["targets"]), "").alias("targets"), "formatted_chars")
