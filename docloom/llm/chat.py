"""Chat formatting from an event log, in DataFrame functions only.

Events of a conversation, in the order of their sequence number, build its messages:
`add` starts a message or appends a streamed delta to it, `edit` replaces what it held, `regenerate`
empties it for the deltas that follow, `delete` removes it until something is added again. The fold is a window: a message's
text is what was added since its last reset, in order. Messages stand in the order of their first
event. The template marks each turn, and control strings inside texts are escaped so that the output
can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each turn is OPEN role NEXT text CLOSE newline.
OPEN, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common templates; their first character is kept and a backslash put after it.
CONTROL = (OPEN, NEXT, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join("\\Q" + c[1:] + "\\E" for c in CONTROL)
_HEADS = "[<\\[]"


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of every control string."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_HEADS})(?={_REST})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the final messages of events (conv_id, seq, message, op, role, text).

    Null op counts as add, null text as empty, null role as the empty role; a message's role and place
    are those of its first event. Ties in seq are ordered by message, op, role and text, so equal logs
    give equal messages; rows repeated in the log are events of their own. Rows without conv_id make one
    conversation with a null id. All steps share one exchange on conv_id.
    """
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("message").cast("string").alias("message"), F.coalesce("op", F.lit("add")).alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "message", "op", "role", "text")))
    message = Window.partitionBy("conv_id", "message")
    reset = F.max(F.when(F.col("op").isin("edit", "regenerate", "delete"), F.col("at"))).over(message)
    first = F.min(F.struct("at", "role")).over(message)
    e = e.withColumns({"reset": F.coalesce(reset, F.lit(0)), "first": first}).where(F.col("at") >= F.col("reset"))
    part = F.when(F.col("op").isin("regenerate", "delete"), F.lit("")).otherwise(F.col("text"))
    live = F.max(F.when(F.col("op") != "delete", 1).otherwise(0)).alias("live")
    m = e.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("part")))).alias("parts"), F.min("first").alias("first"), live)
    return m.where("live = 1").select("conv_id", F.col("first.at").alias("place"), F.col("first.role").alias("role"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: the loss role's escaped texts, each by turn (from 0), place in its turn, start and size, in code points.

    The start counts from the output's beginning, the place from the turn's, so that a reader need not
    look through the output for every span.
    """
    text, role = escape(F.col("text")), escape(F.col("role"))
    head = F.concat(F.lit(OPEN), role, F.lit(NEXT))
    m = messages.select("conv_id", "place", head.alias("head"), text.alias("body"), (F.col("role") == loss_role).alias("loss"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(CLOSE + "\n")))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head")
    at = F.length("head").alias("at")
    m = m.select("conv_id", F.struct("place", "piece", "loss", start.alias("start"), at, F.length("body").alias("size")).alias("turn"))
    turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    span = lambda t, i: F.struct(t["loss"].alias("loss"), i.alias("turn"), t["at"].alias("at"), t["start"].alias("start"), t["size"].alias("size"))
    spans = F.transform(F.filter(F.transform("turns", span), lambda t: t["loss"]), lambda t: F.struct(t["turn"].alias("turn"), t["at"].alias("at"), t["start"].alias("start"), t["size"].alias("size")))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts, formatted: what the output says, unescaped. The work grows with the output's length."""
    pieces = F.transform(F.slice(F.split("formatted", "\\Q" + OPEN + "\\E"), 2, 1 << 30), lambda t: F.concat(F.lit(OPEN), t))
    turn = lambda t: F.struct(unescape(F.substring_index(F.substring_index(t, NEXT, 1), OPEN, -1)).alias("role"), unescape(F.substring_index(F.substring_index(t, NEXT, -1), CLOSE, 1)).alias("text"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("pieces", s["turn"]), s["at"] + 1, s["size"])))
    return formatted.withColumn("pieces", pieces).select("conv_id", F.transform("pieces", turn).alias("turns"), loss.alias("loss_texts"), "formatted")


def digest(back: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def conversations_as_events(rows: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, text) as one added message; rows with equal turns are ordered by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "seq", F.format_string("%019d", "seq").alias("message"), F.lit("add").alias("op"), "role", "text")
