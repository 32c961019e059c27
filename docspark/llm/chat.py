"""Chat formatting from event logs, with a loss mask, reversibly.

A log holds events of messages: `delta` appends to a message, `edit` replaces what it has, `regenerate`
drops it so that the following deltas make it anew. Events are folded per message, messages are rendered
per run of BLOCK message numbers of a conversation, and these parts are joined to the conversation; so a
long conversation is not folded row by row in one task, and what meets in the end is one part per block.
Everything is DataFrame work.

The template writes `<|im_start|>role\\ntext<|im_end|>\\n` for each message. Control strings inside texts, its
own and other templates', get a backslash behind their first character, and those that have one get
one more; `unescape` takes it away again. The loss mask holds spans of the formatted text, in code points.

Defined cases: a null text is empty, a null role is the empty role; unknown kinds of events count as
deltas; events of one message with the same sequence number go by kind, then text; a null conversation id
is a conversation, a null message number the first message; an empty log gives an empty result; other
columns are not read. One conversation must fit in a row (2 GB), as its rendering is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<|im_start|>"
END = "<|im_end|>"
#: Control strings of common chat templates. All begin with `<` or `[`.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Message numbers that are rendered together.
BLOCK = 512
TRAINED_ROLE = "assistant"

_TAILS = "|".join("".join("\\" + c if c in "|[]" else c for c in s[1:]) for s in CONTROL)
#: A control string after any number of backslashes behind its first character.
ESCAPABLE = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role on one line."""
    line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(line)


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, part, role, text) of a log (conv_id, message, part, seq, kind, role, text).

    `part` tells messages apart that the log has under one number. The role is the last one given.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy("conv_id", "message", "part").agg(F.sort_array(F.collect_list(event)).alias("log"))
    resets = F.transform(F.col("log"), lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(-1))
    log = log.withColumn("reset", F.array_max(resets))
    live = F.filter("log", lambda e, i: (i >= F.col("reset")) & ~(e["kind"].eqNullSafe("regenerate")))
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    return log.select(
        "conv_id", "message", "part", F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def _place(items: Column, is_trained, length) -> Column:
    """Spans of the trained texts of rendered items, counted from the first item's begin."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc, item):
        span = F.struct((acc["at"] + item["head"]).alias("start"), item["body"].alias("length"))
        spans = F.when(is_trained(item), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + length(item)).alias("at"), spans.alias("spans"))

    return F.aggregate(items, zero, step, lambda acc: acc["spans"])


def render(messages: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) of every conversation; loss is an array of spans (start, length)."""
    body, role = escape(F.col("text")), _escape_role(F.col("role"))
    tail = END + "\n"
    lines = messages.select(
        "conv_id", F.floor(F.col("message") / BLOCK).alias("block"), "message", "part", "role",
        F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(tail)).alias("line"),
        (F.char_length(role) + len(START) + 1).cast("long").alias("head"), F.char_length(body).cast("long").alias("body"),
    )
    item = F.struct("message", "part", "line", "head", "body", (F.col("role") == trained_role).alias("trained"))
    blocks = lines.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))
    blocks = blocks.select(
        "conv_id", "block", F.size("items").cast("long").alias("n"),
        F.array_join(F.transform("items", lambda x: x["line"]), "").alias("formatted"),
        _place(F.col("items"), lambda x: x["trained"], lambda x: x["head"] + x["body"] + len(tail)).alias("spans"),
    )
    piece = F.struct("block", "formatted", "spans", F.char_length("formatted").cast("long").alias("length"))
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    shifted = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["length"]).alias("at"),
            F.concat(
                acc["spans"],
                F.transform(p["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length"))),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return whole.select(
        "conv_id", "n_turns", F.array_join(F.transform("pieces", lambda p: p["formatted"]), "").alias("formatted"), shifted.alias("loss")
    )


def turns(formatted: Column) -> Column:
    """The messages (role, text) read back from a rendering."""
    lines = F.split(formatted, r"<\|im_end\|>\n", -1)
    lines = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))

    def read(line):
        brk = F.instr(line, "\n")
        role = F.substr(line, F.lit(len(START) + 1), brk - len(START) - 1)
        text = F.substr(line, brk + 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(lines, read)


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
