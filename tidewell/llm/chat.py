"""Chat formatting into budgeted windows.

A turn is rendered ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings
inside a text or role get a backslash after their first character, and those
that have backslashes there already get one more, so reading back takes one
away and every text survives.

A turn's tokens are counted as the UTF-8 bytes of its rendered, escaped form: no
byte-level tokenizer makes more tokens than that, so a budget holds whichever
is used after.  Running sums of them, over the turns in order, choose the spans.
A window is, in this order, the first system turn, repeated turns of history,
and a span; together they hold at most BUDGET:

* A system turn of at most SYSTEM is repeated before every later span; a longer
  one is shown in its own span only.
* A span has what BUDGET leaves beside HISTORY and the system turn.  A turn over
  half of that stands alone; the turns between two such are cut where their
  running sum passes a multiple of half.
* Up to HISTORY_TURNS turns right before the span are repeated as far as they
  hold at most HISTORY, and what the window has left.
* So only a window of one turn that is itself longer than BUDGET exceeds it, and
  that window repeats nothing.

The loss mask is over the assistant texts of the span; repeated turns are
masked, so each assistant text is a target once.

Everything is DataFrame operations: window functions over a conversation,
which spill, and aggregation of a window's turns, which the budget bounds.  The
digests of a whole conversation put its texts into one row (2 GB at most).

Defined results: null text is empty; a null or other role is kept as a string
("" if null) and is no target; turns with one number are ordered by role and
text; null turns come first; repeated rows are turns; a null conv_id is a
conversation; an empty table gives no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 8192
HISTORY = 2048
SYSTEM = 2048
HISTORY_TURNS = 2
START, END = "<|im_start|>", "<|im_end|>\n"

# The control strings of common chat templates, after their first character.
CONTROL = (
    r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", r"\|system\|>", r"\|user\|>", r"\|assistant\|>",
    r"\|begin_of_text\|>", r"\|eot_id\|>", r"\|start_header_id\|>", r"\|end_header_id\|>",
    r"/?s>", r"/?INST\]", r"/?SYS>>",
)
_CONTROL = rf"([<\[])(\\*)({'|'.join(CONTROL)})"
_ESCAPED = rf"([<\[])\\(\\*)({'|'.join(CONTROL)})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def spans(turns: DataFrame, budget: Column) -> DataFrame:
    """turns (conv_id, at, tokens ...) with the number of their span and whether they begin it; budget is the same throughout a conversation."""
    ordered = Window.partitionBy("conv_id").orderBy("at")
    turns = turns.withColumn("half", F.floor(budget / 2))
    turns = turns.withColumn("big", (F.col("tokens") > F.col("half")).cast("long"))
    turns = turns.withColumn("run", 2 * F.sum("big").over(ordered) - F.col("big"))  # odd: a big turn, even: those between
    run = Window.partitionBy("conv_id", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("step", F.floor(F.coalesce(F.sum("tokens").over(run), F.lit(0)) / F.col("half")))
    before = [F.lag(c).over(ordered) for c in ("run", "step")]
    turns = turns.withColumn("fresh", before[0].isNull() | (before[0] != F.col("run")) | (before[1] != F.col("step")))
    return turns.withColumn("span", F.sum(F.col("fresh").cast("long")).over(ordered) - 1).drop("half", "big", "run", "step")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """A row for each window: conv_id, window, formatted, tokens (the bound), n_repeated (turns before the span's), loss (spans of code points: start, length)."""
    if budget < history + system + 2:
        raise ValueError("budget must leave room beside history and system")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("at", F.row_number().over(order))
    turns = turns.select(
        "conv_id", "at", "role", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("a"), escape(F.col("text")).alias("b")
    )
    turns = turns.withColumn("tokens", F.octet_length("a") + F.octet_length("b") + len(END))
    lead = F.min(F.when(F.col("role") == "system", F.struct("at", "tokens"))).over(Window.partitionBy("conv_id"))
    turns = turns.withColumn("lead", lead).withColumn("lead", F.when(F.col("lead")["tokens"] <= system, F.col("lead")))
    turns = spans(turns, budget - history - F.coalesce(F.col("lead")["tokens"], F.lit(0)))

    ordered = Window.partitionBy("conv_id").orderBy("at")
    turn = F.struct("at", "tokens", "a", "b", (F.col("role") == "assistant").alias("target"))
    first = F.first(F.when(F.col("at") == F.col("lead")["at"], turn), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    repeated = {"system": first} | {f"h{i}": F.lag(turn, i).over(ordered) for i in range(1, HISTORY_TURNS + 1)}
    turns = turns.select("conv_id", "span", "fresh", turn.alias("turn"), *[c.alias(k) for k, c in repeated.items()])
    turns = turns.withColumns({k: F.when(F.col("fresh"), F.col(k)) for k in repeated})  # where a span begins, and nowhere else
    parts = turns.groupBy("conv_id", F.col("span").alias("window")).agg(
        F.array_sort(F.collect_list("turn")).alias("own"), F.sum("turn.tokens").alias("held"), F.max_by(F.struct(*repeated), "fresh").alias("head")
    )

    s, room = F.col("head")["system"], budget - F.col("held")
    with_system = F.coalesce(s["tokens"] <= room, F.lit(False))
    room = F.least(F.lit(history).cast("bigint"), room - F.when(with_system, s["tokens"]).otherwise(0))
    kept, held, fits = F.array().cast(parts.schema["own"].dataType), F.lit(0), F.lit(True)
    for i in range(1, HISTORY_TURNS + 1):
        h = F.col("head")[f"h{i}"]
        held = held + h["tokens"]
        fits = fits & F.coalesce((held <= room) & ~(with_system & (h["at"] <= s["at"])), F.lit(False))
        kept = F.when(fits, F.concat(F.array(h), kept)).otherwise(kept)
    parts = parts.withColumn("past", F.when(with_system, F.concat(F.array(s), kept)).otherwise(kept))
    parts = parts.withColumn("shown", F.concat("past", "own")).withColumn("n_repeated", F.size("past").cast("long"))
    formatted = F.array_join(F.transform("shown", lambda t: F.concat(t["a"], t["b"], F.lit(END))), "")
    lengths = F.transform(
        "shown", lambda t, i: F.struct(F.length(t["a"]).alias("a"), F.length(t["b"]).alias("b"), (t["target"] & (i >= F.col("n_repeated"))).alias("target"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        here = F.array(F.struct((acc["at"] + t["a"]).alias("start"), t["b"].alias("length")))
        return F.struct(
            (acc["at"] + t["a"] + t["b"] + len(END)).alias("at"),
            F.when(t["target"], F.concat(acc["found"], here)).otherwise(acc["found"]).alias("found"),
        )

    loss = F.aggregate(lengths, start, step, lambda acc: acc["found"])
    tokens = F.octet_length("formatted").cast("long").alias("tokens")
    parts = parts.select("conv_id", "window", formatted.alias("formatted"), "n_repeated", loss.alias("loss"))
    return parts.select("conv_id", "window", "formatted", tokens, "n_repeated", "loss")


def read_back(formed: DataFrame) -> DataFrame:
    """windows with `turns` (role, text) of their spans and `targets`, the texts under the loss mask, from the strings alone."""
    pieces = F.split("formatted", F.lit(r"<\|im_end\|>\n"), -1)
    pieces = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.size(pieces) - 1 - F.col("n_repeated").cast("int"))
    body = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    turns = F.transform(
        body,
        lambda b: F.struct(
            _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda x: unescape(F.substr("formatted", x["start"] + 1, x["length"])))
    return formed.withColumns({"turns": turns, "targets": targets})


def conversation_digests(formed: DataFrame) -> DataFrame:
    """A row for each conversation, of what its windows give back."""
    back = read_back(formed).select(
        "conv_id", F.length("formatted").cast("long").alias("chars"), F.size("turns").cast("long").alias("n"),
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("loss"),
        ).alias("w"),
    )
    whole = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    turns, loss = (F.array_join(f"w.{c}", "") for c in ("turns", "loss"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
