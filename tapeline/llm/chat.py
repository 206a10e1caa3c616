"""Chat formatting in budgeted windows, in DataFrame functions only.

Each turn costs its tokens plus a fixed overhead. A window of ``budget`` tokens has room for a system turn of ``system`` tokens, ``history`` tokens of repeated
turns and a span of new ones. Prefix sums of the costs along a conversation place every turn; the turns that end between two multiples of the
span's room form a span if they fit. If not, those that end in each half do, but a turn above half the room has a span of its own: a span of others
then starts at most half the room before its half. So spans are turn-aligned, every turn is new in exactly one, and a span that is not a single turn
fits its room. A window holds the system turn, the last turns of the span before as far as history and budget allow, and its span. It is over
the budget only if the system turn is over its share or a single turn over the room. Only the assistant turns of the span itself carry loss: what is
repeated is masked.

The prefix sums are taken in chunks of turns, with the sums of the earlier chunks added, so a very long conversation is spread over tasks; a window
is bounded by the budget or by its system turn and one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, SYSTEM, HISTORY, OVERHEAD = 512, 80, 64, 4
CHUNK = 64  # turn numbers of one chunk
#: The template.
START, END, TARGET = "<|im_start|>", "<|im_end|>\n", "assistant"
_TOKEN = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x09-\\x0D\\x20]"


def escape(text: Column) -> Column:
    """No control string is left: a backslash becomes ``\\b``, ``<|`` becomes ``<\\p``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and a line feed, which ends the role, becomes ``\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def placed_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, conv_id, role, text, start, stop): token positions of each turn in its conversation.

    Turns are ordered by turn number, nulls first, then role and text; repeated rows are turns of their own. A null text or role is empty, a null
    conversation id is one more conversation.
    """
    conv_id = F.col(conv)
    rows = conversations.select(
        F.when(conv_id.isNull(), "-").otherwise(F.concat(F.lit("="), conv_id.cast("string"))).alias("key"), conv_id.alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.floor(F.col(turn) / CHUNK).cast("long"), F.lit(-(1 << 62))).alias("chunk"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("cost", F.regexp_count("text", F.lit(_TOKEN)).cast("long") + OVERHEAD)
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("key", "chunk").agg(F.sum("cost").alias("chunk_cost"))
    offsets = chunks.select("key", "chunk", F.coalesce(F.sum("chunk_cost").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.col("before") + F.sum("cost").over(inside)
    return rows.join(offsets, ["key", "chunk"]).withColumn("stop", stop).select("key", "conv_id", "role", "text", (F.col("stop") - F.col("cost")).alias("start"), "stop")


def half_room(budget: int = BUDGET, system: int = SYSTEM, history: int = HISTORY) -> int:
    return max(1, (budget - system - history) // 2)


def format_windows(conversations: DataFrame, budget: int = BUDGET, system: int = SYSTEM, history: int = HISTORY, **columns: str) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss array<struct<start, stop>>, tokens).

    ``n_repeated`` leading turns of the window are repeats; ``loss`` holds code point ranges of the formatted text, stop exclusive. An empty table gives no
    windows. A turn is never cut.
    """
    half, cost = half_room(budget, system, history), F.col("stop") - F.col("start")
    turns = placed_turns(conversations, **columns).withColumn("part", F.floor((F.col("stop") - 1) / half).cast("long"))
    # a room holds at most 2 * half / OVERHEAD turns
    whole = F.sum(cost).over(Window.partitionBy("key", F.floor(F.col("part") / 2))) <= 2 * half
    turns = turns.withColumn("window", F.when(whole, 4 * F.floor(F.col("part") / 2)).otherwise(2 * F.col("part") + (cost <= half).cast("long"))).drop("part")
    spans = turns.groupBy("key", "window").agg(F.max("stop").alias("hi"), F.sum(cost).alias("new"))
    along = Window.partitionBy("key").orderBy("window")
    spans = spans.select("key", "window", "hi", F.lead("window").over(along).alias("next"), F.least(F.lit(history), budget - system - F.lead("new").over(along)).alias("room"))
    first_system = (F.col("start") == 0) & (F.col("role") == "system")
    again = (F.col("hi") - F.col("start") <= F.col("room")) & F.col("next").isNotNull() & ~first_system
    uses = F.array_compact(F.array(F.struct(F.lit(2).alias("kind"), F.col("window").alias("window")), F.when(again, F.struct(F.lit(1).alias("kind"), F.col("next").alias("window")))))
    part = F.struct("kind", "start", "role", "text", (F.col("stop") - F.col("start")).alias("cost"))
    body = turns.join(spans, ["key", "window"]).withColumn("use", F.explode(uses)).select("key", "conv_id", "use.window", F.col("use.kind").alias("kind"), "start", "stop", "role", "text")
    first = turns.filter(first_system).select("key", "conv_id", F.col("window").alias("own"), F.lit(0).alias("kind"), "start", "stop", "role", "text")
    head = spans.select("key", "window").join(first, "key").filter("window <> own").select(*body.columns)
    packed = body.unionByName(head).groupBy("key", "conv_id", "window").agg(F.array_sort(F.collect_list(part)).alias("parts"))

    lead = lambda p: F.concat(F.lit(START), escape_role(p.role), F.lit("\n"))
    pieces = F.transform("parts", lambda p: F.struct(p.kind.alias("kind"), (p.role == TARGET).alias("target"), lead(p).alias("lead"), escape(p.text).alias("body"), p.cost.alias("cost")))
    held = packed.select("conv_id", "window", F.explode(F.array(pieces)).alias("pieces"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("loss"))

    def step(acc: Column, p: Column) -> Column:
        start = acc.at + F.length(p.lead)
        stop = start + F.length(p.body)
        own = F.when((p.kind == 2) & p.target, F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
        return F.struct((stop + len(END)).alias("at"), F.concat(acc.loss, own).alias("loss"))

    return held.select(
        "conv_id", "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p.body, F.lit(END))), "").alias("formatted"),
        F.size(F.filter("pieces", lambda p: p.kind < 2)).alias("n_repeated"),
        F.aggregate("pieces", empty, step).loss.alias("loss"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p.cost).alias("tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns array<struct<role, text>>, targets array<string>): new turns and loss texts, parsed from the formatted text alone."""
    pieces = F.split("formatted", "<\\|im_end\\|>\\n", -1)
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(START) + 1))
        role = F.substring_index(rest, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(rest, F.length(role) + 2)).alias("text"))

    targets = F.transform("loss", lambda s: unescape(F.substr("formatted", s.start + 1, s.stop - s.start)))
    return windows.select("conv_id", "window", F.transform(new, turn).alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation: turn count and digests of what the windows read back to. The digest of a conversation needs its texts in one row."""
    back = read_back(windows)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    part = back.select("conv_id", "window", F.size("turns").alias("n"), line.alias("turns"), F.array_join("targets", "").alias("targets"), "formatted_chars")
    whole = part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum(F.length("targets")).alias("loss_chars"), F.sum("formatted_chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"), "loss_chars", F.sha2(F.array_join("w.targets", ""), 256).alias("loss_sha256"), "formatted_chars")
