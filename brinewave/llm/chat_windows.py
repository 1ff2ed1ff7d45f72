"""Chat formatting in budgeted windows.

Each conversation is cut into windows of whole turns by the running total of the turns' tokens. A window holds the
conversation's system turn, up to HISTORY turns repeated from before, and its own new turns. The loss mask marks the
texts of assistant turns, but only where they are new: repeated turns are context and no target.

The template is

    ### role: text</turn>

with a line feed after each turn. Inside roles and texts the characters \\ # < are written as \\\\ \\h \\l (in roles also
: as \\c), so that no marker can appear there; `parse` reads the template back and undoes this.

A conversation may be of any length: its turns are numbered and summed by window functions, which stream, and the
starts of its windows come from these sums alone. What is gathered in one row is a window: the budget, or one turn.

Only DataFrame operations are used.

Defined cases. A null text or role is empty. Rows of a null conv_id are one conversation. Turns are ordered by turn, nulls
first, then by role and text; repeated rows are turns of their own. A turn over the budget, however long its text, is a
window of its own. An empty table gives no windows. Only conv_id, turn, role and text are read, so extra columns and
their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinewave.llm.common import n_words, table

BUDGET = 512  # tokens of a window's new turns, its system turn and its history included where they fit
HISTORY = 2
TURN_COST = 4  # tokens of a turn's markers
END = "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Undo `escape`; a doubled backslash is set aside while the others are read."""
    out = F.split(text, r"\\\\", -1)
    part = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(out, part), "\\")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, role, text, tokens, total, before, system): turns in order from 0, with the total of tokens and the
    turns before them; system is the conversation's first turn if its role is system."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    c = c.withColumn("n", F.row_number().over(order) - 1).withColumn("tokens", n_words(F.col("text")) + TURN_COST)
    c = c.withColumn("total", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = lambda k: F.lag(F.struct("n", "role", "text", "tokens"), k).over(order)
    c = c.withColumn("before", F.filter(F.array(*[turn(k) for k in range(HISTORY, 0, -1)]), lambda x: x.isNotNull()))
    first = F.first(F.struct("n", "role", "text", "tokens")).over(order)
    return c.withColumn("system", F.when(first["role"] == "system", first))


def starts(turns: DataFrame, budget: int) -> DataFrame:
    """(conv_id, n, window): the turn at which each window starts, from the running totals of whole conversations.

    A window starts where the total since the last start would pass what the system turn leaves of the budget. Only
    numbers are gathered for a conversation, no texts.
    """
    sums = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "total", "tokens"))).alias("sums"), F.first("system.tokens").alias("spent"))
    room = F.lit(budget) - F.coalesce("spent", F.lit(0))
    state = F.struct(F.lit(0).cast("long").alias("from_"), F.array().cast("array<int>").alias("at"))
    step = lambda s, t: F.when(
        (t["n"] == 0) | (t["total"] + t["tokens"] - s["from_"] > room), F.struct(t["total"].alias("from_"), F.array_append(s["at"], t["n"]).alias("at"))
    ).otherwise(s)
    return sums.select("conv_id", F.posexplode(F.aggregate("sums", state, step, lambda s: s["at"])).alias("window", "n"))


def windows(conversations: DataFrame, *, budget: int = BUDGET) -> DataFrame:
    """(conv_id, window, n_context, n_new, formatted, mask): mask holds (start, length) in characters of formatted, from 0."""
    turns = numbered(conversations)
    # Each turn takes the number of the last start at or before it; starts come as rows of their own among the turns.
    both = turns.withColumn("window", F.lit(None).cast("int")).unionByName(starts(turns, budget), allowMissingColumns=True)
    order = Window.partitionBy("conv_id").orderBy("n", F.col("window").asc_nulls_last())
    placed = both.withColumn("window", F.last("window", ignorenulls=True).over(order)).where("role is not null")
    cut = placed.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("n", "role", "text", "tokens", "before"))).alias("new"), F.first("system").alias("system"), F.sum("tokens").alias("spent")
    )
    cut = cut.withColumn("left", F.lit(budget) - F.coalesce(F.col("system.tokens"), F.lit(0)) - F.col("spent"))
    history = F.element_at("new", 1)["before"]
    # History is repeated from its newest turn backwards as long as it fits, the system turn never twice.
    history = F.filter(history, lambda t: ~(F.col("system").isNotNull() & (t["n"] == 0)))
    fits = F.filter(
        F.transform(history, lambda t, i: F.struct(t.alias("t"), F.aggregate(F.slice(history, i + 1, F.size(history)), F.lit(0).cast("long"), lambda s, u: s + u["tokens"]).alias("sum"))),
        lambda x: x["sum"] <= F.col("left"),
    )
    system = F.when(F.col("system").isNotNull() & (F.element_at("new", 1)["n"] > 0), F.array("system")).otherwise(F.array().cast("array<struct<n:int,role:string,text:string,tokens:bigint>>"))
    context = F.concat(F.transform(system, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.transform(fits, lambda x: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text"))))
    cut = cut.withColumn("context", context)
    piece = lambda t: F.concat(F.lit("### "), escape(t["role"], True), F.lit(": "), escape(t["text"]), F.lit(END))
    head = F.array_join(F.transform("context", piece), "")
    cut = cut.select("conv_id", "window", "new", "context", head.alias("head"), F.transform("new", piece).alias("pieces"))
    # Where each new piece starts, from the lengths of what comes before it.
    offsets = F.aggregate("pieces", F.array(F.length("head")), lambda s, p: F.array_append(s, F.element_at(s, -1) + F.length(p)))
    cut = cut.withColumn("offsets", offsets)
    spans = F.transform(
        "new",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            (F.get("offsets", i) + F.length(escape(t["role"], True)) + 6).cast("int").alias("start"),
            F.length(escape(t["text"])).cast("int").alias("length"),
        ),
    )
    mask = F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return cut.select("conv_id", "window", F.size("context").alias("n_context"), F.size("new").alias("n_new"), F.concat("head", F.array_join("pieces", "")).alias("formatted"), mask.alias("mask"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted window."""
    pieces = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"^### ([^:]*): ", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)^### [^:]*: (.*)$", 1)).alias("text"),
        ),
    )


def read_back(formed: DataFrame) -> DataFrame:
    """One row per conversation from its windows: number and digest of its turns, length and digest of all text under the mask."""
    turns = parse(F.col("formatted"))
    new = F.slice(turns, F.col("n_context") + 1, F.col("n_new"))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    w = formed.select(
        "conv_id", F.col("window").alias("at"), "n_new", F.length("formatted").alias("chars"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), loss.alias("loss"),
    )
    # The contract's digest of a whole conversation needs its text in one row.
    whole = w.groupBy("conv_id").agg(
        F.sum("n_new").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"),
        F.array_sort(F.collect_list(F.struct("at", "said", "loss"))).alias("parts"),
    )
    said, lost = F.array_join(F.col("parts.said"), ""), F.array_join(F.col("parts.loss"), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"),
        digest(lost).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_windows",
    )


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text")
    )
    return read_back(windows(conversations.unionByName(more)))

