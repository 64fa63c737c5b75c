"""Chat formatting in budgeted windows, with DataFrame functions only.

Each conversation is laid out as turns ``<|turn|>role\\ntext<|end|>\\n``. Prefix sums of
the turns' token counts cut it into windows at turn borders: a window repeats the
leading system turn and as many of the turns before it as ``history`` tokens allow, then
holds new turns up to what is left of ``budget``. Each assistant text is under the loss
mask in the one window where it is new; where it is repeated as history it is masked.

Inside texts a control string gets one backslash after its first character, also
where backslashes stand there already, so that taking one away restores the text exactly and
no control string of the template remains. Roles are percent-encoded.

Where windows start is a fold over each conversation's prefix sums alone. Which windows repeat a turn follows from running counts of the
starts, so texts meet only by (conversation, window), and the work is linear in the turns and in what windows repeat.

Cases: turns go by turn, then role, then text, nulls first; repeated rows stay.
Null text and null role count as empty. A turn longer than the budget gets a
window of its own and stays whole. An empty table gives no rows. ``read_windows`` returns a conversation as one
record, so there its turns meet in one task; before that only their order needs one, which is a sort that spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import own

TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings: a first character, then one of these.
CONTROL = r"(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, and four for the marks."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def format_windows(conversations: DataFrame, budget: int = 2048, history: int = 512, tokens=token_estimate) -> DataFrame:
    """Windows (conv_id, window, text, n_repeated, loss_spans) of conversations (conv_id, turn, role, text).

    ``n_repeated``: leading turns of the window that earlier windows have as new.
    ``loss_spans``: [start, end) in code points of ``text``, of the escaped assistant texts that are new here.
    ``tokens``: a function from the escaped text to its token count, as columns.
    """
    text = escape(F.coalesce(F.col("text"), F.lit("")))
    rows = own(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("esc")
    )
    rows = rows.withColumn("tk", tokens(F.col("esc")).cast("long"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "esc")
    turns = rows.select("conv_id", F.row_number().over(order).cast("long").alias("i"), "role", "esc", "tk", F.sum("tk").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("p"))
    spans = turns.select("conv_id", "i", F.col("i").alias("at"), (F.col("p") - F.col("tk")).alias("before"), ((F.col("i") == 1) & (F.col("role") == "system")).alias("sys"))
    starts = _starts(turns, budget - history)
    # own: the window that has the turn as new
    marks = spans.select("conv_id", F.lit(1).alias("kind"), "i", "at", "before", "sys")
    marks = marks.unionByName(starts.select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("i"), F.col("s").alias("at"), "before", F.lit(False).alias("sys")))
    placed = marks.withColumn("own", _running(F.col("kind") == 0, "at", "kind") - 1).withColumn("all", F.max("own").over(W.partitionBy("conv_id")))
    # last: of the windows that start within the history's tokens behind the turn
    placed = placed.withColumn("at", F.col("before") + F.when(F.col("kind") == 1, F.lit(history)).otherwise(0))
    placed = placed.withColumn("last", _running(F.col("kind") == 0, "at", "kind") - 1).where("kind = 1")
    last = F.when(F.col("sys"), F.col("all")).otherwise(F.greatest("own", "last"))
    placed = placed.select(F.col("conv_id").alias("c"), F.col("i").alias("k"), "own", F.explode(F.sequence("own", last)).alias("window"))
    each = turns.join(placed, turns["conv_id"].eqNullSafe(placed["c"]) & (turns["i"] == placed["k"]))
    turn = F.struct("i", "role", "esc", (F.col("window") == F.col("own")).alias("new"))
    win = each.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    win = win.select("conv_id", F.col("window").cast("int").alias("window"), F.filter("t", lambda x: ~x["new"]).alias("repeated"), F.filter("t", lambda x: x["new"]).alias("new"))
    win = win.withColumn("n_repeated", F.size("repeated"))
    head = lambda x: F.concat(F.lit(TURN), F.url_encode(x["role"]), F.lit("\n"))
    lay = lambda x: F.concat(head(x), x["esc"], F.lit(END))
    win = win.withColumn("front", F.array_join(F.transform("repeated", lay), "")).withColumn("back", F.array_join(F.transform("new", lay), ""))
    zero = F.struct(F.length("front").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    size = lambda c: F.length(c).cast("long")
    masks = F.aggregate(
        "new",
        zero,
        lambda a, x: F.struct(
            (a["at"] + size(lay(x))).alias("at"),
            F.when(
                x["role"] == "assistant",
                F.concat(a["spans"], F.array(F.struct((a["at"] + size(head(x))).alias("start"), (a["at"] + size(head(x)) + size(x["esc"])).alias("end")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return win.select("conv_id", "window", F.concat("front", "back").alias("text"), "n_repeated", masks.alias("loss_spans"))


def _running(flag: Column, *order: str) -> Column:
    """How many rows of the conversation have the flag, through this one."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


#: Starts in one piece of the list that the fold builds: appending copies a piece, and a list of pieces, but never all starts.
PIECE = 256


def _starts(turns: DataFrame, room: int) -> DataFrame:
    """(conv_id, s, before): the first new turn of each window and the tokens before it.

    Greedy: a window starts where the prefix sum since the last start would pass the room, which a leading system turn lessens; the
    first turn after that never starts a window of its own.
    """
    system = F.col("role") == "system"
    conv = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "p"))).alias("t"), F.max(F.when((F.col("i") == 1) & system, F.col("p"))).alias("sys")
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    piece = F.array(F.struct(one.alias("s"), zero.alias("before")))
    state = F.struct(F.slice(F.array(piece), 1, 0).alias("done"), piece.alias("piece"), zero.alias("base"), zero.alias("p"))
    most = F.greatest(F.lit(room) - F.coalesce("sys", zero), one)
    has_sys = F.col("sys").isNotNull()

    def step(a: Column, x: Column) -> Column:
        cut = (x["p"] - a["base"] > most) & (x["i"] > F.when(has_sys, 2).otherwise(1))
        full = cut & (F.size(a["piece"]) >= PIECE)
        start = F.array(F.struct(x["i"].alias("s"), a["p"].alias("before")))
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["piece"]))).otherwise(a["done"]).alias("done"),
            F.when(full, start).when(cut, F.concat(a["piece"], start)).otherwise(a["piece"]).alias("piece"),
            F.when(cut, a["p"]).when(has_sys & (x["i"] == 1), x["p"]).otherwise(a["base"]).alias("base"),
            x["p"].alias("p"),
        )

    starts = F.aggregate("t", state, step, lambda a: F.flatten(F.concat(a["done"], F.array(a["piece"]))))
    return conv.select("conv_id", F.explode(starts).alias("x")).select("conv_id", "x.s", "x.before")


def read_windows(windows: DataFrame) -> DataFrame:
    """From the formatted text and mask alone: (conv_id, turns array<struct<role,text>>, loss_text, formatted_chars)."""
    laid = F.split("text", r"<\|end\|>\n", -1)
    laid = F.slice(laid, F.col("n_repeated") + 1, F.size(laid) - 1 - F.col("n_repeated"))
    turns = F.transform(
        laid,
        lambda x: F.struct(
            F.url_decode(F.regexp_extract(x, r"^<\|turn\|>([^\n]*)\n", 1)).alias("role"),
            unescape(F.regexp_replace(x, r"^<\|turn\|>[^\n]*\n", "")).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda x: unescape(F.substring("text", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), "")
    each = windows.select("conv_id", F.struct("window", turns.alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("n")).alias("w"))
    got = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("w.n").alias("formatted_chars"))
    return got.select(
        "conv_id",
        F.flatten("w.turns").alias("turns"),
        F.array_join("w.loss", "").alias("loss_text"),
        "formatted_chars",
    )
