"""Chat formatting in budgeted windows (operator 3). Built-in functions only.

A conversation becomes one or more windows of at most ``budget`` tokens. Each
window holds the system turn, some turns of history before its first new turn,
and a turn-aligned span of new turns chosen by prefix sums of turn tokens.
Assistant texts are under the loss mask only in the window where they are new,
so every one is learnt once.

Turns are marked ``<|im_start|>role NEWLINE text <|im_end|> NEWLINE``. Inside
texts and roles every ``<``, some backslashes, ``|`` gets one backslash more;
taking one away again restores them, and no text can hold a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles also end at their line's end, so a line feed in them is written as a backslash and n, a backslash as a backslash and s."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # a backslash is always the first of two characters, so neither sequence can begin within the other
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Words, and signs between them, plus four for the marks: a count that needs no vocabulary.

    It is what budgets are counted in; a tokenizer's count differs from it by a
    factor that depends on the vocabulary, so a model's limit needs a margin.
    """
    return F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), 0)) + 4


def windows(
    turns: DataFrame, budget: int = 1024, history_turns: int = 2, conv_col: str = "conv_id", turn_col: str = "turn",
        role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, window, repeated, fresh, formatted, loss) for each window of each conversation.

    ``repeated`` turns (system and history) come first, then ``fresh`` new
    ones; ``loss`` lists (from, length) in code points of ``formatted``, from 0,
    of the escaped assistant texts to learn.

    Turns are ordered by turn, then role and text where that ties or is null
    (nulls first). Null texts and roles are empty; null conv_ids are one
    conversation; repeated rows are turns of their own; an empty table gives no
    windows. A system turn is a first turn whose role is ``system``. It is
    repeated in every window; history is the last turns before the window's
    first new turn, at most ``history_turns``, as many as take at most half of
    what the system turn leaves and leave room for that new turn. So a window exceeds the
    budget only where the system turn and one new turn do: that turn stands, uncut, in a
    window without history or other new turns.
    """
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        turn_tokens(text).cast("long").alias("n"))
    # prefix sums: tokens up to and with each turn
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n").over(in_order))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "upto", "role", "text", "n"))).alias("ts"))
    convs = convs.withColumn("system", F.col("ts")[0]["role"] == "system").withColumn("ts_n", F.size("ts"))
    convs = convs.withColumn("own", F.when(F.col("system"), F.col("ts")[0]["n"]).otherwise(F.lit(0)).cast("long"))
    first_new = F.when(F.col("system"), 1).otherwise(0)
    before = lambda i: F.col("ts")[i]["upto"] - F.col("ts")[i]["n"]

    def back(i: Column) -> Column:
        """The first turn of the history before turn i: at most half of the room, and no more than turn i leaves."""
        room = F.lit(budget) - F.col("own")

        def fits(h: Column) -> Column:
            tokens = before(i) - before(F.greatest(i - h, F.lit(0)))
            return (h == 0) | (i - h >= first_new) & (tokens <= room / 2) & (tokens + F.col("ts")[i]["n"] <= room)

        return i - F.array_max(F.filter(F.sequence(F.lit(0), F.lit(history_turns)), fits))

    def step(state: Column, i: Column) -> Column:
        """Begin a new window at turn i where the current one has no room for it."""
        begin = F.coalesce(F.try_element_at(state["starts"], F.lit(-1))["begin"], F.lit(0))
        full = (i == first_new) | (F.col("own") + F.col("ts")[i]["upto"] - before(state["from"]) > budget) & (i > begin)
        return F.struct(
            F.when(full, back(i)).otherwise(state["from"]).alias("from"),
            F.when(full, F.concat(state["starts"],
                F.array(F.struct(i.alias("begin"), back(i).alias("hist"))))).otherwise(state["starts"]).alias("starts"),
        )

    spans = "array<struct<begin:int,hist:int>>"
    span = F.when(first_new < F.col("ts_n"), F.sequence(first_new, F.col("ts_n") - 1)).otherwise(F.array().cast("array<int>"))
    convs = convs.withColumn("starts",
        F.aggregate(span, F.struct(F.lit(0).alias("from"), F.array().cast(spans).alias("starts")), step)["starts"])
    # a conversation of a system turn alone is one window without new turns after it
    convs = convs.withColumn("starts",
        F.when(F.size("starts") == 0, F.array(F.struct(first_new.alias("begin"), first_new.alias("hist")))).otherwise(F.col("starts")))
    lead = F.when(F.col("system"), F.slice("ts", 1, 1)).otherwise(F.slice("ts", 1, 0))

    def window(s: Column, w: Column) -> Column:
        """A window's own turns, so that no row carries its whole conversation."""
        stop = F.coalesce(F.get("starts", w + 1)["begin"], F.col("ts_n"))
        again = s["begin"] - s["hist"] + F.when(F.col("system") & (w > 0), 1).otherwise(0)  # the system turn is new in the first window
        return F.struct(w.alias("window"), again.cast("int").alias("repeated"),
            F.concat(lead, F.slice("ts", s["hist"] + 1, stop - s["hist"])).alias("shown"))

    one = convs.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    one = one.withColumn("fresh", (F.size("shown") - F.col("repeated")).cast("int"))
    heads = F.transform("shown", lambda t: F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    one = one.select("conv_id", "window", "repeated", "fresh", heads.alias("parts"))
    # where each body begins; repeated turns are masked
    at = F.aggregate(
        F.sequence(F.lit(0), F.size("parts") - 1),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,length:int>>").alias("loss")),
        lambda s, i: F.struct(
            (s["end"] + F.length(F.col("parts")[i]["head"]) + F.length(F.col("parts")[i]["body"]) + len(END) + 1).alias("end"),
            F.when(
                F.col("parts")[i]["learn"] & (i >= F.col("repeated")),
                F.concat(s["loss"], F.array(F.struct((s["end"] + F.length(F.col("parts")[i]["head"])).alias("from"),
                    F.length(F.col("parts")[i]["body"]).alias("length")))),
            ).otherwise(s["loss"]).alias("loss"),
        ),
    )
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return one.select("conv_id", "window", "repeated", "fresh", whole.alias("formatted"), at["loss"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a window's text holds, unescaped."""
    body = F.substring(formatted, F.lit(len(START) + 1), F.greatest(F.lit(0), F.length(formatted) - len(START) - len(END) - 1))
    pieces = F.split(body, r"<\|im_end\|>\n<\|im_start\|>", -1)

    def turn(p: Column) -> Column:
        line = F.instr(p, F.lit("\n"))
        return F.struct(unescape_role(F.substring(p, F.lit(1), line - 1)).alias("role"),
            unescape(F.substring(p, line + 1, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def digests(wins: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the windows."""
    fresh = F.slice(read_turns(F.col("formatted")), F.col("repeated") + 1, F.greatest(F.col("fresh"), F.lit(0)))
    said = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["from"] + 1, s["length"]))), "")
    rows = wins.select("conv_id", F.struct("window", F.col("fresh").alias("n"), said.alias("said"), learnt.alias("learnt"),
        F.length("formatted").alias("chars")).alias("w"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    total = lambda name: F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w[name])
    joined = lambda name: F.array_join(F.transform("ws", lambda w: w[name]), "")
    return convs.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
            F.length(joined("learnt")).cast("long").alias("loss_chars"),
        F.sha2(joined("learnt"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )
