"""Chat formatting: conversations as windows of marked turns under a token budget.

Every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a role or text
are escaped with a backslash, and ``read_back`` undoes it exactly. Prefix sums of turn tokens cut a
conversation at turn ends: block ``k`` holds the turns that begin in ``[k * room, (k + 1) * room)``
tokens, and a turn that crosses the block's end stands in a window of its own, so a window of
several new turns never exceeds ``room`` and no turn is cut. A leading system turn opens every window, up
to ``history`` tokens of earlier turns are repeated as context, and only the new assistant turns of
a window are targets, so each is learnt once.

Only DataFrame functions are used. Turns of equal number are ordered by role and text; null roles
and texts are empty; repeated rows are turns of their own; null conversation ids form one
conversation; extra columns are ignored; no rows give no windows. Apart from the read-back digest,
which by its definition joins all text of a conversation, no step gathers more than a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Strings that mark structure in this or another common template (fixed values).
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

BUDGET = 1024
HISTORY = 256
TARGET = "assistant"


def escape(text: Column) -> Column:
    """``text`` with a backslash before each backslash and inside each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows (conv_id, window, text, segments, n_tokens) of conv_id, turn, role and text.

    ``segments`` has (fresh, target) for each turn of the window's text: ``fresh`` is false for
    repeated context, ``target`` marks the turns whose text counts in the loss.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    header = F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))
    body = F.concat(F.lit(OPEN), header, F.lit("\n"), escape(text), F.lit(CLOSE))
    rows = turns.select("conv_id", "turn", role.alias("role"), body.alias("body")).withColumn(
        "tokens", F.regexp_count("body", F.lit(r"[^ \t\n\r]+")).cast("long")
    )

    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    whole = Window.partitionBy("conv_id")
    rows = (
        rows.withColumn("seq", F.row_number().over(ordered))
        .withColumn("system", (F.col("seq") == 1) & (F.col("role") == "system"))
        .withColumn("new", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
        .withColumn("end", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(
            "kept", F.sum(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole)
        )
        .withColumn("start", F.col("end") - F.col("new"))
        .withColumn("room", F.greatest(F.lit(budget - history) - F.col("kept"), F.lit(history), F.lit(1)))
        .withColumn("block", F.floor(F.col("start") / F.col("room")))
        .withColumn("crosses", F.floor((F.col("end") - 1) / F.col("room")) > F.col("block"))
        .withColumn(
            "own",
            F.when(~F.col("system"), 2 * F.col("block") + F.col("crosses").cast("long")),
        )
        .withColumn("first", F.coalesce(F.min("own").over(whole), F.lit(0)))
        .withColumn("last", F.coalesce(F.max("own").over(whole), F.lit(0)))
    )

    # A turn may serve as history in its block's crossing window and in the next block's windows.
    near_end = F.col("start") >= (F.col("block") + 1) * F.col("room") - history
    later = F.filter(
        F.array(
            F.when(~F.col("crosses"), 2 * F.col("block") + 1),
            F.when(near_end, 2 * F.col("block") + 2),
            F.when(near_end, 2 * F.col("block") + 3),
        ),
        lambda w: w.isNotNull() & (w <= F.col("last")),
    )
    places = F.when(F.col("system"), F.sequence("first", "last")).otherwise(
        F.concat(F.array("own"), later)
    )
    placed = rows.select(
        "conv_id",
        F.explode(places).alias("window"),
        F.struct(
            "seq",
            "system",
            "start",
            "end",
            "tokens",
            "body",
            F.coalesce("own", "first").alias("own"),
            (F.col("role") == TARGET).alias("target"),
        ).alias("part"),
    )
    grouped = placed.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.min(
            F.when((F.col("part.own") == F.col("window")) & ~F.col("part.system"), F.col("part.start"))
        ).alias("from"),
        F.max(F.col("part.own") == F.col("window")).alias("has_new"),
    )
    used = F.filter(
        "parts",
        lambda p: p["system"]
        | (p["own"] == F.col("window"))
        | ((p["end"] <= F.col("from")) & (p["start"] >= F.col("from") - history)),
    )
    # A system turn is offered to every window number; those without a new turn do not exist.
    return (
        grouped.where("has_new")
        .withColumn("used", used)
        .select(
            "conv_id",
            "window",
            F.concat_ws("", F.transform("used", lambda p: p["body"])).alias("text"),
            F.transform(
                "used",
                lambda p: F.struct(
                    (p["own"] == F.col("window")).alias("fresh"),
                    (p["target"] & (p["own"] == F.col("window"))).alias("target"),
                ),
            ).alias("segments"),
            F.aggregate("used", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("n_tokens"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window its new turns (role, text, target), parsed from the formatted text alone."""
    pieces = F.split("text", r"<\|im_end\|>\n", -1)
    paired = F.arrays_zip(
        F.slice(pieces, 1, F.size("segments")).alias("piece"), F.col("segments").alias("mark")
    )
    header = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    fresh = F.transform(
        F.filter(paired, lambda p: p["mark"]["fresh"]),
        lambda p: F.struct(
            unescape(F.regexp_extract(p["piece"], header, 1)).alias("role"),
            unescape(F.regexp_extract(p["piece"], header, 2)).alias("text"),
            p["mark"]["target"].alias("target"),
        ),
    )
    return formatted.select("conv_id", "window", F.length("text").alias("chars"), fresh.alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the windows hold per conversation, read back from them."""
    turns = F.flatten(F.transform(F.array_sort("parts"), lambda p: p["turns"]))
    spoken = F.concat_ws(
        "", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    )
    learnt = F.concat_ws(
        "", F.transform(F.filter("turns", lambda t: t["target"]), lambda t: t["text"])
    )
    return (
        read_back(formatted)
        .groupBy("conv_id")
        .agg(
            F.collect_list(F.struct("window", "turns")).alias("parts"),
            F.sum("chars").alias("formatted_chars"),
            F.count(F.lit(1)).alias("n_windows"),
        )
        .withColumn("turns", turns)
        .withColumn("learnt", learnt)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(spoken, 256).alias("turns_sha256"),
            F.length("learnt").cast("long").alias("loss_chars"),
            F.sha2("learnt", 256).alias("loss_sha256"),
            "formatted_chars",
            "n_windows",
        )
    )
