"""The state of a dialogue: what it is about, what is known, and whether an answer to a question back is awaited.

Each user's message is new, a follow-up, or a clarification that was asked for.
A new one sets subject, action and facts; the others add facts.  This is the
batch form, by windows; :mod:`docengine.streaming.dialogue` keeps the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import contains_any
from docengine.operators.understanding import FACTS, FOLLOW_UP, action, stated_facts, subject

#: A message of fewer characters is a follow-up. Fixed value.
SHORT = 50

#: Between a question and the clarification that it was asked back for. Fixed value.
DETAILS = "\n\nDetalii suplimentare: "


def added_facts(text: Column) -> Column:
    """What a clarification or follow-up adds: materials, an inner installation, numbers."""
    low = F.lower(text)
    named = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), fact) for w, fact in FACTS if w != "exterior"]))
    return F.concat(named, F.regexp_extract_all(text, F.lit(r"(?i)\d+\s*(?:mm|mm²|A|tablouri|tablou)"), F.lit(0)))


def marked(turns: DataFrame) -> DataFrame:
    """What each message of a user or assistant says by itself; a null text is empty.

    ``turns``: ``conv_id, turn, role, text`` and ``asks``, whether an assistant's
    message asks back.  Messages of other roles are no part of the dialogue.
    """
    said = F.coalesce("text", F.lit(""))
    user = F.col("role") == "user"
    return turns.where(F.col("role").isin("user", "assistant")).select(
        "conv_id",
        "turn",
        user.alias("user"),
        said.alias("said"),
        (~user & F.coalesce("asks", F.lit(False))).alias("asks"),
        ((F.char_length(said) < SHORT) | contains_any(said, FOLLOW_UP)).alias("leans"),
        subject(said).alias("subject"),
        action(said).alias("action"),
        F.array_distinct(stated_facts(said)).alias("stated"),
        added_facts(said).alias("added"),
    )


def focused(known: Column, about: Column, wanted: Column, facts: Column, said: Column) -> Column:
    """Action, subject and facts in front of what is said."""
    return F.when(known, F.array_join(F.concat(F.array(wanted, about), facts, F.array(said)), " ")).otherwise(said)


def dialogue(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, kind, subject, action, facts, combined, focused`` of every user's message.

    ``kind``: new, follow_up or clarification.  ``combined`` puts the question
    that was asked back in front of a clarification; ``focused`` puts action,
    subject and facts in front.  A follow-up before any question has no subject.
    Turns of one conversation differ; its messages meet in one task, as one
    dialogue is one thread.  An empty table gives an empty result.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marked(turns).withColumns({"place": F.row_number().over(w), "stretch": F.sum(F.col("user").cast("int")).over(upto) - F.col("user").cast("int")})
    # the stretch of a message: how many users' messages are in front of it
    rows = rows.withColumn("waiting", (F.col("stretch") > 0) & F.bool_or("asks").over(Window.partitionBy("conv_id", "stretch")))
    rows = rows.withColumn("pending", F.last(F.when(F.col("user"), F.col("said")), ignorenulls=True).over(before)).where("user")
    follow = (F.col("place") > 1) & (F.col("waiting") | F.col("leans"))
    rows = rows.withColumn("new", ~follow).withColumn("intent", F.sum(F.col("new").cast("int")).over(upto))
    own = Window.partitionBy("conv_id", "intent").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("intent") > 0
    facts = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("new"), F.col("stated")).otherwise(F.col("added"))).over(own)))
    rows = rows.withColumns({"facts": F.when(known, facts).otherwise(F.array().cast("array<string>")), "about": F.when(known, F.first("subject").over(own)), "wanted": F.when(known, F.first("action").over(own))})
    combined = F.when(F.col("waiting"), F.concat("pending", F.lit(DETAILS), "said")).otherwise(F.col("said"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("waiting"), "clarification").when(F.col("new"), "new").otherwise("follow_up").alias("kind"),
        F.col("about").alias("subject"),
        F.col("wanted").alias("action"),
        "facts",
        combined.alias("combined"),
        focused(known, F.col("about"), F.col("wanted"), F.col("facts"), F.col("said")).alias("focused"),
    )
