"""Perspective rotation of dialogues: every participant in turn is the assistant.

The turns of a dialogue are gathered once, then rendered for each participant by array expressions: the participant's
turns as assistant, the others as users with their names, context roles as they are. The loss mask is given as run
lengths over the rendered text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import numbered, quoted, stored

SEGMENT_TURNS = 1024
CONTEXT_ROLES = ("system",)
UNNAMED = "unknown"
#: Fixed values of the chat format.
START, END = "<|im_start|>", "<|im_end|>\n"


def _inert(text: Column) -> Column:
    """Text in which no marker of the format can be read."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _positioned(turns: DataFrame) -> DataFrame:
    """Add ``_position``, from 0, of each turn in its conversation.

    Turns are dealt out by ranges of their order, whatever the conversation, equal turns apart; so a conversation of
    any size is cut into pieces that are numbered alone, and only its pieces' counts meet.
    """
    spark = turns.sparkSession
    order = [F.asc_nulls_first("_conv"), F.asc("_turn"), F.asc("_row")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = turns.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
    pieces = stored(ranged.withColumn("_piece", F.spark_partition_id()), "turns")
    key = F.coalesce(F.concat(F.lit("="), F.col("_conv").cast("string")), F.lit(""))  # of a null conversation: empty
    found = numbered(pieces.withColumn("_key", key), ["_key"], "_piece", [F.col("_turn")], "_position")
    return found.select("_conv", "_turn", "_position")


def rotate(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    context_roles: Sequence[str] = CONTEXT_ROLES,
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """One row per (conversation, segment, participant): rendered dialogue and loss mask.

    A participant is any speaker of the conversation outside ``context_roles``. Columns: the conversation,
    ``segment`` (position of the turn, from 0, div ``segment_turns``, so that a conversation of any length is
    rendered in bounded pieces), ``perspective``, ``n_turns``, ``n_trained`` (the participant's own), ``rendered`` and ``mask_runs``:
    lengths in code points of text without and with loss in turns, joined by blanks, the first without. Loss is
    on the participant's words and the end mark after them.

    Turns are ordered by number, then speaker, then text; repeated rows are rendered again. A null turn number
    comes first; a null speaker is called ``unknown``; a null text is empty; null conversations are one. A
    conversation with context turns only has no row. A participant who is silent in a segment still has the row of
    that segment. Other columns are left out. An empty table gives an empty one.
    """
    who = F.regexp_replace(_inert(F.coalesce(quoted(speaker), F.lit(UNNAMED))), r"[\r\n]", " ")
    turns = turns.select(
        quoted(conversation).alias("_conv"),
        F.struct(
            quoted(turn).alias("turn"), who.alias("who"), _inert(F.coalesce(quoted(text), F.lit(""))).alias("said")
        ).alias("_turn"),
    )
    turns = _positioned(turns).withColumn("_segment", F.floor(F.col("_position") / segment_turns)).drop("_position")
    spoken = ~F.col("_turn.who").isin(*context_roles) if context_roles else F.lit(True)
    people = turns.where(spoken).select("_conv", F.col("_turn.who").alias("perspective")).distinct()
    segments = turns.groupBy("_conv", "_segment").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    views = segments.join(people, segments["_conv"].eqNullSafe(people["_conv"])).drop(people["_conv"])
    context = "t.who IN ({})".format(", ".join(f"'{r}'" for r in context_roles)) if context_roles else "false"
    head = f"""concat('{START}', CASE WHEN t.who = perspective THEN 'assistant' WHEN {context} THEN t.who
        ELSE concat('user name=', t.who) END, '\\n')"""
    pieces = f"transform(_turns, t -> struct({head} AS head, concat(t.said, '{END}') AS body, t.who = perspective AS own))".replace("'<|im_end|>\n'", "'<|im_end|>\\n'")
    # Text without loss is summed up to the next own turn: a running sum restarts there.
    runs = """aggregate(_pieces, named_struct('open', 0L, 'done', ''),
        (a, p) -> named_struct(
            'open', IF(p.own, 0L, a.open + char_length(p.head) + char_length(p.body)),
            'done', IF(p.own, concat(a.done, a.open + char_length(p.head), ' ', char_length(p.body), ' '), a.done)),
        a -> rtrim(concat(a.done, IF(a.open > 0, CAST(a.open AS string), ''))))"""
    return (
        views.withColumn("_pieces", F.expr(pieces))
        .select(
            F.col("_conv").alias(conversation),
            F.col("_segment").alias("segment"),
            "perspective",
            F.size("_pieces").cast("long").alias("n_turns"),
            F.size(F.expr("filter(_pieces, p -> p.own)")).cast("long").alias("n_trained"),
            F.array_join(F.expr("transform(_pieces, p -> concat(p.head, p.body))"), "").alias("rendered"),
            F.expr(runs).alias("mask_runs"),
        )
    )
