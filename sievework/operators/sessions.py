"""Message history per session.

A session may hold a large part of all messages, so positions are counted in two steps: rows per (session, block of
turns) first, then the blocks' offsets. No task orders a whole session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_TURNS = 4096


def running_count(df: DataFrame, session: str, turn: str, out: str = "message_count", block: int = BLOCK_TURNS):
    """Messages of the session up to and including the row; turn is unique within a session."""
    blocked = df.withColumn("_block", F.floor(F.col(turn) / block))
    sizes = blocked.groupBy(session, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(session).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(session, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(session, "_block").orderBy(turn))
    return (
        blocked.withColumn("_inside", inside)
        .join(offsets, [session, "_block"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_block", "_inside", "_before")
    )


def session_history(df: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The ordered message list as rows: position from 1, role, content."""
    return running_count(df, session, turn, "position").select(session, "position", turn, "role", "content")


def session_state(df: DataFrame, session: str = "conv_id", time: str = "turn") -> DataFrame:
    """One row per session: number of messages, first and last time. Summed before the shuffle."""
    return df.groupBy(session).agg(
        F.count(F.lit(1)).alias("message_count"), F.min(time).alias("created_at"), F.max(time).alias("updated_at")
    )


def session_payload(
    history: DataFrame, memories: DataFrame, session: str = "conv_id", rank: Column | None = None
) -> DataFrame:
    """One row per session: count, last turn, and the memories found for it as a bullet list.

    memories: session, rank, text; at most k rows per session. The messages themselves stay rows of session_history.
    """
    from .context import ordered_join

    state = session_state(history, session, "turn")
    listed = memories.groupBy(session).agg(
        ordered_join(rank if rank is not None else F.col("rank"), F.concat(F.lit("• "), F.col("text")), "\n").alias(
            "memory"
        )
    )
    return state.join(listed, session, "left").select(
        session,
        "message_count",
        "updated_at",
        F.coalesce("memory", F.lit("No relevant memory retrieved.")).alias("memory"),
    )


INSTRUCTIONS = "This is the contextual payload for the session."


def payload_parts(
    history: DataFrame, memories: DataFrame, session: str = "conv_id", rank: Column | None = None, block: int = BLOCK_TURNS
) -> DataFrame:
    """The payload with its messages: rows (session, part, messages, and what `session_payload` gives).

    messages is an array of (role, content) in order; a session of more than `block` messages has several parts, so no row
    grows with its session.
    """
    placed = running_count(history, session, "turn", "position", block)
    parts = placed.groupBy(session, F.floor((F.col("position") - 1) / block).cast("int").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("position", "role", "content"))).alias("listed")
    )
    messages = F.transform("listed", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    head = session_payload(history, memories, session, rank)
    return parts.select(session, "part", messages.alias("messages")).join(head, session)
