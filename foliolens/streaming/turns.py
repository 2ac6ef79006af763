"""Turn activation on a stream: what each turn heard, kept by conversation, then matched against the entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliolens.operators.slots import hits


def heard(turns: DataFrame, idle: str = "1 hour") -> DataFrame:
    """conv_id, turn, heard of each assistant turn of a stream of (conv_id, turn, role, text).

    The state of a conversation is its last turn; it goes when nothing comes for ``idle``.  Turns of one
    conversation must arrive in order over micro-batches; within one they are sorted.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("turn")
        last = state.get[0] if state.exists else None
        before = [last, *rows.text.iloc[:-1]]
        state.update((rows.text.iloc[-1],))
        state.setTimeoutDuration(millis)
        out = pd.DataFrame({"conv_id": key[0], "turn": rows.turn, "heard": before})
        yield out[(rows.role == "assistant").to_numpy() & out.heard.notna().to_numpy()]

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, heard string", "last string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def activated(turns: DataFrame, entries: DataFrame):
    """A foreachBatch-ready pair: the stream of what was heard, and the function that matches one batch of it."""

    def match(batch: DataFrame) -> DataFrame:
        scenes = batch.select(F.concat_ws(":", "conv_id", "turn").alias("label"), F.col("heard").alias("text"))
        found, where = hits(scenes, entries), F.split("label", ":")
        return found.select(where[0].cast("long").alias("conv_id"), where[1].cast("long").alias("turn"), "entry_id", "rank")

    return heard(turns), match
