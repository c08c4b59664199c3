"""Live queries: added, updated and removed rows of a condition, from a stream of changes.

A change is (seq, op, row...): INSERT, UPDATE or DELETE of a row in its new state (its last one for DELETE).
An insert that matches is added; an update that matches is updated, even if the row did not match before; an
update that no longer matches removes a row that was a member; a delete removes a member or a match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED, UPDATED, REMOVED = "added", "updated", "removed"


def event(op: Column, matches: Column, was: Column) -> Column:
    """The event of one change, or null."""
    return F.when(op == "DELETE", F.when(was | matches, REMOVED)).when(matches, F.when(op == "INSERT", ADDED).otherwise(UPDATED)).when(was & (op == "UPDATE"), REMOVED)


def deltas(changes: DataFrame, matches: Column, key: str, members: DataFrame | None = None) -> DataFrame:
    """changes that are events, with `event`; members (key): rows that match before the first change.

    Whether a row was a member before a change is whether its change before that matched, so one window over
    each row's own changes is all the state there is.
    """
    marked = changes.withColumn("_m", F.coalesce(matches, F.lit(False)) & (F.col("op") != "DELETE"))
    marked = marked.withColumn("_hit", F.coalesce(matches, F.lit(False)))
    before = F.lag("_m").over(Window.partitionBy(key).orderBy("seq"))
    if members is not None:
        marked = marked.join(members.select(key).distinct().withColumn("_first", F.lit(True)), key, "left")
        before = F.coalesce(before, F.col("_first"))
    marked = marked.withColumn("_was", F.coalesce(before, F.lit(False)))
    out = marked.withColumn("event", event(F.col("op"), F.col("_hit"), F.col("_was"))).filter(F.col("event").isNotNull())
    return out.select("event", *changes.columns)


def live(changes: DataFrame, matches: Column, key: str) -> DataFrame:
    """The same events from a stream: (event, key, seq, row as JSON). State is one flag for each row that is a member.

    Changes of a row that come in one batch are taken by seq; later batches are later.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = F.to_json(F.struct(*changes.columns))
    ready = changes.select(F.col(key).cast("string").alias("pk"), "seq", "op", F.coalesce(matches, F.lit(False)).alias("hit"), rows.alias("row"))

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else False
        part = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, op, hit, row in part[["seq", "op", "hit", "row"]].itertuples(index=False):
            if op == "DELETE":
                found = REMOVED if was or hit else None
                was = False
            else:
                found = (ADDED if op == "INSERT" else UPDATED) if hit else REMOVED if was and op == "UPDATE" else None
                was = bool(hit)
            if found:
                out.append((found, group[0], int(seq), row))
        if was:
            state.update((True,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["event", "pk", "seq", "row"])

    return ready.groupBy("pk").applyInPandasWithState(step, "event string, pk string, seq long, row string", "member boolean", "append", GroupStateTimeout.NoTimeout)


def snapshot_and_deltas(table: DataFrame, changes: DataFrame, matches: Column, key: str) -> DataFrame:
    """First the rows that match now (`snapshot`), then the events of the changes, as one table ordered by seq."""
    now = table.filter(matches)
    first = now.select(F.lit("snapshot").alias("event"), F.lit(0).cast("long").alias("seq"), *table.columns)
    later = deltas(changes, matches, key, now.select(key))
    return first.unionByName(later.select("event", "seq", *table.columns))


class Listener:
    """A running live query that calls back for each event of a batch; callbacks run on the driver, row by row."""

    def __init__(self, changes: DataFrame, matches: Column, key: str, on: dict[str, Callable], checkpoint: str, available_now: bool = False):
        def deliver(batch: DataFrame, _: int) -> None:
            for row in batch.orderBy("seq").toLocalIterator():
                if row["event"] in on:
                    on[row["event"]](row)

        writer = live(changes, matches, key).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(deliver)
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()

    def stop(self) -> None:
        self.query.stop()
