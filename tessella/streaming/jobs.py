"""Structured Streaming: sync on changes, and compression of conversations as messages come in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.memory import THRESHOLD
from tessella.operators.sync import sync
from tessella.sources.files import discover, is_ingestable, read_texts


#: Quiet milliseconds after which a path's changes count as one.
DEBOUNCE = 1000


def touched_paths(events: DataFrame) -> DataFrame:
    """path of each file of interest that events (path, and destination of a move) name."""
    paths = F.array_compact(F.array("path", "destination") if "destination" in events.columns else F.array("path"))
    return events.select(F.explode(paths).alias("path")).filter(is_ingestable(F.col("path")))


def debounced(events: DataFrame, quiet: int = DEBOUNCE) -> DataFrame:
    """path and n_events, once a path had no event for so many milliseconds: each event puts its path's timer off anew.

    The state is a count a path that waits; it and its timer outlive a restart. Timers are looked at in every batch, so
    the trigger's interval is how late they may fire; a batch without events looks at them too. Null paths are nothing.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({"path": [key[0]], "n_events": [state.get[0]]})
            state.remove()
        else:
            state.update(((state.get[0] if state.exists else 0) + sum(map(len, batches)),))
            state.setTimeoutDuration(quiet)

    return touched_paths(events).groupBy("path").applyInPandasWithState(run, "path string, n_events long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def on_quiet(events: DataFrame, resync: Callable[[SparkSession, DataFrame], None], checkpoint: str, quiet: int = DEBOUNCE, every: str = "500 milliseconds") -> StreamingQuery:
    """Runs resync with the paths (path, n_events) that have become quiet; paths that are still being written wait.

    A restarted query runs no batch before something comes in, so a beat without paths keeps batches, and timers, going.
    """
    spark = events.sparkSession
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    def batch(df: DataFrame, number: int) -> None:
        rows = df.persist()
        if not rows.isEmpty():
            resync(df.sparkSession, rows)
        rows.unpersist()

    return debounced(events.unionByName(beat), quiet).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def on_changes(events: DataFrame, resync: Callable[[SparkSession, DataFrame], None], checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Runs resync after each batch of change events that has a file of interest (path, and destination of a move).

    A trigger gathers a burst to one batch and batches run one by one, so no change is lost. resync lists the files
    anew: a file stream would see new files but neither edits nor deletions.
    """
    def batch(df: DataFrame, number: int) -> None:
        touched = touched_paths(df).distinct()
        if not touched.isEmpty():
            resync(df.sparkSession, touched)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sync_on_changes(events: DataFrame, root: str, read: Callable[[SparkSession], tuple[DataFrame, DataFrame]], write: Callable[[dict[str, DataFrame]], None], checkpoint: str, every: str | None = "1 second", **how) -> StreamingQuery:
    """Syncs the tables with the files below root after each batch of changes.

    read: the tables of documents and chunks as they are; write: stores what sync() gives, as new versions.
    """
    def resync(spark: SparkSession, touched: DataFrame) -> None:
        disk = read_texts(discover(spark, root))
        write(sync(disk, *read(spark), F.current_timestamp(), **how))

    return on_changes(events, resync, checkpoint, every)


def compress_stream(messages: DataFrame, threshold: int = THRESHOLD, by: str = "conv_id", model: Callable[[str], str] | None = None) -> DataFrame:
    """by, first_message_id, last_message_id, n_messages, summary, as soon as threshold messages of a conversation wait.

    messages: by (long), id, role, content. The state is the lines that wait and the watermark; it is below threshold
    lines unless the model fails (a blank summary), when the lines wait for the next message.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, ids, lines = state.get if state.exists else (0, [], [])
        waiting = dict(zip(ids, lines, strict=True))
        for pdf in batches:
            for i, role, content in zip(pdf["id"], pdf["role"], pdf["content"], strict=True):
                if i > mark:
                    waiting[int(i)] = f"{(role or '').capitalize()}: {content or ''}"
        if 0 < threshold <= len(waiting):
            order = sorted(waiting)
            text = "\n".join(waiting[i] for i in order)
            told = (model(text) if model else text).strip()
            if told:
                mark, waiting = order[-1], {}
                yield pd.DataFrame({by: [key[0]], "first_message_id": [order[0]], "last_message_id": [order[-1]], "n_messages": [len(order)], "summary": [told]})
        state.update((int(mark), sorted(waiting), [waiting[i] for i in sorted(waiting)]))

    out = f"{by} long, first_message_id long, last_message_id long, n_messages long, summary string"
    return messages.select(by, "id", "role", "content").groupBy(by).applyInPandasWithState(run, out, "mark long, ids array<long>, lines array<string>", "append", GroupStateTimeout.NoTimeout)


def status(query: StreamingQuery) -> dict:
    return {"running": query.isActive, "message": query.status["message"], "batches": len(query.recentProgress)}
