"""Structured Streaming forms: windowed usage and rates, replacement by source, bounded histories, silent sources, new files only."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftwell import schemas
from siftwell.functions.scores import cost
from siftwell.sources import versions


def json_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def usage_by_window(calls: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls, tokens, cost and failures for each source and event-time window; a call may be ``late``."""
    timed = calls.withColumn("ts", F.try_to_timestamp("ts")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "source").agg(
        F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.sum(cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))).alias("cost_cny"), F.count_if(~F.col("success")).alias("failures"),
    )


def upsert_stream(chunks: DataFrame, path: str, checkpoint: str, source: str = "source"):
    """A started query that replaces each source's rows, in a table in versions, by those of the newest batch that has it.

    A batch that runs again after a failure is told by its number and the ``checkpoint``, and changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        versions.replace(batch, path, source, batch=(checkpoint, number))

    return chunks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


#: The state store that state with expiry and timers needs; set it on the session before such a stream starts.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TURN = "turn long, text string"
HISTORY = "conv_id long, turns array<long>, texts array<string>"


class _LastTurns(StatefulProcessor):
    """Keeps the last ``n`` turns of a conversation; they expire ``idle_ms`` after the batch that last touched it (0: never)."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", TURN, self.idle_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {(t, x) for t, x in self.kept.get()}
        for part in rows:
            seen |= {(t, x) for t, x in zip(part["turn"], part["text"], strict=True) if not pd.isna(t)}
            seen = set(self._last(seen))  # a batch may bring many turns
        if not seen:
            return
        last = self._last(seen)
        self.kept.put(last)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[t for t, _ in last]], "texts": [[x for _, x in last]]})

    def _last(self, seen) -> list[tuple[int, str | None]]:
        return sorted(((int(t), x) for t, x in seen), key=lambda r: (r[0], r[1] is not None, r[1] or ""))[-self.n :]

    def close(self) -> None:
        pass


def histories(turns: DataFrame, n: int = 20, idle: timedelta | None = None) -> DataFrame:
    """(conv_id, turns, texts): after each batch the last ``n`` texts of every conversation it touched; state is bounded by ``n``.

    Turns may come late, in any order: they stand by turn, then by text, nulls first. A turn and text that come again count
    once; rows without a turn take no part. A conversation that no batch touches for ``idle`` is forgotten, and starts anew if
    it comes again; such a stream asks for batches all the time, so it takes a trigger by the clock, not one that ends.
    State is held outside the heap by the store ROCKSDB.
    """
    turns.sparkSession.conf.set(*ROCKSDB)
    keep = _LastTurns(n, int(idle.total_seconds() * 1000) if idle else 0)
    return turns.groupBy("conv_id").transformWithStateInPandas(keep, HISTORY, "update", "processingTime" if idle else "none")


class _Silence(StatefulProcessor):
    """Tells when a source that said it was running has not been heard from, once for each silence."""

    def __init__(self, stale_ms: int, event_time: bool):
        self.stale_ms, self.event_time = stale_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, updated_at timestamp, silent boolean")

    def _told(self, key, state, at, event: str) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]], "state": [state], "updated_at": [at], "event": [event]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = [(at, "" if pd.isna(state) else state) for part in rows for at, state in zip(part["updated_at"], part["state"], strict=True) if not pd.isna(at)]
        held = tuple(self.last.get()) if self.last.exists() else None
        if not beats or (held and max(beats)[0] <= pd.Timestamp(held[1])):
            return  # nothing newer
        at, state = max(beats)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == "running":
            now = int(at.timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.stale_ms)
        self.last.update((state, at.to_pydatetime(), False))
        if held and held[2]:
            yield self._told(key, state, at, "back")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, at, _ = self.last.get()
        self.last.update((state, at, True))
        yield self._told(key, state, pd.Timestamp(at), "silent")

    def close(self) -> None:
        pass


def silences(beats: DataFrame, stale: timedelta = timedelta(seconds=120), late: str | None = None) -> DataFrame:
    """(source, state, updated_at, event) from a stream (source, state, updated_at): ``silent`` and ``back``.

    A source whose newest beat says ``running`` is silent ``stale`` after the batch that brought it, told once by a timer, with no
    need of further rows; its next beat is told as back. Any other state ends the watch. Beats not newer than the newest one
    known, and those without a time, change nothing. With ``late`` time is that of the rows: a source is silent when
    the watermark, ``late`` behind the newest beat of all, has passed its own by ``stale``, which replays alike. Without it the
    stream takes a trigger by the clock, not one that ends.
    """
    beats.sparkSession.conf.set(*ROCKSDB)
    timed = beats.withWatermark("updated_at", late) if late else beats
    watch = _Silence(int(stale.total_seconds() * 1000), bool(late))
    shape = "source string, state string, updated_at timestamp, event string"
    return timed.groupBy("source").transformWithStateInPandas(watch, shape, "append" if late else "update", "eventTime" if late else "processingTime")


def rate_by_window(records: DataFrame, time: str, window: str = "10 minutes", slide: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """(window, n, per_minute): records of each sliding window, as a stream; a record may be ``late``."""
    minutes = (F.unix_timestamp("window.end") - F.unix_timestamp("window.start")) / 60
    counted = records.withWatermark(time, late).groupBy(F.window(time, window, slide)).agg(F.count("*").alias("n"))
    return counted.withColumn("per_minute", F.col("n") / minutes)


def new_only(incoming: DataFrame, done: DataFrame, key: str = "bbbs") -> DataFrame:
    """Records not crawled yet, or crawled without articles: what a resumed run still has to fetch."""
    return incoming.join(done.filter(F.size("articles") > 0).select(key), key, "left_anti")


def resumed(records: DataFrame, done: DataFrame, time: str, late: str = "1 day", key: str = "bbbs") -> DataFrame:
    """The records of a stream that still have to be fetched, each key once while ``late`` lasts.

    Read from files with a checkpoint a run goes on where the last one ended; a key that comes again, in this run or a later
    one, is dropped while the watermark remembers it, and after that by ``done``, the static table of what was fetched.
    """
    once = records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return new_only(once, done, key)


def heartbeat(beats: DataFrame, now: float, stale: float = 120.0) -> DataFrame:
    """``beats`` with ``alive``: running and heard from within ``stale`` seconds."""
    return beats.withColumn("alive", (F.col("state") == "running") & (F.lit(now) - F.col("updated_at") <= stale))


CALLS, FEEDBACK = schemas.LLM_CALL, schemas.FEEDBACK
