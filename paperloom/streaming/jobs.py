"""Jobs as streams: state machine, recovery, progress, incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: An event's kind -> the state it asks for.
ASKS = {"view": "QUEUED", "click": "RUNNING", "purchase": "COMPLETED", "error": "FAILED"}
STEPS = {("", "QUEUED"), ("QUEUED", "RUNNING"), ("RUNNING", "COMPLETED"), ("RUNNING", "FAILED"), ("QUEUED", "FAILED"), ("COMPLETED", "QUEUED"), ("FAILED", "QUEUED")}
#: A job's stages in order.
STAGES = ("UPLOAD", "EXTRACT", "VERIFY", "NORMALIZE", "EXPORT", "DONE")
STATES = "job long, state string, changes int, refused int, last_event long"


def transition(state: str, asked: str | None) -> tuple[str, bool]:
    """The next state, and whether the step is allowed; a job asked to be what it is stays so."""
    return (asked, True) if (state, asked) in STEPS else (state, asked == state)


def advance(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """State function: job events in order of their ids; a job that hears nothing for the timeout fails."""
    state, changes, refused, last = held.get if held.exists else ("", 0, 0, -1)
    if held.hasTimedOut:
        held.remove()
        if state in ("QUEUED", "RUNNING"):
            yield pd.DataFrame({"job": [key[0]], "state": ["FAILED"], "changes": [changes + 1], "refused": [refused], "last_event": [last]})
        return
    events = pd.concat(list(batches)).sort_values("event_id")
    for event, kind in zip(events["event_id"], events["event_type"], strict=True):
        if event <= last:  # seen before: replays change nothing
            continue
        new, sound = transition(state, ASKS.get(kind))
        changes, refused, state, last = changes + (new != state), refused + (not sound), new, int(event)
    held.update((state, changes, refused, last))
    if held._timeout_conf != "NoTimeout":
        held.setTimeoutDuration(3_600_000)
    yield pd.DataFrame({"job": [key[0]], "state": [state], "changes": [changes], "refused": [refused], "last_event": [last]})


def states(events: DataFrame, timeout: str = GroupStateTimeout.ProcessingTimeTimeout) -> DataFrame:
    """Streaming: events (event_id, user_id as the job, event_type) -> each touched job's state."""
    own = events.select("event_id", F.col("user_id").alias("job"), "event_type")
    return own.groupBy("job").applyInPandasWithState(advance, STATES, "state string, changes int, refused int, last_event long", "update", timeout)


def states_batch(events: DataFrame) -> DataFrame:
    """The same over a table, as an ordered fold inside the JVM; a job's events bound its group."""
    asks = F.create_map(*[F.lit(x) for p in ASKS.items() for x in p])
    per = events.select(F.col("user_id").alias("job"), "event_id", asks[F.col("event_type")].alias("ask")).groupBy("job").agg(F.array_sort(F.collect_list(F.struct("event_id", "ask"))).alias("e"))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("changes"), F.lit(0).alias("refused"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(STEPS)])

    def step(s, x):
        sound = F.array_contains(allowed, F.concat(s["state"], F.lit(">"), F.coalesce(x["ask"], F.lit("?"))))
        same = F.coalesce(x["ask"] == s["state"], F.lit(False))
        return F.struct(F.when(sound, x["ask"]).otherwise(s["state"]).alias("state"), (s["changes"] + sound.cast("int")).alias("changes"), (s["refused"] + (~sound & ~same).cast("int")).alias("refused"))

    return per.select("job", F.aggregate("e", start, step).alias("s"), F.element_at("e", -1)["event_id"].alias("last_event")).select("job", "s.*", "last_event")


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart: what was queued or running failed."""
    lost = F.col("state").isin("QUEUED", "RUNNING")
    return jobs.withColumns({"state": F.when(lost, "FAILED").otherwise(F.col("state")), "error": F.when(lost, "SERVER_RESTARTED")})


def stages(events: DataFrame) -> DataFrame:
    """job, stage, percent, finished of progress events (job, event_id, stage): the furthest stage heard of; unknown stages say nothing."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    per = events.withColumn("rank", rank.cast("int")).where("rank > 0").groupBy("job").agg(F.max("rank").alias("rank"))
    return per.select("job", F.element_at(F.array(*map(F.lit, STAGES)), F.col("rank")).alias("stage"), F.floor(100 * (F.col("rank") - 1) / (len(STAGES) - 1)).cast("int").alias("percent"), (F.col("rank") == len(STAGES)).alias("finished"))


def latest(events: DataFrame, n: int) -> DataFrame:
    """The latest n events (1 to 50), newest first."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, min(50, n)))


def changes(events: DataFrame) -> DataFrame:
    """Progress without repeats: a job's events whose kind differs from the one before."""
    w = W.partitionBy("user_id").orderBy("event_id")
    return events.withColumn("before", F.lag("event_type").over(w)).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type")


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An addition of this library: events and their values by kind and tumbling window, late ones dropped by watermark when streaming."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    per = source.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return per.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ingest(spark: SparkSession, folder: str, checkpoint: str, batch: Callable[[DataFrame, int], None], pattern: str = "*"):
    """Starts a stream over new files of a folder, one batch function a trigger; rerunning reads each file once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
