"""Following an append-only log: Structured Streaming for tails, windows, duplicates and state machines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, for the offsets and the sink of one run."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def log(spark: SparkSession, path: str, time: str = "ts", files: int = 8) -> DataFrame:
    """A Parquet table as a stream in batches of some files, with its event time as a timestamp (zone of the session).

    ``path`` is a folder or one file; as a pattern it may be either for the file source.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def drain(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what its sink then holds.

    Offsets and results lie in ``folder``: a run that is lost goes on from its last committed batch, and a later call with the
    same folder reads only what has come since.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    run = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def after_cursor(events: DataFrame, cursor: int, id_col: str = "event_id", limit: int = 100) -> DataFrame:
    """The next page of a log: ids above the cursor, ascending, at most ``limit``."""
    return events.where(F.col(id_col) > cursor).orderBy(id_col).limit(limit)


def tumbling(stream: DataFrame, keys: list[str], time: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """``start, end, *keys, events, total``: windows of event time; rows later than ``late`` behind the newest are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "events", "total")


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, late: str | None = None) -> DataFrame:
    """``*keys, start, end, events``: rows that follow each other within ``gap``. For streams give ``late``."""
    rows = df.withWatermark(time, late) if late else df
    return rows.groupBy(*keys, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("events")).select(
        *keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once: later deliveries within the watermark are dropped, so a replay has no effect."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


#: Which event moves a run from which state to which (fixed values). Anything else is a conflict and changes nothing.
TRANSITIONS = {
    ("NEW", "signup"): "QUEUED", ("NEW", "view"): "RUNNING", ("NEW", "click"): "RUNNING", ("QUEUED", "view"): "RUNNING", ("QUEUED", "click"): "RUNNING",
    ("RUNNING", "purchase"): "COMPLETED", ("RUNNING", "error"): "PAUSED", ("PAUSED", "view"): "RUNNING", ("PAUSED", "click"): "RUNNING", ("PAUSED", "error"): "FAILED",
    ("COMPLETED", "view"): "RUNNING", ("FAILED", "signup"): "QUEUED",
}


def fold(state: str, kinds: list[str], transitions: dict = TRANSITIONS) -> tuple[str, int, int]:
    """(state, moves, conflicts) after events in order."""
    moves = conflicts = 0
    for kind in kinds:
        to = transitions.get((state, kind))
        if to:
            state, moves = to, moves + 1
        else:
            conflicts += 1
    return state, moves, conflicts


def state_machine(stream: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """``key, state, moves, conflicts``: one row per key and batch with the state after it; state lives in the engine's store."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, moves, conflicts = held.get if held.exists else ("NEW", 0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        state, more, bad = fold(state, rows[kind].tolist())
        moves, conflicts = moves + more, conflicts + bad
        held.update((state, moves, conflicts))
        yield pd.DataFrame({key: [group[0]], "state": [state], "moves": [moves], "conflicts": [conflicts]})

    key_type = stream.schema[key].dataType.simpleString()
    return stream.select(key, kind, order).groupBy(key).applyInPandasWithState(
        step, f"{key} {key_type}, state string, moves long, conflicts long", "state string, moves long, conflicts long", "append", GroupStateTimeout.NoTimeout)


def latest_state(states: DataFrame, key: str) -> DataFrame:
    """The last row of each key that a state machine has put out: counters never fall, so the greatest is the last."""
    newest = F.max(F.struct(F.col("moves") + F.col("conflicts"), "state", "moves", "conflicts")).alias("m")
    return states.groupBy(key).agg(newest).select(key, "m.state", "m.moves", "m.conflicts")


def replayed(df: DataFrame, key: str, kind: str, order: str, transitions: dict = TRANSITIONS) -> DataFrame:
    """The batch twin of ``state_machine``: a transition table folded over each key's ordered events.

    Rows are range-partitioned by key and order, so that a key of any size is spread over tasks. A task folds the stretch of a
    key that it holds, row by row, from every state; then the few stretches of a key are put together.
    """
    states = sorted({"NEW", *(a for a, _ in transitions), *transitions.values()})

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, ends, moves, n = None, None, list(states), [0] * len(states), 0

        def row(column: str):
            return {key: [last], "first": [first], "ends": [list(ends)], "moves": [list(moves)], "n": [n]}[column]

        for batch in batches:
            done = {c: [] for c in schema.names}
            for k, o, e in zip(*(batch.column(c).to_pylist() for c in (key, order, kind))):
                if not n or k != last:
                    if n:
                        for c in done:
                            done[c] += row(c)
                    last, first, ends, moves, n = k, o, list(states), [0] * len(states), 0
                n += 1
                for i, state in enumerate(ends):
                    to = transitions.get((state, e))
                    if to:
                        ends[i] = to
                        moves[i] += 1
            yield pa.RecordBatch.from_pydict(done, schema)
        if n:
            yield pa.RecordBatch.from_pydict({c: row(c) for c in schema.names}, schema)

    types = df.schema
    out = T.StructType([T.StructField(key, types[key].dataType), T.StructField("first", types[order].dataType), T.StructField("ends", T.ArrayType(T.StringType())),
                        T.StructField("moves", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])
    schema = to_arrow_schema(out)
    stretches = df.select(key, order, kind).repartitionByRange(key, order).sortWithinPartitions(key, order, kind).mapInArrow(step, out)
    listed = stretches.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", "ends", "moves", "n"))).alias("k"))
    start = F.struct(F.lit("NEW").alias("state"), F.lit(0).cast("long").alias("moves"), F.lit(0).cast("long").alias("conflicts"))

    def joined(s, x):
        i = F.array_position(F.array(*map(F.lit, states)), s["state"]).cast("int")
        moved = F.element_at(x["moves"], i)
        return F.struct(F.element_at(x["ends"], i).alias("state"), (s["moves"] + moved).alias("moves"), (s["conflicts"] + x["n"] - moved).alias("conflicts"))

    return listed.select(key, F.aggregate("k", start, joined).alias("s")).select(key, "s.state", "s.moves", "s.conflicts")
