"""File events: trigger rules, debouncing, rate limits and incremental builds.

Stateful operators fold over a key's events in time order, in a batch or in a
stream; the state of a key is one timestamp or two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import any_of, attribute_key, digest, file_name, rendered
from tessella.operators.imports import import_edges
from tessella.plans.staging import stage
from tessella.schema import EDGE
from tessella.sources.edges import EdgeStore, new_edges


@dataclass(frozen=True)
class Trigger:
    name: str
    pattern: str
    events: tuple[str, ...] = ("write",)
    builtin: str | None = "parse-and-diff"
    command: str | None = None
    debounce_ms: int = 500


#: The patterns watched by default, and the beginning of their triggers' names.
DEFAULT_PATTERNS = ["*.go", "*.rs", "*.py", "*.ts", "*.js", "*.java", "*.c", "*.cpp", "*.rb"]
DEFAULT_NAME = "update-graph-"
DEFAULT_TRIGGERS = [Trigger(DEFAULT_NAME + p[2:], p) for p in DEFAULT_PATTERNS]
#: Actions that run at once; what comes while all are busy is dropped.
CONCURRENT = 4


def matches(path: Column, pattern: str) -> Column:
    """On the file name: ``*`` is all, ``*x`` an ending, anything else the whole name."""
    name = file_name(path)
    if pattern == "*":
        return F.lit(True)
    return name.endswith(pattern[1:]) if pattern.startswith("*") else name == pattern


def triggered(events: DataFrame, triggers: list[Trigger]) -> DataFrame:
    """``events`` (``path, event_type, ...``) once for each trigger that wants them, with ``trigger, ord``.

    Rules are compiled to one array expression, so neither a join nor a
    shuffle is needed, in batch or stream.
    """
    hits = [
        F.when(matches(F.col("path"), t.pattern) & F.col("event_type").isin(list(t.events)), F.struct(F.lit(i).alias("ord"), F.lit(t.name).alias("trigger")))
        for i, t in enumerate(triggers)
    ]
    if not hits:
        return events.withColumn("ord", F.lit(0)).withColumn("trigger", F.lit("")).where(F.lit(False))
    wanted = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return events.withColumn("__t", F.explode(wanted)).select(*events.columns, "__t.ord", "__t.trigger")


def debounced(events: DataFrame, keys: list[str], window_us: int, ts: str = "ts") -> DataFrame:
    """``keys, ts`` of the events that fire: the first, then each at least a window after the last that fired.

    Suppressed events do not extend the pause.
    """

    def step(last, t):
        return (t, True) if last is None or t - last >= window_us else (last, None)

    return _folded(events, keys, ts, step).drop("kept")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _folded(events: DataFrame, keys: list[str], ts: str, step) -> DataFrame:
    """``keys, ts, kept``: a fold over each key's events in time order.

    ``step(state, time)`` gives the next state and what to keep (None: no row).
    Partitions are sorted by key and time and streamed, so a task holds one
    batch and one state, however many events a key has.
    """
    rows = events.select(*keys, micros(ts).alias("__t")).repartition(*keys).sortWithinPartitions(*keys, "__t")
    out = T.StructType([*(events.schema[k] for k in keys), T.StructField("__t", T.LongType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        before, state = None, None
        for batch in batches:
            at, kept = [], []
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            for i, (key, t) in enumerate(zip(zip(*columns), batch.column(len(keys)).to_pylist())):
                if key != before:
                    before, state = key, None
                state, keep = step(state, t)
                if keep is not None:
                    at.append(i)
                    kept.append(keep)
            chosen = pa.array(at, pa.int32())
            columns = [batch.column(i).take(chosen) for i in range(len(keys) + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.bool_())], names=out.names)

    found = rows.mapInArrow(run, out)
    return found.select(*keys, F.timestamp_micros("__t").cast(events.schema[ts].dataType).alias(ts), "kept")


def debounced_stream(events: DataFrame, keys: list[str], window_us: int, ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """The streaming form of :func:`debounced`; events of a batch are taken in time order.

    State is a key's last firing and is dropped when the watermark passes it.
    """
    fields = [f for f in events.schema.fields if f.name in keys]
    out = T.StructType([*sorted(fields, key=lambda f: keys.index(f.name)), T.StructField(ts, T.TimestampType())])

    def fold(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(int(t.value // 1000) for b in batches for t in b[ts])
        fired = []
        for t in times:
            if last is None or t - last >= window_us:
                last = t
                fired.append(t)
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last // 1000) + window_us // 1000 + 1)
        yield pd.DataFrame({**{k: [v] * len(fired) for k, v in zip(keys, key)}, ts: pd.to_datetime(fired, unit="us")})

    grouped = events.withWatermark(ts, watermark).groupBy(*keys)
    return grouped.applyInPandasWithState(fold, out, "last long", "append", "EventTimeTimeout")


def admitted(fired: DataFrame, duration_us: int, limit: int = CONCURRENT, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """``keys, ts, admitted``: which actions run if each takes ``duration_us`` and ``limit`` may run at once.

    An action that comes while all places are busy is dropped, not queued.
    ``keys`` are independent runners; without any all share one.
    """

    def step(busy, t):
        busy = tuple(end for end in busy or () if end > t)
        return (busy + (t + duration_us,), True) if len(busy) < limit else (busy, False)

    rows = fired if keys else fired.withColumn("runner", F.lit(0))
    return _folded(rows, keys or ["runner"], ts, step).withColumnRenamed("kept", "admitted")


def trailing_debounced(events: DataFrame, keys: list[str], gap: str, ts: str = "ts") -> DataFrame:
    """``keys, ts``: one row per burst, at its last event (a native session window; batch or stream)."""
    sessions = events.groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return sessions.agg(F.max(ts).alias("last")).select(*keys, F.col("last").alias(ts))


def rate_limited(calls: DataFrame, keys: list[str], rate: float, ts: str = "ts") -> DataFrame:
    """``keys, ts, allowed`` by a token bucket: ``rate`` tokens a second, at most ``rate``, one a call; 0 allows all."""
    rate = float(rate)

    def step(state, t):
        tokens, last = (rate, t) if state is None else state
        tokens = min(rate, tokens + (t - last) / 1e6 * rate)
        allowed = rate == 0 or tokens >= 1
        return (tokens - 1 if allowed else tokens, t), allowed

    return _folded(calls, keys, ts, step).withColumnRenamed("kept", "allowed")


def commands(fired: DataFrame, triggers: list[Trigger]) -> DataFrame:
    """Rendered shell commands of fired triggers, as rows (``trigger, path, command``); none is run."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    for t in triggers:
        if t.command:
            out = out.when(F.col("trigger") == t.name, rendered(t.command, F.col("path"), when))
    return fired.select("trigger", "path", out.alias("command")).where("command is not null")


def uploads(files: DataFrame, backend: str) -> DataFrame:
    """``path, key, value`` rows that an upload of ``path, content, ts`` leaves: backend, hash, upload time."""
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = F.array(*[F.struct(F.lit(f"user.vfs.{k}").alias("key"), v.alias("value")) for k, v in (("backend", F.lit(backend)), ("hash", digest(F.col("content"))), ("uploaded_at", when))])
    return files.select("path", F.explode(rows).alias("e")).select("path", "e.key", "e.value")


def after_action(fired: DataFrame, setting: str) -> DataFrame:
    """``path, key, value`` rows of a trigger's ``key=value`` action; the value may be a template."""
    key, _, value = setting.partition("=")
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return fired.select("path", attribute_key(F.lit(key.strip())).alias("key"), rendered(value.strip(), F.col("path"), when).alias("value"))


class ParseState:
    """Edges parsed so far, as Parquet in buckets of their path beside the record.

    A changed file is compared with its own edges only, so a batch reads the
    buckets of its paths and not the whole record.
    """

    def __init__(self, store: EdgeStore):
        self.spark, self.path = store.spark, f"{store.folder}/parsed.parquet"

    def exists(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def known(self, paths: DataFrame) -> DataFrame:
        """Edges parsed for the given paths (``path``); only their buckets are read."""
        buckets = [r[0] for r in paths.select(_bucket(F.col("path"))).distinct().collect()]
        found = self.spark.read.schema(T.StructType([*EDGE.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)
        near = found.where(F.col("bucket").isin(buckets)).select(*EDGE.names)
        return near.join(paths.select(F.col("path").alias("src")), "src", "left_semi").select(*EDGE.names)

    def add(self, edges: DataFrame) -> None:
        edges.withColumn("bucket", _bucket(F.col("src"))).write.mode("append").partitionBy("bucket").parquet(self.path)


#: Buckets of parsed paths.
BUCKETS = 256


def _bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def parse_and_diff(files: DataFrame, store: EdgeStore) -> int:
    """Append the edges of changed files (``path, text``) that were not parsed from them before; how many.

    Edges are never retracted; a batch without changed edges writes nothing.
    """
    state = ParseState(store)
    if not state.exists():  # once for a store
        state.add(store.load())
    fresh = stage(new_edges(import_edges(files), state.known(files.select("path").distinct())), "fresh")
    n = fresh.count()
    if n:
        store.append(fresh)
        state.add(fresh)
    return n


def build_stream(files: DataFrame, store: EdgeStore, checkpoint: str, **options):
    """Start an incremental build from a stream of ``path, text``; returns the streaming query.

    How much a batch takes is set where the stream is read (``maxFilesPerTrigger``).
    """
    return files.writeStream.foreachBatch(lambda batch, _: parse_and_diff(batch, store)).option("checkpointLocation", checkpoint).trigger(availableNow=options.get("available_now", True)).start()


def wanted(path: Column, triggers: list[Trigger]) -> Column:
    return any_of(matches(path, t.pattern) for t in triggers)
