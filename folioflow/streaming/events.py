"""Event streams: debounced changes, folded progress, gathered messages.

Each function takes a batch or a streaming DataFrame with ts as a timestamp;
streaming ones need a watermark, which ``timed`` sets, only so that Spark can drop
state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

GAP = "500 milliseconds"
#: Seconds of event time after which a key without parts is done.
IDLE = 60.0
# File kinds that a watcher reports, and folders that it ignores.
WATCHED = (
    ".md", ".mdx", ".markdown", ".txt", ".text", ".json", ".jsonc", ".json5", ".yaml", ".yml", ".toml",
    ".xml", ".xhtml", ".svg", ".csv", ".tsv", ".pdf",
)
IGNORED = (
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", ".next", ".nuxt", ".output", "coverage",
    "__pycache__", ".pytest_cache", ".mypy_cache", "venv", ".venv", "env", ".env", "vendor", "target", ".idea", ".vscode",
)


def timed(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """``events`` with ts as a timestamp (watermarks refuse ones without a zone)."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", delay) if events.isStreaming else out


def after_grace(events: DataFrame, started: Column, seconds: float = 1.0) -> DataFrame:
    """Events from a second after the watch began on."""
    return events.where(F.unix_micros("ts") - F.unix_micros(started) >= int(seconds * 1e6))


def watched(events: DataFrame, path: str = "path") -> DataFrame:
    known = F.lower(F.regexp_extract(path, r"(\.[^.]+)$", 1)).isin(*WATCHED)
    return events.where(known & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED))))


def debounced(events: DataFrame, folder: str = "folder", path: str = "path", gap: str = GAP) -> DataFrame:
    """(folder, from, to, n_paths, changes): events of a folder in batches that a pause
    of at least the gap ends; of a path the last change counts."""
    session = F.session_window("ts", gap)
    change = F.struct(F.col(path).alias("path"), "ts", "event_id", F.col("type"))
    # Changes in the order of their paths; of each path the last one stays.
    rows = events.groupBy(session.alias("w"), F.col(folder)).agg(F.array_sort(F.collect_list(change)).alias("all"))
    last = F.filter("all", lambda x, i: F.coalesce(F.get("all", i + 1)["path"] != x["path"], F.lit(True)))
    rows = rows.select(folder, F.col("w.start").alias("from"), F.col("w.end").alias("to"), last.alias("last"))
    said = F.transform("last", lambda x: F.concat(x["path"], F.lit("="), x["type"]))
    return rows.select(folder, "from", "to", F.size("last").cast("long").alias("n_paths"), said.alias("changes"))


def progress(patches: DataFrame, key: str, fields: list[str], at: str = "ts") -> DataFrame:
    """The state of each key after its patches: the last value of each field that is
    not null, the first time as started_at, the last as updated_at."""
    order = F.struct(at, "event_id")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return patches.groupBy(key).agg(*last, F.min(at).alias("started_at"), F.max(at).alias("updated_at"))


def counters(events: DataFrame, key: str, done: Column) -> DataFrame:
    """Totals and finished ones of each key, as a queue shows them."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("processed"))


def gathered(parts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Messages put together from their parts in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return parts.groupBy(key).agg(F.array_join(F.transform(rows, lambda p: p[text]), "").alias("message"), F.count(F.lit(1)).alias("parts"))


class _Kept(StatefulProcessor):
    """One buffer a key, which goes after ``idle`` milliseconds without parts; what it
    still holds is handed out then. ``step`` gives (state, rows) of a state and the next
    parts, ``last`` the rows of a state that goes."""

    def __init__(self, state: str, empty: tuple, step, last, columns: list[str], idle: int | None, at: str | None):
        self.schema, self.empty, self.step, self.last, self.columns, self.idle, self.at = state, empty, step, last, columns, idle, at

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("buffer", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        parts = pd.concat(list(rows)).sort_values("seq")
        state, out = self.step(tuple(self.state.get() or self.empty), [p if isinstance(p, str) else "" for p in parts["part"]])
        self.state.update(state)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)
        if self.idle is None:
            return
        # The timer moves on with the newest part.
        now = timerValues.getCurrentProcessingTimeInMs() if self.at is None else int(parts[self.at].max().timestamp() * 1000)
        earlier = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if not earlier or now + self.idle > max(earlier):
            for timer in earlier:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = self.last(tuple(self.state.get() or self.empty))
        self.state.clear()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def close(self) -> None:
        pass


def _kept(parts: DataFrame, key: str, at: str | None, idle: float | None, state: str, empty: tuple, step, last, out: str) -> DataFrame:
    columns = [f.split(" ")[0] for f in out.split(", ")]
    # State with timers lives in RocksDB.
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = parts.select(F.col(key).cast("string").alias("key"), "seq", F.col("part").cast("string").alias("part"), *([at] if at else []))
    idle = IDLE if at and idle is None else idle
    processor = _Kept(state, empty, step, last, columns, None if idle is None else int(idle * 1000), at)
    mode = "eventTime" if at else "none" if idle is None else "processingTime"
    return rows.groupBy("key").transformWithStateInPandas(processor, out, "append", mode)


def _tagged(begin: str, end: str):
    """Of (buffer, inside, over) and parts: the state after them, and (piece, over) of the
    text between the tags that can't be part of the end tag."""

    def step(state: tuple, parts: list[str]):
        (buffer, inside, over), out = state, []
        for part in parts:
            if over:
                break
            buffer += part
            if not inside and (at := buffer.find(begin)) >= 0:
                inside, buffer = True, buffer[at + len(begin) :]
            if inside:
                at = buffer.find(end)
                piece = buffer[:at] if at >= 0 else buffer[: max(0, len(buffer) - len(end))]
                over = at >= 0
                buffer = "" if over else buffer[len(piece) :]
                if piece or over:
                    out.append((piece, over))
            else:
                buffer = buffer[-len(begin) :]  # all that may still become the tag
        return (buffer, inside, over), out

    return step


def _rest_of_output(state: tuple) -> list[tuple]:
    buffer, inside, over = state
    return [(buffer, True)] if inside and not over else []


def safe_output(parts: DataFrame, key: str = "key", begin: str = "<output>", end: str = "</output>", at: str | None = None, idle: float | None = None) -> DataFrame:
    """(key, piece, over): of a stream of parts (key, seq, part), text between the tags
    as soon as it can't be part of the end tag. State is one buffer a key; ``idle``
    seconds after a key's last part, by the event time ``at`` (with a watermark; IDLE if
    not given) or else by the clock, it goes, and text without an end tag comes out as it
    is. Without both it stays. By the clock a stream never ends by itself, as timers may
    come. Parts with a null text count as empty; those of a key come in order of seq."""
    return _kept(parts, key, at, idle, "buffer string, inside boolean, over boolean", ("", False, False), _tagged(begin, end), _rest_of_output, "key string, piece string, over boolean")


def output_of(parts: DataFrame, key: str, text: str, order: str, begin: str = "<output>", end: str = "</output>") -> DataFrame:
    """(key, output, over): the same of a table of all parts: the text after the first
    begin tag, up to the end tag if there is one (over); keys without a tag have none."""
    whole = gathered(parts, key, text, order)
    start = F.locate(begin, F.col("message"))
    inner = F.substr("message", start + len(begin))
    stop = F.locate(end, inner)
    out = whole.where(start > 0).select(key, F.when(stop > 0, F.left(inner, stop - 1)).otherwise(inner).alias("output"), (stop > 0).alias("over"))
    return out


def _split_lines(state: tuple, parts: list[str]):
    (buffer, nth), out = state, []
    for part in parts:
        *whole, buffer = (buffer + part).split("\n")
        for line in whole:
            if line.strip(" "):
                out.append((nth, line))
                nth += 1
    return (buffer, nth), out


def _last_line(state: tuple) -> list[tuple]:
    buffer, nth = state
    return [(nth, buffer)] if buffer.strip(" ") else []


def complete_lines(parts: DataFrame, key: str = "key", at: str | None = None, idle: float | None = None) -> DataFrame:
    """(key, nth, line): of a stream of parts (key, seq, part), which may end anywhere,
    the lines that are not blank, each as soon as its end is there. State is one
    unfinished line a key, which comes out and goes as in ``safe_output``."""
    return _kept(parts, key, at, idle, "buffer string, nth long", ("", 0), _split_lines, _last_line, "key string, nth long, line string")


def lines_of(parts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, nth, line): the same of a table of all parts."""
    whole = gathered(parts, key, text, order)
    lines = F.filter(F.split("message", "\n"), lambda x: F.trim(x) != "")
    return whole.select(key, F.posexplode(lines).alias("nth", "line")).withColumn("nth", F.col("nth").cast("long"))


def polled(local: DataFrame, fresh: DataFrame, key: str, is_temporary: Column) -> DataFrame:
    """A list after a poll: temporary rows stay as they are, others take the polled values
    or go where the poll lacks them, and what is new comes in."""
    stay = local.where(is_temporary)
    return stay.unionByName(fresh.join(stay.select(key), key, "left_anti").select(*local.columns))


def merge_every(fresh: DataFrame, merge, checkpoint: str, seconds: int = 5):
    """A started query that hands the rows of each poll of ``fresh`` to ``merge(rows,
    batch_id)``, as ``polled`` wants them."""
    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def sse_messages(rows: DataFrame, event: str, event_id: str = "event_id") -> DataFrame:
    """(id, message): each row as a message of a server-sent stream, its columns as JSON."""
    data = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != event_id]))
    said = F.concat(F.lit("id: "), F.col(event_id).cast("string"), F.lit(f"\nevent: {event}\ndata: "), data, F.lit("\n\n"))
    return rows.select(F.col(event_id).alias("id"), said.alias("message"))


def to_ndjson(rows: DataFrame, path: str, checkpoint: str):
    """A started query that writes each row as a line of JSON."""
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
