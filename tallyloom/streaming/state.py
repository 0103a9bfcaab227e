"""Per-key state machines over events in time order: token bucket, circuit breaker, sticky tier, recently tainted files.

Each machine is a pure step (state, event) -> (state, output). fold() runs it over a table, stream() over a stream.

fold() deals rows by ranges of (key, time, id), so that a hot key is spread over many tasks. A task that begins in the middle of a key needs
the state that the one before it ends with. States are small and there is one such key for each task, so the driver chains them: every
task's last key is walked from no state, then those tasks again whose entry turned out another, until none does. A machine that comes to
the same state from different entries (a bucket that was full, a breaker that was closed) needs one or two turns; a machine that can
combine an entry with what a task did (tainted files) needs none.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .metrics import LATENESS, materialized

Step = Callable[[tuple | None, tuple], tuple[tuple, object]]
Combine = Callable[[tuple | None, tuple | None], tuple | None]
_TAIL = "chunk int, first string, last string, state binary"


def _walk(step: Step, entries: dict[int, tuple | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """id and out for every row of the sorted chunks; a chunk's first key begins with its entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, key, state = None, None, None
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                if row[0] != chunk:
                    chunk, key, state = row[0], row[1], entries.get(row[0])
                elif row[1] != key:
                    key, state = row[1], None
                state, value = step(state, tuple(row[2:]))
                made.append(value)
            yield pd.DataFrame({"id": batch["id"], "out": made})

    return run


def _tails(step: Step, entries: dict[int, tuple | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """First and last key of each chunk and the state that the last one ends with; only the last key's rows are walked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, first, key, state = None, None, None, None
        for batch in batches:
            if not len(batch):
                continue
            if chunk is None:
                chunk, first = int(batch["chunk"].iloc[0]), batch["key"].iloc[0]
                key, state = first, entries.get(chunk)
            last = batch["key"].iloc[-1]
            if last != key:
                key, state = last, None
            own = batch[(batch["key"] == last).to_numpy()]
            for row in own.itertuples(index=False):
                state, _ = step(state, tuple(row[2:]))
        if chunk is not None:
            yield pd.DataFrame({"chunk": [chunk], "first": [first], "last": [key], "state": [pickle.dumps(state)]})

    return run


def entries_of(dealt: DataFrame, step: Step, combine: Combine | None = None) -> dict[int, tuple | None]:
    """The state that each chunk's first key begins with, for the chunks that begin in the middle of a key."""
    tails: dict[int, Row] = {}
    known: dict[int, tuple | None] = {}

    def walked(chunks: list[int] | None) -> None:
        rows = dealt if chunks is None else dealt.where(F.col("chunk").isin(chunks))
        for row in rows.mapInPandas(_tails(step, dict(known)), _TAIL).collect():  # one row for each task
            tails[row["chunk"]] = row

    walked(None)
    while True:
        now: dict[int, tuple | None] = {}
        before = None
        for chunk in sorted(tails):
            tail = tails[chunk]
            state = pickle.loads(tail["state"])
            if before is not None and before[0] == tail["first"]:
                now[chunk] = before[1]
                if combine is not None and tail["first"] == tail["last"]:
                    state = combine(now[chunk], state)
            before = (tail["last"], state)
        if combine is not None:
            return now
        # a chunk that ends with another key than it began with ends with the same state whatever its entry
        again = [c for c, state in now.items() if known.get(c) != state and tails[c]["first"] == tails[c]["last"]]
        known = now
        if not again:
            return now
        walked(again)


def fold(rows: DataFrame, key: str, columns: list[str], step: Step, out: str, combine: Combine | None = None, tasks: int | None = None) -> DataFrame:
    """key, id and out for each row; columns: what the step sees, in (t, id) order. Rows with a null key are one key."""
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    picked = rows.select(name.alias("key"), "t", "id", *columns)
    order = ["key", "t", "id"]
    ranged = picked.repartitionByRange(tasks, *order) if tasks else picked.repartitionByRange(*order)
    dealt = materialized(ranged.sortWithinPartitions(*order).select(F.spark_partition_id().alias("chunk"), *picked.columns))
    return dealt.mapInPandas(_walk(step, entries_of(dealt, step, combine)), f"id long, out {out}")


class Machine(StatefulProcessor):
    """A step over a stream. The state is freed by an event-time timer, ttl seconds after the key's last event."""

    def __init__(self, step: Step, columns: list[str], ttl: float | None):
        self.step, self.columns, self.ttl = step, columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state binary, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        state, last = None, None
        if self.held.exists():
            packed, last = self.held.get()
            state = pickle.loads(packed)
        made = []
        for event in events[["t", "id", *self.columns]].itertuples(index=False):
            state, value = self.step(state, tuple(event))
            made.append(value)
        now = max(float(events["t"].iloc[-1]), last if last is not None else float("-inf"))
        self.held.update((pickle.dumps(state), now))
        if self.ttl is not None:
            if last is not None:
                self.handle.deleteTimer(self._due(last))
            self.handle.registerTimer(self._due(now))
        yield pd.DataFrame({"id": events["id"], "out": made})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass

    def _due(self, t: float) -> int:
        return int((t + self.ttl) * 1000) + 1


def stream(rows: DataFrame, key: str, columns: list[str], step: Step, out: str, ttl: float | None = None, lateness: str = LATENESS) -> DataFrame:
    """id and out for each row of a stream; the events of one micro-batch are taken in time order, those behind the watermark are left out.

    ttl: seconds after which a machine without events is as one that has none (a full bucket, a tier no longer held); its
    state is then freed. Without it states stay. Needs the RocksDB state store (see stateful).
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    picked = rows.select(name.alias("key"), "t", "id", *columns, F.timestamp_seconds("t").alias("at")).withWatermark("at", lateness)
    return picked.groupBy("key").transformWithStateInPandas(Machine(step, columns, ttl), f"id long, out {out}", "Append", "EventTime")


def token_bucket(rate: float, capacity: float) -> Step:
    """1 where a token was there, else 0. State: (tokens, time)."""

    def step(state: tuple | None, event: tuple) -> tuple[tuple, int]:
        t = float(event[0])
        tokens, last = state if state else (capacity, t)
        tokens = min(capacity, tokens + max(0.0, t - last) * rate)
        return ((tokens - 1, t), 1) if tokens >= 1 else ((tokens, t), 0)

    return step


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds rpm to rows (provider, model): of the enabled limits (position, name, rpm) over 0 the first that is "provider/model" or the bare model; else 0."""
    some = limits.where("enabled AND rpm > 0 AND name <> ''").groupBy("name").agg(F.min(F.struct("position", "rpm")).alias("limit"))
    both, bare = (F.broadcast(some.select(F.col("name").alias(n), F.col("limit").alias(f"_{n}"))) for n in ("_both", "_bare"))  # settings, a few rows
    joined = rows.join(both, F.concat_ws("/", "provider", "model") == F.col("_both"), "left").join(bare.where("NOT contains(_bare, '/')"), F.col("model") == F.col("_bare"), "left")
    first = F.least("__both", "__bare")  # structs compare by position; nulls are left out
    return joined.withColumn("rpm", F.coalesce(first["rpm"], F.lit(0))).drop("_both", "_bare", "__both", "__bare")


def limited() -> Step:
    """1 or 0 for each event (t, id, rpm) of one bucket of rpm tokens a minute; no limit: 1."""

    def step(state: tuple | None, event: tuple) -> tuple[tuple, int]:
        rpm = float(event[2])
        return token_bucket(rpm / 60, rpm)(state, event) if rpm > 0 else (state or (rpm, float(event[0])), 1)

    return step


def two_buckets(rps: float, rpm: float) -> Step:
    """ok, rps or rpm. A refusal by the minute bucket has used up the second bucket's token."""
    second, minute = token_bucket(rps, max(1.0, rps)), token_bucket(rpm / 60, max(1.0, rpm))

    def step(state: tuple | None, event: tuple) -> tuple[tuple, str]:
        a, got = second(state[:2] if state else None, event)
        if not got:
            return (*a, *(state[2:] if state else (max(1.0, rpm), float(event[0])))), "rps"
        b, got = minute(state[2:] if state else None, event)
        return (*a, *b), "ok" if got else "rpm"

    return step


def retry(step_rate: float, capacity: float) -> Step:
    """Seconds to wait, 0 where a token was there. State: (tokens, time)."""
    take = token_bucket(step_rate, capacity)

    def step(state: tuple | None, event: tuple) -> tuple[tuple, int]:
        state, got = take(state, event)
        return state, 0 if got else max(1, int((1 - state[0]) / max(step_rate, 1e-9)))

    return step


def limiter(rps: float, rpm: float, files_rpm: float) -> Step:
    """What each event (t, id, scope) gets: "ok 0", or the bucket that refuses it and the seconds to wait.

    Uploads (scope files) have one bucket, other requests one for each second and one for each minute; both must have a token, and a
    refusal by the second one has used up the first one's. A rate of 0 is no limit. A key of the fold is one identity in one scope.
    """

    def step(state: tuple | None, event: tuple) -> tuple[tuple, str]:
        limits = [("files_rpm", files_rpm / 60, files_rpm)] if event[2] == "files" else [("rps", rps, rps), ("rpm", rpm / 60, rpm)]
        held = list(state) if state else [None] * len(limits)
        for k, (name, rate, capacity) in enumerate(limits):
            if capacity > 0:
                held[k], wait = retry(rate, capacity)(held[k] or (capacity, float(event[0])), event)
                if wait:
                    return tuple(held), f"{name} {wait}"
        return tuple(held), "ok 0"

    return step


def breaker(failures: int = 5, window: float = 60, recovery: float = 30, successes: int = 2) -> Step:
    """State after each event (t, id, failed): closed, open or half_open. State: (name, opened at, successes while half open, times of failures).

    It opens where so many failures lie within the sliding window. Failures while it is open count too and move the opening; those of the
    probes while it is half open reopen it and don't count. A success while it is closed forgets all failures once the first one has left
    the window, and so does closing. No more than `failures` times are kept: the older ones decide nothing.
    """

    def step(state: tuple | None, event: tuple) -> tuple[tuple, str]:
        t, failed = float(event[0]), bool(event[2])
        name, opened, good, times = state or ("closed", 0.0, 0, ())
        if name == "open" and t - opened >= recovery:
            name, good = "half_open", 0
        if name == "half_open":
            if failed:
                name, opened, good = "open", t, 0
            else:
                good += 1
                if good >= successes:
                    name, opened, good, times = "closed", 0.0, 0, ()
        elif failed:
            times = tuple(x for x in (*times, t) if t - x <= window)[-failures:]
            if len(times) >= failures:
                name, opened = "open", t
        elif name == "closed" and times and t - times[0] > window:
            times = ()
        return (name, opened, good, times), name

    return step


def tainted_files(ttl: float, most: int = 200) -> tuple[Step, Combine]:
    """For each event (t, id, mention, tainted): time and name of the tainted file that mention means, as "seconds name"; null for none.

    The newest `most` different names of a key count, for ttl seconds after they were last tainted. A mention means a name that it ends
    with or that ends with it; of several the one tainted last. A row that taints (its mention is a file's name) is looked up before. Names
    are trimmed and lower-cased; empty ones and those over 256 characters are neither looked up nor kept. State: (name, time), newest first.
    """

    def step(state: tuple | None, event: tuple) -> tuple[tuple, str | None]:
        held, t = state or (), float(event[0])
        name = event[2].strip().lower() if isinstance(event[2], str) else ""
        if not name or len(name) > 256:
            return held, None
        found = next((f"{int(at)} {x}" for x, at in held if t - at <= ttl and (name.endswith(x) or x.endswith(name))), None)
        if event[3]:
            held = ((name, t), *(x for x in held if x[0] != name and t - x[1] <= ttl))[:most]
        return held, found

    def combine(entry: tuple | None, own: tuple | None) -> tuple:
        names = {x for x, _ in own or ()}
        return ((own or ()) + tuple(x for x in entry or () if x[0] not in names))[:most]

    return step, combine


def sticky_tier(ttl: float) -> Step:
    """Effective tier of (t, id, level): at least the tier of the last use within ttl where that was 2 or more."""

    def step(state: tuple | None, event: tuple) -> tuple[tuple, int]:
        t, level = float(event[0]), event[2]
        tier, last = state if state else (0, t)
        held = tier if tier >= 2 and t - last <= ttl else 0
        level = held if level is None or level != level else int(level)
        now = max(level, held)
        return ((now, t) if now >= 2 else (tier if held else 0, last)), now

    return step


def sticky_tiers(rows: DataFrame, key: str, ttl: float, chunk: int = 86400) -> DataFrame:
    """sticky_tier over a table (key, t, id, level), with windows only: id and out for each row.

    Uses of a key that follow each other within ttl share the highest level so far, once that is 2 or more. Windows
    run within chunks of time, so that one key's rows are spread; what a chunk hands on is one row for each key and chunk.
    """
    rows = rows.select(F.col(key).alias("key"), F.floor(F.col("t") / chunk).alias("chunk"), "t", "id", "level")
    within, over = Window.partitionBy("key", "chunk").orderBy("t", "id"), Window.partitionBy("key").orderBy("chunk")
    rows = rows.withColumn("near", F.lag("t").over(within))
    rows = rows.withColumn("part", F.count_if(F.col("t") - F.col("near") > ttl).over(within)).drop("near")
    rows = rows.withColumn("top", F.max("level").over(Window.partitionBy("key", "chunk", "part").orderBy("t", "id")))
    edges = rows.groupBy("key", "chunk").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("part").alias("cuts"), F.max_by("top", F.struct("t", "id")).alias("tail"))
    edges = edges.withColumn("linked", F.coalesce(F.col("first") - F.lag("last").over(over) <= ttl, F.lit(False)))
    edges = edges.withColumn("run", F.count_if(~F.col("linked") | (F.col("cuts") > 0)).over(over))
    edges = edges.withColumn("held", F.max("tail").over(Window.partitionBy("key", "run").orderBy("chunk")))
    edges = edges.select(F.col("key").alias("_key"), F.col("chunk").alias("_chunk"), F.when(F.col("linked"), F.lag("held").over(over)).alias("carry"))
    both = rows.join(edges, F.col("key").eqNullSafe(F.col("_key")) & F.col("chunk").eqNullSafe(F.col("_chunk")))
    top = F.greatest("top", F.when(F.col("part") == 0, F.col("carry")))
    return both.select("id", F.when(top >= 2, top).otherwise(F.greatest(F.coalesce("level", F.lit(0)), F.lit(0))).cast("long").alias("out"))
