"""Ordered folds over range partitions, all ranges at once.

Some sweeps need what all rows before have left behind: a replay that uses up stored
points, a test that starts again after each alarm. Here every range is swept at the
same time from a guess of that state. What each sweep ends with tells the next
range's true state; ranges that were swept from another one are swept again. After
round r at least r ranges are right, whatever the guesses, and sweeps that forget
their start (a point that is taken, an alarm) make all of them right in two or three.

Rows never pass through the driver; it holds one state for each range.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import PART, materialise

STATE = "__state"


def sorted_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Rows in ranges of ``order``, numbered in PART and sorted within, written once."""
    return materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()))


def _text(state) -> str:
    return json.dumps(state)


def chained(ranges: DataFrame, sweep: Callable, schema: str, start: tuple, guesses: dict[int, tuple], predict: Callable | None = None, same: Callable | None = None) -> DataFrame:
    """What ``sweep`` yields over the rows of ``ranges`` (from sorted_ranges) in order.

    sweep(state, batches) yields record batches of ``schema`` and returns the state
    after its rows, a tuple of numbers and strings. ``guesses``: the state before each
    range, by its number. predict(before, old_before, old_after): the state after a range that is
    yet to be swept again from ``before``; without it, what it ended with last time.
    same(a, b): whether two states count as equal; without it, if they are.
    """
    parts = sorted(r[0] for r in ranges.select(PART).distinct().collect())  # one number a range
    same = same or (lambda a, b: a == b)
    names = [f.split(" ")[0] for f in schema.split(", ")]
    full = f"{schema}, {PART} int, {STATE} string"
    before = {p: tuple(start if p == parts[0] else guesses[p]) for p in parts}
    after: dict[int, tuple] = {}
    frames, latest, todo = [], {}, set(parts)
    while todo:
        told = {p: before[p] for p in todo}

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            own: list[int] = []

            def rows() -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if len(b):
                        own.append(b.column(PART)[0].as_py())
                        yield b

            source = rows()
            first = next(source, None)
            if first is None or own[0] not in told:
                return
            p = own[0]

            def again() -> Iterator[pa.RecordBatch]:
                yield first
                yield from source

            made = sweep(told[p], again())
            kinds = None
            while True:
                try:
                    out = next(made)
                except StopIteration as end:
                    state = end.value
                    break
                kinds = out.schema
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([p] * len(out), pa.int32()), pa.nulls(len(out), pa.string())], names=[*names, PART, STATE])
            kinds = kinds or pa.schema([(n, pa.null()) for n in names])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds.types), pa.array([p], pa.int32()), pa.array([_text(state)])], names=[*names, PART, STATE])

        made = materialise(ranges.where(F.col(PART).isin([int(p) for p in todo])).mapInArrow(run, full))
        for r in made.where(f"{STATE} is not null").select(PART, STATE).collect():
            after[r[0]] = tuple(json.loads(r[1]))
            latest[r[0]] = len(frames)
        frames.append(made)
        state, todo = tuple(start), set()
        for p in parts:
            if same(before[p], state):
                state = after[p]
            else:
                end = predict(state, before[p], after[p]) if predict else after[p]
                before[p] = state
                todo.add(p)
                state = end
    out = None
    for k, frame in enumerate(frames):
        own = [int(p) for p in parts if latest[p] == k]
        if own:
            kept = frame.where(F.col(PART).isin(own) & F.col(STATE).isNull()).select(*names)
            out = kept if out is None else out.unionByName(kept)
    return out if out is not None else ranges.sparkSession.createDataFrame([], schema)


def in_tree(stored: DataFrame) -> DataFrame:
    """``stored`` (seq, birth, logl, ...) with ``fits``: whether a replay would hang the row into the tree.

    A row hangs under the first row of the tree at or above its birth threshold that
    lies below it. So it fits if the highest row of the tree below it is not below its
    threshold (or it is from the prior), and the state of the sweep is that one value.
    """
    keyed = stored.withColumn("__birth", F.coalesce(F.col("birth").cast("double"), F.lit(-math.inf)))
    ranges = sorted_ranges(keyed.select("seq", "__birth", F.col("logl").cast("double").alias("logl")), "logl", "seq")
    tops = dict(ranges.groupBy(PART).agg(F.max("logl")).collect())  # one row a range

    def sweep(state, batches):
        seen, below, top = state  # the value last seen, the highest of the tree below it, and up to it
        for b in batches:
            fits = []
            for value, birth in zip(b.column("logl").to_pylist(), b.column("__birth").to_pylist()):
                if value > seen:
                    seen, below = value, top
                ok = birth == -math.inf or birth <= below < value
                if ok:
                    top = value
                fits.append(ok)
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(fits, pa.bool_())], names=["seq", "fits"])
        return seen, below, top

    parts = sorted(tops)
    guesses = {q: (tops[p], tops[p], tops[p]) for p, q in zip(parts, parts[1:])}
    kind = stored.schema["seq"].dataType.simpleString()
    fits = chained(ranges, sweep, f"seq {kind}, fits boolean", (-math.inf,) * 3, guesses)
    return stored.join(fits, "seq")


def run_lengths_table(df: DataFrame, rank: str, n: str, *order: str, threshold: float = 4.0) -> DataFrame:
    """(length, at): the runs that the rank test ended, each with the place (from 1) of the row that ended it.

    The test adds up (rank + 1/2) / n - 1/2 and starts again wherever the sum is beyond
    ``threshold`` times the square root of a twelfth of the rows since. The state is the sum, the
    rows since and the rows so far; sums of two ways of adding count as equal within rounding.
    """
    ranges = sorted_ranges(df.select(*order, F.col(rank).cast("double").alias("r"), F.col(n).cast("double").alias("n")), *order)
    if ranges.where("r < 0 or r > n or n <= 0").head(1):
        raise ValueError("ranks must lie between 0 and n")
    sums = {r[0]: (r[1], r[2]) for r in ranges.groupBy(PART).agg(F.sum((F.col("r") + 0.5) / F.col("n") - 0.5), F.count(F.lit(1))).collect()}

    def sweep(state, batches):
        total, since, so_far = state
        for b in batches:
            d = (b.column("r").to_numpy() + 0.5) / b.column("n").to_numpy() - 0.5
            lengths, at, i = [], [], 0
            while i < len(d):
                run = np.cumsum(np.r_[total, d[i:]])[1:]
                k = since + np.arange(1, len(run) + 1)
                beyond = np.abs(run) > threshold * np.sqrt(k / 12)
                j = int(beyond.argmax())
                if not beyond[j]:
                    total, since = float(run[-1]), int(k[-1])
                    break
                lengths.append(int(k[j]))
                i += j + 1
                at.append(so_far + i)
                total, since = 0.0, 0
            so_far += len(d)
            if lengths:
                yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(at, pa.int64())], names=["length", "at"])
        return total, since, so_far

    guesses, state = {}, (0.0, 0, 0)
    for p in sorted(sums):
        guesses[p] = state
        state = (state[0] + sums[p][0], state[1] + sums[p][1], state[2] + sums[p][1])

    def predict(now, old, ended):
        rows = ended[2] - old[2]
        if ended[1] == old[1] + rows:  # no alarm: the sum goes on
            return now[0] + ended[0] - old[0], now[1] + rows, now[2] + rows
        return ended[0], ended[1], now[2] + rows

    same = lambda a, b: a[1:] == b[1:] and abs(a[0] - b[0]) <= 1e-9 * (1 + abs(a[0]))
    return chained(ranges, sweep, "length long, at long", (0.0, 0, 0), guesses, predict, same)


def order_test_summary(df: DataFrame, rank: str, n: str, *order: str, threshold: float = 4.0, expected: float = 10**5.5) -> DataFrame:
    """One row: ranks, runs (ended by the test), shortest (null: none), z of the last open run, allowed, converged.

    Runs of less than ``expected`` ranks should hardly occur; more runs than one for each
    ``expected`` ranks (at least one is allowed) tell a biased order.
    """
    ended = materialise(run_lengths_table(df, rank, n, *order, threshold=threshold))
    last = ended.agg(F.count(F.lit(1)).alias("runs"), F.min("length").alias("shortest"), F.coalesce(F.max("at"), F.lit(0)).alias("last"))
    from .ordered import ranked

    open_rows = ranked(df.select(*order, rank, n), *order, name="__at").join(F.broadcast(last))  # one row
    d = (F.col(rank) + 0.5) / F.col(n) - 0.5
    late = F.col("__at") > F.col("last")
    k = F.count_if(late)
    s = open_rows.agg(F.count(F.lit(1)).alias("ranks"), (F.sum(F.when(late, d)) / F.sqrt(k / 12.0)).alias("z"))
    allowed = F.greatest(F.lit(1), F.ceil(F.col("ranks") / F.lit(float(expected))))
    return s.join(F.broadcast(last)).select("ranks", "runs", "shortest", "z", allowed.alias("allowed"), (F.col("runs") <= allowed).alias("converged"))


def pop_sequence(stored: DataFrame, thresholds: DataFrame, run: str | None = None, consume: bool = True) -> DataFrame:
    """(run,) k, threshold and seq of the stored row that each threshold takes, or null.

    A threshold takes the first stored row (by seq) born at or below it that lies
    above it, and no later threshold can take that row again (unless not ``consume``).
    Thresholds (k, threshold) must rise with k, as they do along a run.

    Births and thresholds lie in ranges of value, so a run spreads over all tasks. A
    range starts with the rows born before it that lie above its start and that no
    range before has taken. Which ones have is known from the last round; the ranges
    for which that changed are swept again. A task holds the rows that are born but
    not passed, by design about the live points of a run.
    """
    key = lambda df: F.when(F.col(run).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(run).cast("string"))) if run else F.lit("")
    births = stored.select(key(stored).alias("run"), F.coalesce(F.col("birth").cast("double"), F.lit(-math.inf)).alias("v"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("n"), F.col("logl").cast("double").alias("logl"))
    asked = thresholds.select(key(thresholds).alias("run"), F.col("threshold").cast("double").alias("v"), F.lit(2).alias("kind"), F.col("k").cast("long").alias("n"), F.lit(0.0).alias("logl"))
    order = ("run", "v", "kind", "n")
    events = sorted_ranges(births.unionByName(asked), *order)
    heads = sorted((r[0], r[1]["run"], r[1]["v"]) for r in events.groupBy(PART).agg(F.min(F.struct("run", "v"))).collect())  # one row a range
    out_schema = f"{PART} int, run string, k long, threshold double, seq long"

    def carried(batches):
        """The rows that are born before a range and lie above its start, once for each range."""
        by_run: dict[str, tuple[list, list]] = {}
        for p, g, v in heads:
            at = by_run.setdefault(g, ([], []))
            at[0].append(p)
            at[1].append(v)
        table = {g: (np.array(p), np.array(v)) for g, (p, v) in by_run.items()}
        for b in batches:
            cols = [[], [], [], []]
            for g, n, logl, p in zip(*(b.column(c).to_pylist() for c in ("run", "n", "logl", PART))):
                parts, values = table.get(g, (np.array([]), np.array([])))
                lo, hi = np.searchsorted(parts, p, side="right"), np.searchsorted(values, logl)
                for q in parts[lo:hi].tolist():
                    for c, x in zip(cols, (g, n, logl, q)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.int32()))], names=["run", "n", "logl", PART])

    alive = materialise(events.where("kind = 1").select("run", "n", "logl", PART).mapInArrow(carried, f"run string, n long, logl double, {PART} int"))

    def sweep(batches):
        held: list[tuple[int, float]] = []
        own = object()
        for b in batches:
            out = []
            for p, g, v, kind, n, logl in zip(*(b.column(c).to_pylist() for c in (PART, "run", "v", "kind", "n", "logl"))):
                if (p, g) != own:
                    held, own = [], (p, g)
                if kind < 2:
                    heapq.heappush(held, (n, logl))
                    continue
                while held and held[0][1] <= v:
                    heapq.heappop(held)
                out.append((p, g, n, v, (heapq.heappop(held) if consume else held[0])[0] if held else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.int64()))], names=[PART, "run", "k", "threshold", "seq"])

    def swept(parts: set[int], state: DataFrame) -> DataFrame:
        own = [int(p) for p in parts]
        led = state.select("run", F.lit(-math.inf).alias("v"), F.lit(0).alias("kind"), "n", "logl", PART)
        rows = events.where(F.col(PART).isin(own)).unionByName(led.where(F.col(PART).isin(own)))
        # what a range starts with belongs to its first run and comes before all else there
        return materialise(rows.repartition(PART).sortWithinPartitions(PART, "run", F.col("kind") > 0, "v", "kind", "n").mapInArrow(sweep, out_schema))

    def marks(state: DataFrame) -> dict[int, tuple]:
        return {r[0]: (r[1], r[2]) for r in state.groupBy(PART).agg(F.count(F.lit(1)), F.sum(F.xxhash64("run", "n").cast("decimal(38,0)"))).collect()}  # one row a range

    todo = {p for p, _, _ in heads}
    state = alive.where(F.lit(not consume))  # rows of a replay are mostly taken where they are born: start with none carried over
    known, frames, latest = marks(state), [], {}
    while todo:
        frames.append(swept(todo, state))
        latest |= dict.fromkeys(todo, len(frames) - 1)
        if not consume:
            break
        taken = _latest(frames, latest).where("seq is not null").select("run", F.col("seq").alias("n"), F.col(PART).alias("__by"))
        early = taken.groupBy("run", "n").agg(F.min("__by").alias("__by"))  # from guesses, two ranges may have taken one row
        state = materialise(alive.join(early, ["run", "n"], "left").where(F.col("__by").isNull() | (F.col("__by") >= F.col(PART))).drop("__by"))
        now = marks(state)
        todo = {p for p, _, _ in heads if now.get(p) != known.get(p)}
        known = now
    out = _latest(frames, latest).drop(PART) if frames else events.sparkSession.createDataFrame([], out_schema).drop(PART)
    if not run:
        return out.drop("run")
    kind = stored.schema[run].dataType
    return out.select(F.when(F.col("run") != "", F.expr("substring(run, 2)").cast(kind)).alias(run), "k", "threshold", "seq")


def _latest(frames: list[DataFrame], latest: dict[int, int]) -> DataFrame:
    out = None
    for k, frame in enumerate(frames):
        own = [int(p) for p, at in latest.items() if at == k]
        if own:
            kept = frame.where(F.col(PART).isin(own))
            out = kept if out is None else out.unionByName(kept)
    return out
