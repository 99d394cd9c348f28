"""Streams: the tail of run events, the work queue's states, rate limits. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_SECONDS = 60.0


def event_tail(spark: SparkSession, path: str, schema, run_id=None) -> DataFrame:
    """New rows of an append-only event table."""
    events = spark.readStream.schema(schema).parquet(path)
    return events if run_id is None else events.where(F.col("run_id") == F.lit(run_id))


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything there is, in micro-batches, then stop: a finite poll that resumes where it ended.

    Batches without data are off: a timeout would ask for them for ever.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    query.awaitTermination()


def stage_totals(stream: DataFrame, by: str = "stage", duration: str = "duration_ms") -> DataFrame:
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.sum(duration).alias("total_ms"))


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; state of windows older than the watermark is dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("count"))


def _allow(times: list[float], limit: int, start: float | None, used: int, seconds: float = WINDOW_SECONDS) -> tuple[list[tuple[bool, int]], float | None, int]:
    out = []
    for t in times:
        if limit <= 0:
            out.append((True, 0))
        elif start is None or t - start >= seconds:
            start, used = t, 1
            out.append((True, 0))
        elif used >= limit:
            out.append((False, max(1, int(seconds - (t - start)))))
        else:
            used += 1
            out.append((True, 0))
    return out, start, used


def _folded(df: DataFrame, key: str, order: list[str], fold: Callable[[pd.DataFrame, dict], pd.DataFrame],
    finish: Callable[[object, dict], pd.DataFrame] | None, schema: str) -> DataFrame:
    """Rows of a key in order, a batch at a time with what was carried over from the batch before.

    Partitions are sorted, which spills; no key's rows are gathered, so a key may hold any share of them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, {}
        for frame in frames:
            # runs of equal keys; a null key is a key
            values = frame[key].astype(object).where(frame[key].notna(), None).tolist()
            starts = [i for i, v in enumerate(values) if i == 0 or v != values[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(values)]):
                if last != (values[a],):
                    if last is not None and finish is not None:
                        yield finish(last[0], state)
                    last, state = (values[a],), {}
                done = fold(frame.iloc[a:b], state)
                if done is not None:
                    yield done
        if last is not None and finish is not None:
            yield finish(last[0], state)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limit(requests: DataFrame, identity: str, at: str, order: str, limit: int) -> DataFrame:
    """(identity, order, allowed, retry_after) of each request: windows of a minute that begin with the identity's first request.

    One shuffle on the identity; within one, the requests are folded in order, without being gathered.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def fold(pdf: pd.DataFrame, state: dict) -> pd.DataFrame:
        verdicts, state["start"], state["used"] = _allow(pdf["_t"].tolist(), limit, state.get("start"), state.get("used", 0))
        return pd.DataFrame({identity: pdf[identity].to_numpy(), order: pdf[order].to_numpy(),
                "allowed": [a for a, _ in verdicts], "retry_after": [r for _, r in verdicts]})

    timed = requests.select(identity, order, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_t"))
    return _folded(timed, identity, ["_t", order], fold, None, f"{identity} {kinds[identity]}, {order} {kinds[order]}, allowed boolean, retry_after int")


def rate_limit_stream(requests: DataFrame, identity: str, at: str, order: str, limit: int, late: str = "1 minute") -> DataFrame:
    """The same on a stream: an identity's state is dropped when the watermark of the requests' own time is past its window, so a replay or a backlog gives the verdicts of the batch.

    Requests later than ``late`` behind the latest one seen may be dropped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["_t", order])
        start, used = state.get if state.exists else (None, 0)
        verdicts, start, used = _allow(rows["_t"].tolist(), limit, start, used)
        state.update((start, used))
        if start is not None:
            state.setTimeoutTimestamp(max(int((start + WINDOW_SECONDS) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({identity: rows[identity], order: rows[order], "allowed": [a for a, _ in verdicts], "retry_after": [r for _, r in verdicts]})

    timed = requests.select(identity, order, F.col(at).cast("timestamp").alias("_at"),
        (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_t")).withWatermark("_at", late)
    return timed.groupBy(identity).applyInPandasWithState(step,
        f"{identity} {kinds[identity]}, {order} {kinds[order]}, allowed boolean, retry_after int", "start double, used int",
        "append", GroupStateTimeout.EventTimeTimeout)


TRANSITIONS = {"enqueue": "queued", "claim": "running", "complete": "succeeded", "cancel": "canceled"}


def apply_commands(state: dict, rows: list[dict], most_attempts: int) -> dict:
    """The queue entry of one run after commands (command, worker, error), in order."""
    for r in rows:
        command, worker = r["command"], r.get("worker")
        mine = state["status"] == "running" and (worker is None or worker == state["locked_by"])
        if command == "enqueue" and state["status"] in (None, "failed", "succeeded"):
            state |= {"status": "queued", "locked_by": None, "last_error": None}
        elif command == "claim" and state["status"] in ("queued", "retry"):
            state |= {"status": "running", "locked_by": worker, "attempts": state["attempts"] + 1}
        elif command == "complete" and mine:
            state |= {"status": "succeeded"}
        elif command == "fail" and mine:
            state |= {"status": "failed" if state["attempts"] >= most_attempts else "retry", "locked_by": None, "last_error": r.get("error")}
        elif command == "cancel":
            state |= {"status": "canceled", "last_error": r.get("error")}
    return state


_FIELDS = ("status", "attempts", "locked_by", "last_error")


def queue_states(commands: DataFrame, most_attempts: int = 3) -> DataFrame:
    """The last state of every run after all its commands (run_id, seq, command, worker, error)."""
    kind = commands.schema["run_id"].dataType.simpleString()

    def fold(pdf: pd.DataFrame, state: dict) -> None:
        held = state.setdefault("entry", {"status": None, "attempts": 0, "locked_by": None, "last_error": None})
        apply_commands(held, pdf.astype(object).where(lambda x: x.notna(), None).to_dict("records"), most_attempts)

    def finish(run_id, state: dict) -> pd.DataFrame:
        return pd.DataFrame([{"run_id": run_id, **state["entry"]}])

    return _folded(commands, "run_id", ["seq"], fold, finish, f"run_id {kind}, status string, attempts int, locked_by string, last_error string")


def queue_stream(commands: DataFrame, most_attempts: int = 3) -> DataFrame:
    """The same on a stream of commands: each batch emits the new state of the runs it touched."""
    kind = commands.schema["run_id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq").astype(object).where(lambda x: x.notna(), None).to_dict("records")
        held = dict(zip(_FIELDS, state.get)) if state.exists else {"status": None, "attempts": 0, "locked_by": None, "last_error": None}
        held = apply_commands(held, rows, most_attempts)
        state.update(tuple(held[f] for f in _FIELDS))
        yield pd.DataFrame([{"run_id": key[0], **held}])

    return commands.groupBy("run_id").applyInPandasWithState(step,
        f"run_id {kind}, status string, attempts int, locked_by string, last_error string",
        "status string, attempts int, locked_by string, last_error string", "update", GroupStateTimeout.NoTimeout)
