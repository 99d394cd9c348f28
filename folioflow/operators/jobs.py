"""Running work on the driver: jobs in groups that can be canceled, leases kept while they run, and a worker's loop."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession


class Canceled(Exception):
    """The work was canceled; its entry is not a failure."""


class JobRunner:
    """At most ``workers`` jobs at a time, each a Spark job group named by its run, so that one can be stopped on the cluster."""

    def __init__(self, spark: SparkSession, workers: int = 2):
        self.spark, self.pool, self.futures = spark, ThreadPoolExecutor(workers), {}

    def submit(self, run_id: str, job: Callable[[], object]) -> Future:
        def run():
            self.spark.sparkContext.setJobGroup(run_id, run_id, interruptOnCancel=True)
            return job()

        self.futures[run_id] = self.pool.submit(run)
        return self.futures[run_id]

    def cancel(self, run_id: str) -> None:
        if run_id in self.futures:
            self.futures[run_id].cancel()
        self.spark.sparkContext.cancelJobGroup(run_id)

    def wait(self) -> None:
        for future in list(self.futures.values()):
            if not future.cancelled():
                future.exception()


def heartbeat_seconds(lease_seconds: float) -> float:
    return max(1.0, min(30.0, lease_seconds / 3))


def with_heartbeat(job: Callable[[], object], beat: Callable[[], bool], stop: Callable[[], None], seconds: float) -> object:
    """The job's result. ``beat`` extends its lease every so many seconds; when it can't, ``stop`` is called and the job counts as canceled."""
    done, lost = threading.Event(), threading.Event()

    def keep() -> None:
        while not done.wait(seconds):
            if not beat():
                lost.set()
                stop()
                return

    keeper = threading.Thread(target=keep, daemon=True)
    keeper.start()
    try:
        result = job()
    except Exception:
        if lost.is_set():
            raise Canceled("the lease was lost") from None
        raise
    finally:
        done.set()
        keeper.join()
    if lost.is_set():
        raise Canceled("the lease was lost")
    return result


def run_forever(turn: Callable[[], bool], stopped: threading.Event, poll_seconds: float = 1.0) -> int:
    """Turns until stopped; waits after one that found nothing to do. The number of turns that did work."""
    worked = 0
    while not stopped.is_set():
        if turn():
            worked += 1
        else:
            stopped.wait(poll_seconds)
    return worked
