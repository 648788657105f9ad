"""A worker over the job table: claim a few due jobs, run their handlers, finish, reap; until stopped or drained."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import QueueSettings
from quarry.operators import jobs as J

#: Seconds between two looks at over-long leases while nothing is due.
REAP_SECONDS = 60.0


class Permanent(Exception):
    """A job that no retry can help."""


def preflight(settings: dict) -> list[str]:
    """Reasons not to start a worker: what other processes could not see."""
    out = []
    if settings.get("repository", "tables") == "memory":
        out.append("the repository lives in this process alone")
    if settings.get("index", "tables") == "local" and not settings.get("allow_local"):
        out.append("the index is open in one process alone")
    return out


def dispatched(jobs: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Running jobs of a type that nobody handles fail at once, whatever tries are left."""
    lost = (F.col("status") == "running") & ~F.coalesce(F.col("job_type").isin(*known), F.lit(False))
    return jobs.withColumns({"status": F.when(lost, "failed").otherwise(F.col("status")), "last_error": F.when(lost, F.concat(F.lit("unknown_job_type: "), F.coalesce("job_type", F.lit("")))).otherwise(F.col("last_error"))})


@dataclass
class Worker:
    """``read`` and ``write`` give and take the job table; ``handlers`` take a claimed job's row and return its document id or null."""

    spark: SparkSession
    read: Callable[[], DataFrame]
    write: Callable[[DataFrame], None]
    handlers: dict[str, Callable[[dict], int | None]]
    name: str = "worker"
    settings: QueueSettings = field(default_factory=QueueSettings)
    clock: Callable[[], dt.datetime] = dt.datetime.now
    stopping: threading.Event = field(default_factory=threading.Event)
    reaped: dt.datetime | None = None

    def stop(self) -> None:
        """Finish the jobs at hand and take no more."""
        self.stopping.set()

    def step(self) -> int:
        """One round; the number of jobs that it took."""
        now = self.clock()
        if self.reaped is None or (now - self.reaped).total_seconds() >= REAP_SECONDS:
            self.write(J.reap(self.read(), now))
            self.reaped = now
        picked, table = J.claim(self.read(), now, self.name, self.settings)
        rows = [r.asDict() for r in picked.collect()]  # at most batch_size
        if not rows:
            return 0
        self.write(table)
        results = []
        for r in rows:
            handler = self.handlers.get(r.get("job_type"))
            try:
                if handler is None:
                    raise Permanent(f"unknown_job_type: {r.get('job_type')}")
                results.append((r["job_id"], None, handler(r), None))
            except Permanent as e:
                results.append((r["job_id"], J.PERMANENT[0], None, str(e)))
            except Exception as e:  # noqa: BLE001  the job is tried again until its tries are over
                results.append((r["job_id"], "error", None, f"{type(e).__name__}: {e}"))
        self.write(J.finish(self.read(), self.spark.createDataFrame(results, "job_id long, error_code string, document_id long, error string"), self.clock()))
        return len(rows)

    def run(self, drain: bool = False, seconds: float = 1.0) -> int:
        """Rounds until stopped; with ``drain`` until nothing is due. The number of jobs done."""
        done = 0
        while not self.stopping.is_set():
            n = self.step()
            done += n
            if not n:
                if drain:
                    break
                self.stopping.wait(seconds)
        return done
