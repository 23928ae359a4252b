"""Ages of domains by a function of the user's own, run in child processes of the executors with a deadline each.

The function takes a domain and returns its creation date: an ISO string, milliseconds since 1970, a date or a time, alone or
as ``{"creation_date": ...}``. All else, an exception, a process that dies and a call beyond the deadline are failures,
which are rows and don't stop the job. A call beyond its deadline is killed.
"""

from __future__ import annotations

import datetime as dt
import math
import multiprocessing
import resource
import time
from collections.abc import Callable, Iterator
from multiprocessing.connection import wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.operators.ages import first_ok, resolve

#: Seconds of a call, calls at a time in a task, bytes of memory that a call may add.
DEADLINE, IN_FLIGHT, MEMORY = 5.0, 4, 256 * 2**20
FOUND = "domain string, creation_date timestamp, status string, error string"
#: What the function is tested with.
TEST_DOMAIN = "wikipedia.org"


def as_time(value: object) -> dt.datetime:
    """The creation date that a function returned, in UTC; ValueError if it is none."""
    if isinstance(value, dict):
        value = value.get("creation_date")
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.strip())
    elif isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value):
        value = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value)
    elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if not isinstance(value, dt.datetime):
        raise ValueError("no creation date")
    return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value


def _call(lookup: Callable, domain: str, to, memory: int) -> None:
    """In the child: one call, its answer or error sent back."""
    try:
        used = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
        resource.setrlimit(resource.RLIMIT_AS, (used + memory, used + memory))
    except (OSError, ValueError):  # no such limit here
        pass
    try:
        to.send(("ok", as_time(lookup(domain))))
    except BaseException as error:  # noqa: BLE001  whatever the user's function does
        to.send(("failed", f"{type(error).__name__}: {error}"[:300]))


def run_calls(lookup: Callable, domains: Iterator[str], deadline: float = DEADLINE, in_flight: int = IN_FLIGHT, memory: int = MEMORY) -> Iterator[tuple]:
    """Rows of FOUND for each domain, as its call ends; at most ``in_flight`` run at once, and no more domains are read than that."""
    context, running, domains, more = multiprocessing.get_context("fork"), {}, iter(domains), True
    try:
        while more or running:
            while more and len(running) < in_flight:
                domain = next(domains, None)
                if domain is None:
                    more = False
                    break
                mine, theirs = context.Pipe(duplex=False)
                child = context.Process(target=_call, args=(lookup, domain, theirs, memory), daemon=True)
                child.start()
                theirs.close()
                running[mine] = (domain, child, time.monotonic() + deadline)
            if not running:
                continue
            ready = wait(list(running), max(0.0, min(x[2] for x in running.values()) - time.monotonic()))
            late = [c for c, x in running.items() if c not in ready and x[2] <= time.monotonic()]
            for connection in [*ready, *late]:
                domain, child, _ = running.pop(connection)
                try:
                    status, value = connection.recv() if connection in ready else ("failed", f"no answer in {deadline:g} seconds")
                except EOFError:
                    status, value = "failed", "the call ended without an answer"
                connection.close()
                if connection in late:
                    child.kill()
                child.join()
                yield domain, value if status == "ok" else None, status, None if status == "ok" else value
    finally:
        for connection, (_, child, _) in running.items():
            child.kill()
            child.join()
            connection.close()


def query_ages(domains: DataFrame, lookup: Callable, deadline: float = DEADLINE, in_flight: int = IN_FLIGHT, memory: int = MEMORY) -> DataFrame:
    """A row per distinct domain that isn't null: ``domain``, ``creation_date``, ``status`` (ok or failed) and ``error``.

    Calls at a time are ``in_flight`` in each task. A task that is run again asks again. Results of slow functions should
    be written before they are used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (d for batch in batches for d in batch.column(0).to_pylist())
        for domain, date, status, error in run_calls(lookup, names, deadline, in_flight, memory):
            columns = [pa.array([domain], pa.string()), pa.array([date], pa.timestamp("us", "UTC") if date is None else pa.timestamp("us")).cast(pa.timestamp("us", "UTC")), pa.array([status]), pa.array([error], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["domain", "creation_date", "status", "error"])

    return domains.select(F.col("domain").cast("string").alias("domain")).where("domain is not null").distinct().mapInArrow(run, FOUND)


def resolve_with(domains: DataFrame, cache: DataFrame, lookup: Callable, **limits) -> DataFrame:
    """``domains`` with date, status and source: a cached success, else what the function finds. It is called only for domains without a cached success; a cached failure doesn't stop a new call."""
    wanted = domains.select("domain").distinct().join(first_ok(cache).select("domain"), "domain", "left_anti")
    return resolve(domains, cache, query_ages(wanted, lookup, **limits).select("domain", "creation_date", "status"))


def try_age(lookup: Callable, **limits) -> tuple[bool, str]:
    """Whether the function gives a date for ``wikipedia.org``, and the date or the error; runs here, under the same limits."""
    _, date, status, error = next(run_calls(lookup, iter([TEST_DOMAIN]), **limits))
    return status == "ok", date.isoformat() if status == "ok" else error
