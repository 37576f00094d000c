"""Completion of a DataFrame of prompts.

Prompts are projected to request bodies by Spark, sent from ``mapInArrow`` with
retries, and the raw outcome (status, body, attempts) is classified by Spark
again.  Failures are columns, so one bad row doesn't end a job.

Without a ledger the sending stage runs once for each time its result is read, and again for the
rows of a task that is retried: write its result before analysing it, and filter
before it.  With a ledger (see :mod:`tidewater.operators.ledger`) what has an answer isn't sent again.

The number of running tasks times the requests that each has in flight bounds the concurrency.
"""

from __future__ import annotations

import concurrent.futures
import heapq
import itertools
import logging
import sys
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions.replies import reply
from tidewater.functions.requests import payload, redact, status_kind, told
from tidewater.functions.text import prompt_status
from tidewater.operators.ledger import Answer, Ledger, answered, request_id
from tidewater.plans.joins import broadcast_if_small

log = logging.getLogger(__name__)


class CompletionError(Exception):
    """Base of all failures of a completion."""


class RequestError(CompletionError):
    """A failure that another attempt wouldn't mend."""


class RetriesExhausted(RequestError):
    """Transient failures up to the last attempt."""


class NetworkError(Exception):
    """No response: the connection failed or timed out.  Worth another attempt."""


class Transport(Protocol):
    """Sends a request body; made on the executor, once for each task.

    With more than one request in flight it is used by as many threads.
    """

    def send(self, body: str) -> tuple[int, str]:
        """Status and response body; raises NetworkError, or RequestError where no attempt helps."""
        ...


class Sent(NamedTuple):
    """What became of one request."""

    status: int | None
    body: str | None
    attempts: int
    failure: str | None = None
    detail: str | None = None


_RAW = pa.schema(
    [("status", pa.int32()), ("body", pa.string()), ("attempts", pa.int32()), ("failure", pa.string()), ("detail", pa.string())]
)
#: Rows that a task gives out together, and rows that it has taken on at most.
_TOGETHER, _HELD = 64, 4096
#: Columns of a result beside the keys.
RESULT = ("text", "status", "error_class", "error_message", "attempts")


class _Row:
    """A request and, sooner or later, what became of it."""

    __slots__ = ("body", "request", "sent")

    def __init__(self, body: str | None, request: str | None, sent: Sent | None):
        self.body, self.request, self.sent = body, request, sent


class _Sender:
    """The requests of a task: up to ``in_flight`` on their way, the others waiting for their turn or for another attempt."""

    def __init__(
        self, make_transport: Callable[[], Transport], max_retries: int, backoff: float, in_flight: int, note: Callable[[_Row], None]
    ):
        self.make_transport, self.max_retries, self.backoff, self.in_flight = make_transport, max_retries, backoff, in_flight
        self.note = note  # is told of each row that has come to its end
        self.transport: Transport | None = None
        self.broken: Sent | None = None
        self.ready: deque[tuple[_Row, int]] = deque()
        self.later: list[tuple[float, int, _Row, int]] = []
        self.running: dict[concurrent.futures.Future, tuple[_Row, int]] = {}
        self.order = itertools.count()
        self.pool = concurrent.futures.ThreadPoolExecutor(in_flight) if in_flight > 1 else None

    def add(self, row: _Row) -> None:
        """Take on a row; with one request in flight, this sees it to its end."""
        if row.sent:
            return
        if self.max_retries < 0:
            row.sent = Sent(None, None, 0, "retry_exhausted")
            return
        if not self.transport and not self.broken:
            try:
                self.transport = self.make_transport()
            except Exception as error:
                self.broken = Sent(None, None, 0, "unhandled", told(error))
        if self.broken:
            row.sent = self.broken
        elif self.pool:
            self.ready.append((row, 0))
        else:
            for attempt in itertools.count():
                delay = self._done(row, attempt, self._attempt(row.body, attempt))
                if delay is None:
                    break
                time.sleep(delay)

    def advance(self, enough: Callable[[], bool]) -> None:
        """Send until there has been enough of it."""
        while not enough():
            now = time.monotonic()
            while self.later and self.later[0][0] <= now:
                self.ready.appendleft(heapq.heappop(self.later)[2:])
            while self.ready and len(self.running) < self.in_flight:
                row, attempt = self.ready.popleft()
                self.running[self.pool.submit(self._attempt, row.body, attempt)] = row, attempt
            pause = self.later[0][0] - now if self.later else None
            if not self.running:
                time.sleep(pause or 0)
                continue
            done, _ = concurrent.futures.wait(self.running, pause, concurrent.futures.FIRST_COMPLETED)
            for future in done:
                row, attempt = self.running.pop(future)
                delay = self._done(row, attempt, future.result())
                if delay is not None:
                    heapq.heappush(self.later, (time.monotonic() + delay, next(self.order), row, attempt + 1))

    def close(self) -> None:
        if self.pool:
            self.pool.shutdown(wait=False, cancel_futures=True)

    def _attempt(self, body: str, attempt: int) -> tuple[Sent, bool]:
        """What became of one attempt, and whether another may mend it."""
        try:
            status, text = self.transport.send(body)
        except NetworkError as error:
            return Sent(None, None, attempt + 1, "retry_exhausted", str(error)), True
        except Exception as error:
            known = isinstance(error, RequestError)
            return Sent(None, None, attempt + 1, "request" if known else "unhandled", str(error) if known else told(error)), False
        again = status == 429 or status >= 500
        return Sent(status, text, attempt + 1, "retry_exhausted" if again else None), again

    def _done(self, row: _Row, attempt: int, result: tuple[Sent, bool]) -> float | None:
        """Note the end of a row; the seconds until the next attempt if it has another."""
        sent, again = result
        if again:
            log.warning("attempt %d: %s", attempt + 1, sent.detail or f"HTTP {sent.status}")
        if not again or attempt >= self.max_retries:
            row.sent = sent
            self.note(row)
            return None
        delay = self.backoff * 2**attempt
        log.info("trying again in %.2f s", delay)
        return delay


def _log_in_worker(level: int) -> None:
    """Log to the worker's standard error, from the level that the driver has."""
    logger = logging.getLogger("tidewater")
    if not logger.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(levelname)s:%(name)s:%(message)s"))
        logger.addHandler(handler)
        logger.propagate = False
    logger.setLevel(level)


def send_all(
    requests: DataFrame,
    make_transport: Callable[[], Transport],
    max_retries: int = 3,
    backoff: float = 1.0,
    in_flight: int = 1,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Send the ``payload`` column of each row; adds ``status, body, attempts, failure, detail``.

    Null payloads aren't sent.  Whatever a transport or its maker raises ends the row, never the task.
    A task has up to ``in_flight`` requests on their way; one that waits for another attempt isn't one of them.
    Rows come out in their order.  With one in flight, a row's attempts follow one another.
    With a ledger, the ``request`` column says what a request is known by; answers are written as they come in.
    """
    level = logging.getLogger("tidewater").getEffectiveLevel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _log_in_worker(level)
        held: deque[tuple[pa.RecordBatch, list[_Row]]] = deque()
        task = TaskContext.get().partitionId() if ledger else 0
        known = ledger.of_task(task) if ledger else {}
        answers: dict[str, Answer] = {}

        def note(row: _Row) -> None:
            if ledger and not row.sent.failure:
                answers[row.request] = Answer(row.sent.status, row.sent.body, row.sent.attempts)
                if len(answers) >= ledger.rows:
                    write()

        def write() -> None:
            if answers:
                ledger.write(task, answers)
                answers.clear()

        sender = _Sender(make_transport, max_retries, backoff, in_flight, note)

        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), _TOGETHER):
                    yield batch.slice(start, _TOGETHER)

        def is_done(rows: list[_Row]) -> bool:
            return all(row.sent for row in rows)

        def out() -> pa.RecordBatch:
            part, rows = held.popleft()
            made = [pa.array(values, field.type) for values, field in zip(zip(*(row.sent for row in rows)), _RAW)]
            return pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *_RAW.names])

        try:
            for part in parts():
                names = part.schema.names
                ids = part.column(names.index("request")).to_pylist() if ledger else [None] * len(part)
                rows = []
                for body, request in zip(part.column(names.index("payload")).to_pylist(), ids):
                    sent = Sent(None, None, 0) if body is None else Sent(*known[request]) if request in known else None
                    rows.append(_Row(body, request, sent))
                held.append((part, rows))
                for row in rows:
                    sender.add(row)
                sender.advance(lambda: not sender.ready)
                while held and (is_done(held[0][1]) or sum(len(rows) for _, rows in held) > _HELD):
                    sender.advance(lambda: is_done(held[0][1]))
                    yield out()
            while held:
                sender.advance(lambda: is_done(held[0][1]))
                yield out()
        finally:
            # What has come in is kept even if the task ends here.
            write()
            sender.close()

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInArrow(run, f"{columns}, status int, body string, attempts int, failure string, detail string")


def classify(sent: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, text, status, error_class, error_message, attempts`` from raw outcomes; keys are the first columns of ``sent``."""
    answer = reply(F.col("body"))
    kind = status_kind(F.col("status"))
    error = (
        F.when(F.col("usage") != "ok", F.col("usage"))
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(kind == "permanent", "request")
        .when(kind != "ok", "unhandled")
        .otherwise(answer["error"])
    )
    times = F.when(F.col("attempts") == 1, "1 attempt").otherwise(F.concat("attempts", F.lit(" attempts")))
    answered = F.concat(F.lit("HTTP "), F.col("status"))
    body = F.when(F.col("body") != "", F.concat(F.lit(": "), F.col("body"))).otherwise("")
    message = (
        F.when(F.col("usage") != "ok", "no prompt")
        .when(F.col("failure") == "retry_exhausted", F.concat(F.lit("no reply after "), times, F.coalesce(
            F.concat(F.lit(": "), F.coalesce(F.concat(answered, body), F.col("detail"))), F.lit(""))))
        .when(F.col("failure").isNotNull(), F.col("detail"))
        .when(kind != "ok", F.concat(answered, body))
        .when(answer["error"].isNotNull(), F.concat(F.lit("unexpected response"), body))
    )
    return sent.select(
        *(F.col(inner).alias(key) for inner, key in zip(sent.columns, keys)),
        F.when(error.isNull(), answer["text"]).alias("text"), "status", error.alias("error_class"),
        redact(message).alias("error_message"), "attempts",
    )


def complete(
    prompts: DataFrame,
    make_transport: Callable[[], Transport],
    keys: list[str],
    prompt: str = "prompt",
    model: str = "gpt-4o-mini",
    max_retries: int = 3,
    backoff: float = 1.0,
    on_error: str = "column",
    in_flight: int = 1,
    ledger: str | None = None,
    ledger_rows: int = 256,
    send_failed: bool = False,
) -> DataFrame:
    """Replies to prompts: ``keys, text, status, error_class, error_message, attempts``.

    Empty and null prompts aren't sent.  With ``on_error="raise"`` a failed row fails the query.
    Keys may have any names but those of the other columns.

    ``in_flight`` requests of a task are on their way at a time.  ``ledger`` is a folder that all executors share:
    requests that have an answer there are not sent, the others leave theirs there, at least every ``ledger_rows``
    of a task.  A refusal is an answer, too; with ``send_failed`` what was refused is sent again.  Requests without an answer always are.
    """
    if taken := set(keys) & set(RESULT):
        raise ValueError(f"keys have names of result columns: {', '.join(sorted(taken))}")
    usage = prompt_status(F.col(prompt))
    requests = prompts.select(
        *(F.col(key).alias(f"key{k}") for k, key in enumerate(keys)),
        usage.alias("usage"), F.when(usage == "ok", payload(F.col(prompt), F.lit(model))).alias("payload"),
    )
    if ledger is None:
        sent = send_all(requests, make_transport, max_retries, backoff, in_flight)
    else:
        book = Ledger.open(prompts.sparkSession, ledger, ledger_rows)
        done = answered(prompts.sparkSession, ledger, failed=not send_failed)
        requests = requests.withColumn("request", request_id([F.col(f"key{k}") for k in range(len(keys))], F.col("payload")))
        # If the ledger is small, requests stay where they are and the tasks as many as they were.
        waiting = requests.join(broadcast_if_small(done.select("request")), "request", "left_anti").select(requests.columns)
        nothing = F.lit(None).cast("string")
        old = requests.join(done, "request").select(*requests.columns, "status", "body", "attempts", nothing.alias("failure"), nothing.alias("detail"))
        sent = send_all(waiting, make_transport, max_retries, backoff, in_flight, book).union(old)
    out = classify(sent, keys)
    if on_error == "raise":
        failed = F.raise_error(F.concat_ws(": ", F.lit("completion failed"), "error_class", "error_message"))
        out = out.withColumn("text", F.when(F.col("error_class").isNotNull(), failed.cast("string")).otherwise(F.col("text")))
    return out


def send_prompt(spark: SparkSession, prompt: str, make_transport: Callable[[], Transport], **options) -> str:
    """The reply to one prompt; raises RetriesExhausted, RequestError, or ValueError for an empty prompt."""
    prompts = spark.createDataFrame([(0, prompt)], "prompt_id long, prompt string")
    row = complete(prompts, make_transport, ["prompt_id"], **options).head()
    match row["error_class"]:
        case None:
            return row["text"]
        case "invalid_usage":
            raise ValueError("no prompt")
        case "retry_exhausted":
            raise RetriesExhausted(row["error_message"])
        case other:
            raise RequestError(f"{other}: {row['error_message']}")
