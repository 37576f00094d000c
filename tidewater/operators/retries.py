"""Bounded retries with exponential backoff, traced over recorded statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.requests import status_kind


def backoff_delay(base: Column, attempt: Column) -> Column:
    """Seconds to sleep after the attempt with this number, counted from 0."""
    return base * F.pow(F.lit(2.0), attempt)


def retry_trace(df: DataFrame, statuses: str = "statuses", max_retries: str = "max_retries", backoff: float = 1.0) -> DataFrame:
    """Add ``attempts, outcome, last_status, slept`` for statuses that attempts would meet in turn.

    There are ``max_retries + 1`` attempts; a negative number means none, and so exhaustion at once.
    Transient statuses are tried again; all others end the row.  No sleep follows the last attempt.
    """
    allowed = F.greatest(F.col(max_retries) + 1, F.lit(0))
    tried = F.slice(F.col(statuses), F.lit(1), allowed.cast("int"))
    ended = F.array_position(F.transform(tried, lambda s: status_kind(s) != "transient"), True).cast("int")
    attempts = F.when(ended > 0, ended).otherwise(F.size(tried))
    last = F.when(attempts > 0, F.get(F.col(statuses), attempts - 1))
    outcome = F.when(ended > 0, status_kind(last)).otherwise("exhausted")
    slept = F.lit(backoff) * (F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1) - 1)
    return df.select(
        "*", attempts.alias("attempts"), outcome.alias("outcome"), last.alias("last_status"), slept.alias("slept")
    )


def exit_code(outcome: Column) -> Column:
    """0 for a reply, 2 for wrong usage, 1 for any failure of the request."""
    return F.when(outcome == "ok", 0).when(outcome == "invalid_usage", 2).otherwise(1)
