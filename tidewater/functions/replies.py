"""What a response body says."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, functions as F

_CONTENT = "$.choices[0].message.content"
DEFAULT_LIFETIME = 1800.0
#: What counts as a number, also in a string.
NUMBER = r"[ \t\r\n]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*"


class End(NamedTuple):
    """A field that may say when a token ends, if its value is a number above a bound; works for columns and for floats."""

    field: str
    above: float
    at: Callable[[Any, Any], Any]


#: In order of preference.  Times above a bound are milliseconds.
ENDS = (
    End("expires_at", 1e12, lambda stated, now: stated / 1000),
    End("expires_at", -math.inf, lambda stated, now: stated),
    End("expires_in", -math.inf, lambda lifetime, now: now + lifetime),
)


def reply(body: Column) -> Column:
    """A struct of ``text`` and ``error``: ``malformed_json``, ``response_shape``, ``empty_content`` or null.

    Content that isn't a string is returned as its JSON text.
    """
    parsed = F.try_parse_json(body)
    content = F.try_variant_get(parsed, _CONTENT, "variant")
    error = (
        F.when(parsed.isNull(), "malformed_json")
        .when(content.isNull(), "response_shape")
        .when(F.is_variant_null(content), "empty_content")
    )
    text = F.when(error.isNull(), F.coalesce(F.try_variant_get(content, "$", "string"), F.to_json(content)))
    return F.struct(text.alias("text"), error.alias("error"))


def expires_at(body: Column, now: Column) -> Column:
    """When a token ends, in epoch seconds: what the first field of ``ENDS`` with a number says, else in 30 minutes."""
    names = list(dict.fromkeys(end.field for end in ENDS))

    def once(value: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of a value that is computed once, however often it is used."""
        return F.get(F.transform(F.array(value), then), 0)

    def stated(parsed: Column) -> Column:
        return F.struct(*(F.try_variant_get(parsed, f"$.{name}", "string").alias(name) for name in names))

    def numbers(text: Column) -> Column:
        said = (F.when(text[n].rlike(f"^{NUMBER}$"), F.trim(text[n], F.lit(" \t\r\n")).cast("double")).alias(n) for n in names)
        return F.struct(*said)

    def end_of(found: Column) -> Column:
        told = (F.when((F.abs(found[e.field]) < math.inf) & (found[e.field] > e.above), e.at(found[e.field], now)) for e in ENDS)
        return F.coalesce(*told, now + F.lit(DEFAULT_LIFETIME))

    return once(once(once(F.try_parse_json(body), stated), numbers), end_of)


def expiry(answer: dict[str, Any], now: float) -> float:
    """The same of a parsed body."""

    def number(value: Any) -> float | None:
        try:
            told = isinstance(value, (int, float)) and not isinstance(value, bool) or isinstance(value, str) and re.fullmatch(NUMBER, value)
            return float(value) if told and math.isfinite(float(value)) else None
        except OverflowError:
            return None

    found = ((end, number(answer.get(end.field))) for end in ENDS)
    return next((end.at(value, now) for end, value in found if value is not None and value > end.above), now + DEFAULT_LIFETIME)
