"""Requests to a chat-completions endpoint and what their statuses mean."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

ENDPOINT = "/chat/completions"
#: Credentials of an authorization header, wherever it is repeated.
CREDENTIALS = r"(?i)\b(bearer|basic)\s+[^\s\"',;]+"
#: Settings whose empty override counts; for all others it stands for none.
EMPTY_COUNTS = frozenset({"api_key"})


def endpoint_url(base_url: Column) -> Column:
    """The base without trailing slashes, and the endpoint's path."""
    return F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit(ENDPOINT))


def payload(prompt: Column, model: Column) -> Column:
    """The request body: a single user message.  Null for a null prompt."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    body = F.to_json(F.struct(model.alias("model"), F.array(message).alias("messages")))
    return F.when(prompt.isNotNull(), body)


def status_kind(status: Column) -> Column:
    """``ok``, ``transient`` (to be tried again), ``permanent``, or ``unhandled`` (neither success nor error)."""
    return (
        F.when((status == 429) | (status >= 500), "transient")
        .when(status >= 400, "permanent")
        .when(status.between(200, 299), "ok")
        .otherwise("unhandled")
    )


def basic_authorization(basic: Column, client_id: Column, secret: Column) -> Column:
    """A ready header as it is, else one built from id and secret."""
    made = F.regexp_replace(F.base64(F.encode(F.concat(client_id, F.lit(":"), secret), "UTF-8")), r"[\r\n]", "")
    return F.when(F.coalesce(basic, F.lit("")) != "", basic).otherwise(F.concat(F.lit("Basic "), made))


def bearer(provider_token: Column, api_key: Column, has_provider: Column) -> Column:
    """The token to send: the provider's wins over the static key; an empty one means no header."""
    token = F.when(has_provider, provider_token).otherwise(api_key)
    return F.when(F.coalesce(token, F.lit("")) != "", F.concat(F.lit("Bearer "), token))


def override(value: Column, base: Column, *, keep_empty: bool = False) -> Column:
    """A setting with its override; an empty override counts only with ``keep_empty``."""
    return F.coalesce(value if keep_empty else F.nullif(value, F.lit("")), base)


def redact(message: Column) -> Column:
    """A message without the credentials of an authorization header, in case an endpoint repeats them."""
    return F.regexp_replace(message, CREDENTIALS, "$1 ***")


def told(error: BaseException) -> str:
    """An error and what caused it, each once, without credentials."""
    said: list[str] = []
    cause: BaseException | None = error
    while cause is not None and len(said) < 5:
        text = f"{type(cause).__name__}: {cause}" if str(cause) else type(cause).__name__
        if not any(str(cause) and str(cause) in x for x in said):
            said.append(text)
        cause = cause.__cause__ or cause.__context__
    return re.sub(CREDENTIALS, r"\1 ***", "; ".join(said))
