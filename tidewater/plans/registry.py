"""The registered queries of the core library, with the SQL that says the same.

The tables have no statuses, response bodies or tokens, so these inputs are
derived from keys, in the same way in both.
"""

from __future__ import annotations

import collections
import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions.replies import expires_at, reply
from tidewater.functions.requests import basic_authorization, bearer, endpoint_url, override, payload, status_kind
from tidewater.functions.text import join_words, prompt_status, strip, until_blank
from tidewater.operators.completion import complete
from tidewater.operators.retries import exit_code, retry_trace
from tidewater.operators.token_cache import refresh_trace
from tidewater.plans.storage import shared_folder

STATUSES = (200, 204, 302, 400, 401, 404, 429, 500, 501, 503)
_PADS = ("", " ", "\t ", " \n\u001c")
LIFETIME = 21_600.0


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, index: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").where("role = 'user'")


def prompt_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies of all user turns."""
    return _user_turns(spark, sf_dir).select("conv_id", "turn", payload(F.col("text"), F.lit("gpt-4o-mini")).alias("payload"))


def prompt_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as words with odd white space around, joined and stripped; every seventh is blank."""
    pad = _pick(_PADS, F.col("conv_id") % len(_PADS))
    words = F.when(F.col("turn") % 7 == 6, F.array(pad)).otherwise(F.concat(F.array(pad), F.split("text", " "), F.array(pad)))
    df = _read(spark, sf_dir, "conversations").select("conv_id", "turn", join_words(words).alias("prompt"))
    return df.select("*", prompt_status(F.col("prompt")).alias("status"))


def prompt_until_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be typed before the first blank line, for three ways to lay out a turn."""
    text = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\n \n"), F.col("text"), F.lit("\nmore\n\t\nrest")))
        .when(F.col("turn") % 3 == 1, F.concat(F.col("text"), F.lit("\n\n"), F.col("text")))
        .otherwise(F.lit("\n  \n"))
    )
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", until_blank(text).alias("prompt"))


def http_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meaning of a status for each event."""
    df = _read(spark, sf_dir, "events").select("event_id", _pick(STATUSES, F.col("event_id") % 10).alias("status"))
    return df.select("*", status_kind(F.col("status")).alias("kind"))


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, outcome and time slept for the statuses that each event would meet."""
    df = _read(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_id") % 5 - 1).alias("max_retries"),
        F.array(*(_pick(STATUSES, (F.col("event_id") * 7 + F.lit(3 * k) * (F.col("event_id") % 4)) % 10) for k in range(4))).alias("statuses"),
    )
    return retry_trace(df).drop("statuses")


def reply_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text or error of response bodies: good, null content, empty, wrong shapes, malformed."""
    good = F.to_json(F.struct(F.array(F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))).alias("choices")))
    bodies = (
        good, F.lit('{"choices":[{"message":{"content":null}}]}'), F.lit('{"unexpected":"shape"}'),
        F.lit('{"choices":[]}'), F.lit('{"choices":[{"message":{"content":""}}]}'), F.concat(F.lit("not json "), F.col("text")),
    )
    df = _read(spark, sf_dir, "conversations")
    df = df.select("conv_id", "turn", reply(F.get(F.array(*bodies), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))).alias("r"))
    return df.select("conv_id", "turn", F.col("r.text").alias("text"), F.col("r.error").alias("error"))


def token_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry from token responses: seconds, milliseconds, lifetimes, nulls and words."""
    at = F.col("event_id") + 1_700_000_000
    bodies = (
        F.concat(F.lit('{"expires_at":'), at, F.lit("}")), F.concat(F.lit('{"expires_at":'), at * 1000, F.lit("}")),
        F.concat(F.lit('{"expires_in":'), F.col("event_id") % 4000, F.lit("}")), F.lit('{"expires_at":null,"expires_in":90}'),
        F.lit('{"expires_at":"soon","expires_in":120}'), F.lit('{"expires_in":"later"}'), F.lit("{}"), F.lit('{"expires_at":1000000000000}'),
    )
    now = (at - 500).cast("double")
    body = F.get(F.array(*bodies), (F.col("event_id") % 8).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", expires_at(body, now).alias("expires_at"))


def token_refresh_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and renewals for each user."""
    df = _read(spark, sf_dir, "events").withColumn("now", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))
    trace = refresh_trace(df, "user_id", "now", "event_id", LIFETIME)
    return trace.groupBy(F.col("client").alias("user_id")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if("refreshed").alias("n_renewals")
    )


def token_refresh_hot_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where one client makes half of all calls, which are walked in many segments."""
    df = _read(spark, sf_dir, "events").withColumn("now", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))
    df = df.withColumn("client", F.when(F.col("event_id") % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")))
    trace = refresh_trace(df, "client", "now", "event_id", LIFETIME, segment=512)
    return trace.groupBy("client").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if("refreshed").alias("n_renewals"), F.max(F.when(F.col("refreshed"), F.col("now"))).alias("last_renewal")
    )


def oauth_basic_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorization headers for token requests; every fifth client has a ready one."""
    ready = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Basic ready-"), F.col("c_custkey"))).otherwise("")
    secret = F.concat(F.repeat("c_mktsegment", 6), F.lit("ü"), F.col("c_custkey"))
    return _read(spark, sf_dir, "customer").select("c_custkey", basic_authorization(ready, F.col("c_name"), secret).alias("header"))


def config_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings under absent, empty and given overrides, and the token header they lead to."""
    k = F.col("c_custkey") % 3
    given = F.when(k == 0, F.lit(None)).when(k == 1, "").otherwise(F.col("c_name"))
    key = override(given, F.lit("base-key"), keep_empty=True)
    provider = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("t"), F.col("c_custkey"))).otherwise("")
    return _read(spark, sf_dir, "customer").select(
        "c_custkey",
        override(given, F.lit("https://a/v1")).alias("base_url"), override(given, F.lit("m")).alias("model"), key.alias("api_key"),
        bearer(provider, key, F.col("c_custkey") % 2 == 0).alias("header"),
    )


def endpoint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints for base URLs with none to three trailing slashes."""
    base = F.concat(F.col("url"), F.repeat(F.lit("/"), (F.col("page_id") % 4).cast("int")))
    return _read(spark, sf_dir, "pages").select("page_id", endpoint_url(base).alias("endpoint"))


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit code for each event's outcome, where every ninth prompt is empty."""
    usage = prompt_status(F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("event_type")))
    outcome = F.when(usage != "ok", usage).otherwise(status_kind(_pick(STATUSES, F.col("event_id") % 10)))
    return _read(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"), exit_code(outcome).alias("exit_code"))


class EchoTransport:
    """A stand-in for an endpoint: echoes, or fails by the prompt's length."""

    def __init__(self) -> None:
        self.seen = 0
        self.last = ""

    def send(self, body: str) -> tuple[int, str]:
        prompt = json.loads(body)["messages"][0]["content"]
        self.seen = self.seen + 1 if body == self.last else 1
        self.last = body
        n = len(prompt)
        if n % 11 == 0:
            return 401, "denied"
        if n % 13 == 0:
            return 503, "busy"
        if n % 7 == 0 and self.seen == 1:
            return 429, "slow down"
        if n % 17 == 0:
            return 200, '{"choices":[]}'
        return 200, json.dumps({"choices": [{"message": {"content": f"echo: {prompt}"}}]})


def batch_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns, stripped, completed by a stand-in endpoint with two retries."""
    prompts = _user_turns(spark, sf_dir).select("conv_id", "turn", strip(F.col("text")).alias("prompt"))
    return complete(prompts, EchoTransport, ["conv_id", "turn"], max_retries=2, backoff=0.0)


class CountingEcho:
    """The same for many threads, if all bodies differ: what it says depends on the body and how often it came."""

    def __init__(self) -> None:
        self.seen: collections.Counter[str] = collections.Counter()
        self.lock = threading.Lock()

    def send(self, body: str) -> tuple[int, str]:
        with self.lock:
            self.seen[body] += 1
            echo = EchoTransport()
            echo.last, echo.seen = body, self.seen[body] - 1
        return echo.send(body)


def batch_complete_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns with their place before them, completed with 16 requests of a task in flight."""
    prompt = F.concat_ws(" ", "conv_id", "turn", strip(F.col("text")))
    prompts = _user_turns(spark, sf_dir).select("conv_id", "turn", prompt.alias("prompt"))
    return complete(prompts, CountingEcho, ["conv_id", "turn"], max_retries=2, backoff=0.001, in_flight=16)


class SecondTime(EchoTransport):
    """Refuses what the first run has sent: prompts of an even length."""

    def send(self, body: str) -> tuple[int, str]:
        if len(json.loads(body)["messages"][0]["content"]) % 2 == 0:
            return 403, "sent twice"
        return super().send(body)


class FirstTime(EchoTransport):
    """Answers without trouble what the other would refuse."""

    def send(self, body: str) -> tuple[int, str]:
        return 200, json.dumps({"choices": [{"message": {"content": "kept: " + json.loads(body)["messages"][0]["content"]}}]})


def batch_complete_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns, where an earlier run has left the answers to prompts of an even length in a ledger."""
    prompts = _user_turns(spark, sf_dir).select("conv_id", "turn", strip(F.col("text")).alias("prompt"))
    ledger = f"{shared_folder(spark)}/tidewater/ledger-{uuid.uuid4().hex}"
    options = {"keys": ["conv_id", "turn"], "max_retries": 2, "backoff": 0.0, "ledger": ledger}
    complete(prompts.where(F.length("prompt") % 2 == 0), FirstTime, **options).write.format("noop").mode("overwrite").save()
    return complete(prompts, SecondTime, **options)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "prompt_payload": prompt_payload,
        "prompt_normalise": prompt_normalise,
        "prompt_until_blank": prompt_until_blank,
        "http_outcome": http_outcome,
        "retry_trace": retries,
        "reply_extract": reply_extract,
        "token_expiry": token_expiry,
        "token_refresh_trace": token_refresh_trace,
        "token_refresh_hot_client": token_refresh_hot_client,
        "oauth_basic_header": oauth_basic_header,
        "config_precedence": config_precedence,
        "endpoint_url": endpoint_urls,
        "exit_code": exit_codes,
        "batch_complete": batch_complete,
        "batch_complete_in_flight": batch_complete_in_flight,
        "batch_complete_resumed": batch_complete_resumed,
    }


_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def _kind(x: str) -> str:
    return (
        f"CASE WHEN {x} = 429 OR {x} >= 500 THEN 'transient' WHEN {x} >= 400 THEN 'permanent' "
        f"WHEN {x} BETWEEN 200 AND 299 THEN 'ok' ELSE 'unhandled' END"
    )


def _chain(client: str, window: float) -> str:
    return f"""
        SELECT {client}, min(now) AS at FROM c GROUP BY {client}
        UNION ALL
        SELECT c.{client}, min(c.now) FROM chain JOIN c ON c.{client} = chain.{client} AND c.now >= chain.at + {window}
        GROUP BY c.{client}"""


def _completed(prompt: str, more: str = "") -> str:
    """What the stand-in endpoint makes of prompts, with two retries."""
    return f"""
        SELECT conv_id, turn, CASE WHEN kind = 'ok' THEN 'echo: ' || prompt END AS text,
          CAST(CASE kind WHEN 'request' THEN 401 WHEN 'retry_exhausted' THEN 503 WHEN 'invalid_usage' THEN NULL ELSE 200 END AS INTEGER) AS status,
          nullif(kind, 'ok') AS error_class,
          CASE kind WHEN 'invalid_usage' THEN 'no prompt' WHEN 'request' THEN 'HTTP 401: denied'
            WHEN 'retry_exhausted' THEN 'no reply after 3 attempts: HTTP 503: busy'
            WHEN 'response_shape' THEN 'unexpected response: {{"choices":[]}}' END AS error_message,
          CAST(CASE WHEN kind = 'invalid_usage' THEN 0 WHEN kind = 'request' THEN 1 WHEN kind = 'retry_exhausted' THEN 3
            WHEN length(prompt) % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts{more}
        FROM (SELECT *, CASE WHEN coalesce(prompt, '') = '' THEN 'invalid_usage' WHEN length(prompt) % 11 = 0 THEN 'request'
            WHEN length(prompt) % 13 = 0 THEN 'retry_exhausted' WHEN length(prompt) % 17 = 0 THEN 'response_shape' ELSE 'ok' END AS kind
          FROM (SELECT conv_id, turn, {prompt} AS prompt FROM conversations WHERE role = 'user'))"""


def oracle_sql() -> dict[str, str]:
    codes = "[" + ", ".join(map(str, STATUSES)) + "]"
    pad = "CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN chr(9) || chr(160) ELSE chr(8195) || chr(10) || chr(28) END"
    early = LIFETIME - 60
    return {
        "prompt_payload": """
            SELECT conv_id, turn, CAST(to_json({'model': 'gpt-4o-mini', 'messages': [{'role': 'user', 'content': text}]}) AS VARCHAR) AS payload
            FROM conversations WHERE role = 'user'""",
        "prompt_normalise": f"""
            SELECT conv_id, turn, prompt, CASE WHEN prompt = '' THEN 'invalid_usage' ELSE 'ok' END AS status FROM (
              SELECT conv_id, turn, {_strip("CASE WHEN turn % 7 = 6 THEN pad ELSE pad || ' ' || text || ' ' || pad END")} AS prompt
              FROM (SELECT *, {pad} AS pad FROM conversations))""",
        "prompt_until_blank": f"""
            SELECT conv_id, turn, {_strip("CASE turn % 3 WHEN 0 THEN text || chr(10) || 'more' WHEN 1 THEN text ELSE '' END")} AS prompt
            FROM conversations""",
        "http_outcome": f"""
            SELECT event_id, status, {_kind("status")} AS kind
            FROM (SELECT event_id, {codes}[event_id % 10 + 1] AS status FROM events)""",
        "retry_trace": f"""
            WITH s AS (
              SELECT event_id, event_id % 5 - 1 AS max_retries, k, {codes}[(event_id * 7 + 3 * k * (event_id % 4)) % 10 + 1] AS status
              FROM events, range(4) r(k)),
            t AS (SELECT *, {_kind("status")} AS kind FROM s),
            e AS (
              SELECT event_id, max_retries, min(CASE WHEN k <= max_retries AND kind <> 'transient' THEN k END) AS ended
              FROM t GROUP BY event_id, max_retries),
            f AS (SELECT *, coalesce(ended + 1, max_retries + 1) AS attempts FROM e)
            SELECT f.event_id, f.max_retries, f.attempts, CASE WHEN ended IS NULL THEN 'exhausted' ELSE t.kind END AS outcome,
              t.status AS last_status, CAST(power(2, greatest(attempts, 1) - 1) - 1 AS DOUBLE) AS slept
            FROM f LEFT JOIN t ON t.event_id = f.event_id AND t.k = f.attempts - 1""",
        "reply_extract": """
            SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN text WHEN 4 THEN '' END AS text,
              CASE (conv_id + turn) % 6 WHEN 1 THEN 'empty_content' WHEN 2 THEN 'response_shape' WHEN 3 THEN 'response_shape'
                WHEN 5 THEN 'malformed_json' END AS error
            FROM conversations""",
        "token_expiry": """
            SELECT event_id, CAST(CASE event_id % 8
              WHEN 0 THEN event_id + 1700000000 WHEN 1 THEN event_id + 1700000000 WHEN 2 THEN now + event_id % 4000
              WHEN 3 THEN now + 90 WHEN 4 THEN now + 120 WHEN 7 THEN 1000000000000 ELSE now + 1800 END AS DOUBLE) AS expires_at
            FROM (SELECT event_id, event_id + 1699999500 AS now FROM events)""",
        "token_refresh_trace": f"""
            WITH RECURSIVE c AS (SELECT user_id, floor(epoch(ts)) AS now FROM events),
            chain AS ({_chain("user_id", early)})
            SELECT user_id, n_calls, n_renewals FROM (SELECT user_id, count(*) AS n_renewals FROM chain GROUP BY user_id)
            JOIN (SELECT user_id, count(*) AS n_calls FROM c GROUP BY user_id) USING (user_id)""",
        "token_refresh_hot_client": f"""
            WITH RECURSIVE c AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS client, floor(epoch(ts)) AS now FROM events),
            chain AS ({_chain("client", early)})
            SELECT client, n_calls, n_renewals, last_renewal
            FROM (SELECT client, count(*) AS n_renewals, max(chain.at) AS last_renewal FROM chain GROUP BY client)
            JOIN (SELECT client, count(*) AS n_calls FROM c GROUP BY client) USING (client) WHERE client IS NOT NULL""",
        "oauth_basic_header": """
            SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Basic ready-' || c_custkey
              ELSE 'Basic ' || to_base64(encode(c_name || ':' || repeat(c_mktsegment, 6) || 'ü' || c_custkey)) END AS header
            FROM customer""",
        "config_precedence": """
            SELECT c_custkey, coalesce(nullif(given, ''), 'https://a/v1') AS base_url, coalesce(nullif(given, ''), 'm') AS model,
              coalesce(given, 'base-key') AS api_key,
              'Bearer ' || nullif(CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 't' || c_custkey ELSE '' END
                ELSE coalesce(given, 'base-key') END, '') AS header
            FROM (SELECT *, CASE c_custkey % 3 WHEN 1 THEN '' WHEN 2 THEN c_name END AS given FROM customer)""",
        "endpoint_url": """
            SELECT page_id, rtrim(url, '/') || '/chat/completions' AS endpoint FROM pages""",
        "exit_code": f"""
            SELECT event_id, outcome, CASE outcome WHEN 'ok' THEN 0 WHEN 'invalid_usage' THEN 2 ELSE 1 END AS exit_code FROM (
              SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_type = '' OR event_type IS NULL THEN 'invalid_usage' ELSE {_kind(f"{codes}[event_id % 10 + 1]")} END AS outcome
              FROM events)""",
        "batch_complete": _completed(_strip("text")),
        "batch_complete_in_flight": _completed(f"conv_id || ' ' || turn || ' ' || {_strip('text')}"),
        "batch_complete_resumed": f"""
            SELECT conv_id, turn, CASE WHEN even THEN 'kept: ' || prompt ELSE text END AS text, CAST(CASE WHEN even THEN 200 ELSE status END AS INTEGER) AS status,
              CASE WHEN NOT even THEN error_class END AS error_class, CASE WHEN NOT even THEN error_message END AS error_message,
              CAST(CASE WHEN even THEN 1 ELSE attempts END AS INTEGER) AS attempts
            FROM (SELECT *, length(prompt) % 2 = 0 AND prompt <> '' AS even FROM ({_completed(_strip("text"), more=", prompt")}))""",
    }
