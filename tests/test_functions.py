import base64
import json
import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions.replies import expires_at, reply
from tidewater.functions.requests import basic_authorization, bearer, endpoint_url, override, payload, status_kind
from tidewater.functions.text import join_words, prompt_status, strip, until_blank
from tidewater.sources.endpoint import expiry


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


STRINGS = ["", "a", "  a b \n", " x ", "\x1cx\x1f", "​x​", "﻿x", "\x85x\t", " \n ", "\x0bx\x0c"]


def test_strip_is_pythons(spark):
    assert values(spark, strip(F.col("s")), [(s,) for s in STRINGS], "s string") == [s.strip() for s in STRINGS]


def test_join_words(spark):
    rows = [(["a", "b"],), ([" "],), ([],), (["", "x "],)]
    assert values(spark, join_words(F.col("w")), rows, "w array<string>") == [" ".join(r[0]).strip() for r in rows]


def typed(text):
    lines = []
    for line in text.split("\n"):
        if not line.strip():
            if lines:
                break
            continue
        lines.append(line)
    return "\n".join(lines).strip()


def test_until_blank(spark):
    texts = ["", "\n\n", "a", "\n \na\nb\n\nc", "a\n\t\nb", "  a \n b ", "a\n", "\n\n\na"]
    assert values(spark, until_blank(F.col("s")), [(s,) for s in texts], "s string") == [typed(s) for s in texts]


def test_prompt_status(spark):
    assert values(spark, prompt_status(F.col("s")), [("",), (None,), ("x",)], "s string") == ["invalid_usage", "invalid_usage", "ok"]


def test_status_kind(spark):
    wanted = {200: "ok", 204: "ok", 302: "unhandled", 100: "unhandled", 400: "permanent", 401: "permanent", 429: "transient", 500: "transient", 501: "transient", 599: "transient"}
    assert values(spark, status_kind(F.col("s")), [(s,) for s in wanted], "s int") == [*wanted.values()]


def test_endpoint_url(spark):
    rows = [("https://a/v1",), ("https://a/v1///",), ("/",)]
    assert values(spark, endpoint_url(F.col("u")), rows, "u string") == [u.rstrip("/") + "/chat/completions" for (u,) in rows]


def test_payload_round_trip(spark):
    prompts = ["Hi", 'q"\\/ \x01é😀\n', None]
    made = values(spark, payload(F.col("p"), F.lit("m")), [(p,) for p in prompts], "p string")
    assert made[2] is None
    for body, prompt in zip(made, prompts[:2]):
        assert json.loads(body) == {"model": "m", "messages": [{"role": "user", "content": prompt}]}


def test_basic_authorization(spark):
    rows = [("", "id", "s" * 200), ("Basic ready", "id", "x"), (None, "", "secret")]
    got = values(spark, basic_authorization(F.col("b"), F.col("i"), F.col("s")), rows, "b string, i string, s string")
    pair = lambda r: "Basic " + base64.b64encode(f"{r[1]}:{r[2]}".encode()).decode()
    assert got == [pair(rows[0]), "Basic ready", pair(rows[2])]


def test_override_and_bearer(spark):
    rows = [(None,), ("",), ("x",)]
    assert values(spark, override(F.col("v"), F.lit("base")), rows, "v string") == ["base", "base", "x"]
    assert values(spark, override(F.col("v"), F.lit("base"), keep_empty=True), rows, "v string") == ["base", "", "x"]
    assert values(spark, bearer(F.lit("t"), F.col("v"), F.lit(False)), rows, "v string") == [None, None, "Bearer x"]
    assert values(spark, bearer(F.lit("t"), F.col("v"), F.lit(True)), rows, "v string") == ["Bearer t"] * 3


@pytest.mark.parametrize(
    "body, text, error",
    [
        ('{"choices":[{"message":{"content":"hi"}}]}', "hi", None),
        ('{"choices":[{"message":{"content":""}}]}', "", None),
        ('{"choices":[{"message":{"content":7}}]}', "7", None),
        ('{"choices":[{"message":{"content":null}}]}', None, "empty_content"),
        ('{"choices":[{"message":{}}]}', None, "response_shape"),
        ('{"choices":[]}', None, "response_shape"),
        ('{"unexpected":"shape"}', None, "response_shape"),
        ("[]", None, "response_shape"),
        ("oops", None, "malformed_json"),
        (None, None, "malformed_json"),
    ],
)
def test_reply(spark, body, text, error):
    assert tuple(values(spark, reply(F.col("b")), [(body,)], "b string")[0]) == (text, error)


BODIES = [
    {"expires_at": 1_700_000_000}, {"expires_at": 1_700_000_000_000}, {"expires_at": 10**12}, {"expires_at": None, "expires_in": 5},
    {"expires_at": "x", "expires_in": 60}, {"expires_in": 1800}, {"expires_in": "y"}, {}, {"expires_at": "1700000001"},
]


@pytest.mark.parametrize("body", BODIES)
def test_expiry_of_columns_and_of_objects(spark, body):
    got = values(spark, expires_at(F.col("b"), F.lit(1000.0)), [(json.dumps(body),)], "b string")[0]
    assert math.isclose(got, expiry(body, 1000.0))


def test_broadcasts_are_bounded_in_bytes(spark):
    from tidewater.plans.joins import broadcast_if_small, measured_bytes

    df = spark.createDataFrame([(1, "é" * 50, [1, 2]), (2, None, None)], "a long, b string, c array<int>")
    assert 180 < measured_bytes(df) < 300 and measured_bytes(df.limit(0)) == 0
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(df)) and not hinted(broadcast_if_small(df, 100))
