import functools
import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidewater.operators.completion import NetworkError, RequestError, RetriesExhausted, complete, send_prompt
from tidewater.operators.retries import backoff_delay, exit_code, retry_trace
from tidewater.operators.token_cache import refresh_trace
from tidewater.sources.endpoint import HttpTransport, OAuthTokens, expiry, oauth_transport
from tidewater.sources.settings import Settings, load_env_file

GOOD = json.dumps({"choices": [{"message": {"role": "assistant", "content": "Hello"}}]})


class Script:
    """Answers with the given outcomes in turn, for each prompt anew."""

    def __init__(self, outcomes):
        self.outcomes, self.calls, self.last = outcomes, 0, None

    def send(self, body):
        self.calls = self.calls + 1 if body == self.last else 1
        self.last = body
        out = self.outcomes[min(self.calls, len(self.outcomes)) - 1]
        if isinstance(out, Exception):
            raise out
        return out


def one(spark, outcomes, prompt="Hi", **options):
    df = spark.createDataFrame([(1, prompt)], "id long, prompt string")
    return complete(df, functools.partial(Script, outcomes), ["id"], backoff=0.0, **options).head()


@pytest.mark.parametrize(
    "outcomes, retries, want",
    [
        ([(200, GOOD)], 3, ("Hello", 200, None, 1)),
        ([(503, ""), (503, ""), (200, GOOD)], 2, ("Hello", 200, None, 3)),
        ([(503, "")], 2, (None, 503, "retry_exhausted", 3)),
        ([(429, ""), (200, GOOD)], 2, ("Hello", 200, None, 2)),
        ([NetworkError("x"), (200, GOOD)], 2, ("Hello", 200, None, 2)),
        ([(401, "no")], 2, (None, 401, "request", 1)),
        ([RequestError("no token")], 2, (None, None, "request", 1)),
        ([(302, "")], 2, (None, 302, "unhandled", 1)),
        ([(501, "")], 0, (None, 501, "retry_exhausted", 1)),
        ([(200, GOOD)], -1, (None, None, "retry_exhausted", 0)),
        ([(200, "{")], 2, (None, 200, "malformed_json", 1)),
    ],
)
def test_complete(spark, outcomes, retries, want):
    r = one(spark, outcomes, max_retries=retries)
    assert (r["text"], r["status"], r["error_class"], r["attempts"]) == want


@pytest.mark.parametrize(
    "outcomes, want",
    [
        ([(200, GOOD)], None),
        ([(503, "busy")], "no reply after 2 attempts: HTTP 503: busy"),
        ([NetworkError("timeout")], "no reply after 2 attempts: timeout"),
        ([(429, ""), NetworkError("reset")], "no reply after 2 attempts: reset"),
        ([(401, "no: Bearer abc.def")], "HTTP 401: no: Bearer ***"),
        ([(302, "")], "HTTP 302"),
        ([RequestError("no token")], "no token"),
        ([KeyError("x")], "KeyError: 'x'"),
        ([(200, '{"choices":[]}')], 'unexpected response: {"choices":[]}'),
        ([(200, "{")], "unexpected response: {"),
    ],
)
def test_error_messages(spark, outcomes, want):
    assert one(spark, outcomes, max_retries=1)["error_message"] == want


def broken_maker():
    raise OSError("no certificates")


def test_a_maker_or_transport_that_raises_ends_rows_not_jobs(spark):
    r = one(spark, [ZeroDivisionError("odd")])
    assert (r["error_class"], r["attempts"], r["error_message"]) == ("unhandled", 1, "ZeroDivisionError: odd")
    df = spark.createDataFrame([(1, "a"), (2, "")], "id long, prompt string")
    rows = {r["id"]: (r["error_class"], r["error_message"]) for r in complete(df, broken_maker, ["id"]).collect()}
    assert rows == {1: ("unhandled", "OSError: no certificates"), 2: ("invalid_usage", "no prompt")}


def test_keys_may_have_any_name_but_those_of_the_result(spark):
    names = ["usage", "payload", "body", "failure", "detail", "key1"]
    df = spark.createDataFrame([(*range(6), "a")], ", ".join(f"{n} int" for n in names) + ", prompt string")
    r = complete(df, functools.partial(Script, [(200, GOOD)]), names).head()
    assert [r[n] for n in names] == [*range(6)] and r["text"] == "Hello"
    with pytest.raises(ValueError, match="status"):
        complete(df.withColumn("status", F.lit(1)), Script, ["status"])


@pytest.mark.parametrize("prompt", ["", None])
def test_empty_prompts_are_not_sent(spark, prompt):
    r = one(spark, [AssertionError()], prompt)
    assert (r["error_class"], r["attempts"], r["text"]) == ("invalid_usage", 0, None)


def test_one_bad_row_does_not_end_the_job_unless_asked(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "id long, prompt string")
    make = functools.partial(Script, [(200, GOOD)])
    assert {r["id"]: r["error_class"] for r in complete(df, make, ["id"]).collect()} == {1: None, 2: "invalid_usage"}
    with pytest.raises(Exception, match="completion failed"):
        complete(df, make, ["id"], on_error="raise").collect()


def test_send_prompt_raises(spark):
    assert send_prompt(spark, "x", functools.partial(Script, [(200, GOOD)])) == "Hello"
    for outcomes, error in (([(500, "")], RetriesExhausted), ([(404, "")], RequestError)):
        with pytest.raises(error):
            send_prompt(spark, "x", functools.partial(Script, outcomes), max_retries=1, backoff=0.0)
    with pytest.raises(ValueError):
        send_prompt(spark, "", functools.partial(Script, []))


def test_empty_table(spark):
    assert complete(spark.createDataFrame([], "id long, prompt string"), functools.partial(Script, []), ["id"]).count() == 0


def test_retry_trace(spark):
    rows = [([503, 503, 200], 2), ([503, 503, 503], 2), ([429, 200], 3), ([401], 3), ([503], -1), ([302], 0), ([], 3)]
    got = retry_trace(spark.createDataFrame(rows, "statuses array<int>, max_retries int"), backoff=1.0).collect()
    assert [(r["attempts"], r["outcome"], r["last_status"], r["slept"]) for r in got] == [
        (3, "ok", 200, 3.0), (3, "exhausted", 503, 3.0), (2, "ok", 200, 1.0), (1, "permanent", 401, 0.0),
        (0, "exhausted", None, 0.0), (1, "unhandled", 302, 0.0), (0, "exhausted", None, 0.0),
    ]


def test_backoff_and_exit_codes(spark):
    df = spark.createDataFrame([(0, "ok"), (1, "permanent"), (2, "invalid_usage")], "a int, o string")
    assert [tuple(r) for r in df.select(backoff_delay(F.lit(0.5), F.col("a")), exit_code(F.col("o"))).collect()] == [(0.5, 0), (1.0, 1), (2.0, 2)]


def test_refresh_trace(spark):
    times = [0, 300, 1739, 1740, 3479, 3481, 9000]
    df = spark.createDataFrame([(c, float(t), i) for c in "ab" for i, t in enumerate(times)] + [(None, 1.0, 1)], "c string, t double, i long")
    got = refresh_trace(df, "c", "t", "i", 1800.0).where("client = 'a'").orderBy("now").collect()
    assert [r["refreshed"] for r in got] == [True, False, False, True, False, True, True]


def test_short_lived_tokens_are_renewed_at_every_call(spark):
    df = spark.createDataFrame([(1, float(t), t) for t in range(4)], "c long, t double, i long")
    assert all(r["refreshed"] for r in refresh_trace(df, "c", "t", "i", 60.0).collect())


def test_settings(monkeypatch, tmp_path):
    for name in ("LLM_MODEL", "LLM_MAX_RETRIES", "LLM_TIMEOUT", "LLM_API_KEY", "LLM_BASE_URL"):
        monkeypatch.delenv(name, raising=False)
    assert (Settings().model, Settings().max_retries, Settings().timeout) == ("gpt-4o-mini", 3, 30.0)
    monkeypatch.setenv("LLM_MODEL", "")
    monkeypatch.setenv("LLM_MAX_RETRIES", "")
    monkeypatch.setenv("LLM_TIMEOUT", "2.5")
    assert (Settings.from_env().model, Settings().max_retries, Settings().timeout) == ("", 3, 2.5)
    s = Settings(base_url="https://a", api_key="k", model="m")
    assert "api_key" not in repr(s)
    t = s.with_overrides(model="new", base_url="", api_key="")
    assert (t.model, t.base_url, t.api_key, s.model) == ("new", "https://a", "", "m")
    monkeypatch.setenv("SET_BEFORE", "1")
    monkeypatch.setenv("FROM_FILE", "x")
    monkeypatch.delenv("FROM_FILE")
    (tmp_path / ".env").write_text("# note\nSET_BEFORE=2\nexport FROM_FILE='y z'\n\nbroken\n")
    load_env_file(str(tmp_path / ".env"))
    load_env_file(str(tmp_path / "missing"))
    import os

    assert (os.environ["SET_BEFORE"], os.environ["FROM_FILE"]) == ("1", "y z")
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("LLM_MODEL")
    (tmp_path / ".env").write_text("LLM_MODEL=from-file\n")
    assert Settings.from_env().model == "from-file"
    monkeypatch.delenv("LLM_MODEL")


class Tokens:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, url, headers, body, timeout):
        self.calls.append((url, headers, body))
        return self.answers[min(len(self.calls), len(self.answers)) - 1]


OAUTH = Settings(base_url="https://b", oauth_url="https://o", oauth_client_id="client-123", oauth_client_secret="secret-abc", oauth_scope="S")


def test_oauth_tokens():
    clock = [1_000_000.0]
    send = Tokens((200, '{"access_token":"t1","expires_in":1800}'), (200, '{"access_token":"t2","expires_at":1900000000000}'))
    tokens = OAuthTokens(OAUTH, lambda: clock[0], send)
    assert tokens.token() == "t1"
    url, headers, body = send.calls[0]
    assert url == "https://o" and headers["Authorization"].startswith("Basic ") and headers["RqUID"]
    assert body == b"scope=S&grant_type=client_credentials"
    clock[0] += 300
    assert tokens.token() == "t1" and len(send.calls) == 1
    clock[0] += 2000
    assert tokens.token() == "t2" and len(send.calls) == 2
    clock[0] = 1_899_999_939.0
    assert tokens.token() == "t2" and len(send.calls) == 2
    clock[0] = 1_899_999_941.0
    tokens.token()
    assert len(send.calls) == 3


@pytest.mark.parametrize("answer", [(400, "{}"), (429, ""), (200, "[]"), (200, "{}"), (200, "no")])
def test_oauth_failures_are_final(answer):
    with pytest.raises(RequestError):
        OAuthTokens(OAUTH, send=Tokens(answer)).token()


def test_a_token_is_shared_by_the_tasks_of_a_worker():
    assert oauth_transport(OAUTH).tokens is oauth_transport(OAUTH).tokens


@pytest.mark.parametrize(
    "answer, want",
    [
        ({"expires_at": 1_000_000_000_000}, 1e12), ({"expires_at": 1_000_000_000_001.0}, 1_000_000_000.001), ({"expires_at": "12"}, 12.0),
        ({"expires_at": "soon", "expires_in": 5}, 105.0), ({"expires_at": None, "expires_in": "7"}, 107.0), ({}, 1900.0),
        ({"expires_in": []}, 1900.0), ({"expires_at": float("nan"), "expires_in": 1}, 101.0),
    ],
)
def test_expiry(answer, want):
    assert expiry(answer, 100.0) == want


def test_oauth_needs_a_secret_and_a_base_url():
    with pytest.raises(RequestError, match="client_secret"):
        OAuthTokens(Settings(oauth_client_secret="", oauth_basic_auth="")).token()
    assert isinstance(oauth_transport(OAUTH).tokens, OAuthTokens)
    with pytest.raises(ValueError):
        oauth_transport(Settings(base_url="https://api.openai.com/v1"))


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        self.seen.append((self.path, self.headers.get("Authorization"), body))
        status = {"deny": 401, "moved": 302}.get(prompt, 200)
        if prompt == "flaky" and sum(b["messages"][0]["content"] == "flaky" for _, _, b in self.seen) == 1:
            status = 503
        self.send_response(status)
        if status == 302:
            self.send_header("Location", "http://127.0.0.1:1/")
        self.end_headers()
        self.wfile.write(GOOD.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/v1/"
    httpd.shutdown()


def test_live_requests(spark, server):
    settings = Settings(base_url=server, api_key="test-key", timeout=5.0)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["hi", "deny", "moved", "flaky"])], "id long, prompt string")
    rows = complete(df, functools.partial(HttpTransport, settings), ["id"], backoff=0.0).collect()
    rows.sort(key=lambda r: r["id"])  # a sort in Spark would send twice, to sample the range
    assert [(r["text"], r["status"], r["error_class"], r["attempts"]) for r in rows] == [
        ("Hello", 200, None, 1), (None, 401, "request", 1), (None, 302, "unhandled", 1), ("Hello", 200, None, 2),
    ]
    assert {(path, auth) for path, auth, _ in Handler.seen} == {("/v1/chat/completions", "Bearer test-key")}


def test_unreachable_is_tried_again(spark):
    settings = Settings(base_url="http://127.0.0.1:9", timeout=1.0)
    df = spark.createDataFrame([(1, "x")], "id long, prompt string")
    r = complete(df, functools.partial(HttpTransport, settings), ["id"], max_retries=1, backoff=0.0).head()
    assert (r["error_class"], r["attempts"], r["status"]) == ("retry_exhausted", 2, None)


def test_command_line(spark, server, capsys, monkeypatch):
    from tidewater import cli

    assert cli.main(["hi", "there", "--base-url", server]) == 0
    assert capsys.readouterr().out == "Hello\n"
    assert Handler.seen[-1][2]["messages"][0]["content"] == "hi there"
    assert cli.main(["deny", "--base-url", server]) == 1
    assert "error:" in capsys.readouterr().err
    assert cli.main([" ", "--base-url", server]) == 2
    assert cli.main(["hi", "--provider", "oauth", "--base-url", "https://api.openai.com/v1"]) == 1
    assert "base_url" in capsys.readouterr().err
    monkeypatch.setattr("sys.stdin", io.StringIO(" piped\n\nin \n"))
    assert cli.main(["--base-url", server]) == 0
    assert Handler.seen[-1][2]["messages"][0]["content"] == "piped\n\nin"
    typed = io.StringIO("\n typed\n\nnot\n")
    typed.isatty = lambda: True
    monkeypatch.setattr("sys.stdin", typed)
    assert cli.main(["--base-url", server]) == 0
    assert Handler.seen[-1][2]["messages"][0]["content"] == "typed"
    assert cli.typed_text(["\n", "a\n", "b\n", "\n", "c\n"]).strip() == "a\nb"


def test_stream(spark, tmp_path):
    from tidewater.streaming.completion import complete_stream

    spark.createDataFrame([(1, "a"), (2, "")], "id long, prompt string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, prompt string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        complete_stream(stream, functools.partial(Script, [(200, GOOD)]), ["id"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [(r["id"], r["text"], r["error_class"]) for r in rows] == [(1, "Hello", None), (2, None, "invalid_usage")]


def test_prompt_sources(spark, tmp_path):
    from tidewater.sources.prompts import from_files, from_sessions, from_words, split_usable

    assert [r["prompt"] for r in from_words(spark, [["a", "b "], [" "]]).orderBy("prompt_id").collect()] == ["a b", ""]
    (tmp_path / "p.txt").write_text("\n two\nlines \n")
    assert from_files(spark, str(tmp_path)).head()["prompt"] == "two\nlines"
    df = from_sessions(spark.createDataFrame([("x\n\ny",), ("\n",)], "text string"))
    good, bad = split_usable(df)
    assert [r["prompt"] for r in good.collect()] == ["x"] and bad.count() == 1
