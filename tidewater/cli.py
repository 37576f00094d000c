"""``python -m tidewater``: complete one prompt, or a table of prompts.

Exit codes: 0 for replies, 1 for a failed request, 2 for wrong usage.
"""

from __future__ import annotations

import argparse
import functools
import logging
import sys
from collections.abc import Iterable
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions.text import strip, until_blank
from tidewater.operators.completion import complete
from tidewater.operators.retries import exit_code
from tidewater.sources.endpoint import oauth_transport, static_transport
from tidewater.sources.prompts import from_words
from tidewater.sources.settings import Settings

_TRANSPORTS = {"static": static_transport, "oauth": oauth_transport}
#: Options that take the place of a setting of the same name.
_SETTINGS = ("base_url", "api_key", "model")


def options(argv: list[str] | None = None) -> dict[str, Any]:
    """The command line as a mapping."""
    parser = argparse.ArgumentParser(prog="tidewater", description="Complete prompts with an OpenAI-compatible API.")
    for name in _SETTINGS:
        parser.add_argument("--" + name.replace("_", "-"), help="instead of the environment's")
    parser.add_argument("--provider", choices=tuple(_TRANSPORTS), default="static", help="where tokens come from")
    parser.add_argument("-v", "--verbose", action="store_true", help="log every attempt")
    parser.add_argument("prompt", nargs="*", help="words of the prompt; without any, standard input is read")
    return vars(parser.parse_args(argv))


def typed_text(lines: Iterable[str]) -> str:
    """Lines up to the first blank one after others."""
    out: list[str] = []
    for line in lines:
        if not line.strip() and any(x.strip() for x in out):
            break
        out.append(line)
    return "".join(out)


def prompt_table(spark: SparkSession, words: list[str], source: TextIO) -> DataFrame:
    """The one prompt: words, or what is typed before a blank line, or all that is piped in."""
    if words:
        return from_words(spark, [words])
    text, cut = (typed_text(source), until_blank) if source.isatty() else (source.read(), strip)
    return spark.createDataFrame([(0, text)], "prompt_id long, text string").select("prompt_id", cut(F.col("text")).alias("prompt"))


def main(argv: list[str] | None = None) -> int:
    given = options(argv)
    logging.basicConfig()
    logging.getLogger("tidewater").setLevel("DEBUG" if given["verbose"] else "WARNING")
    settings = Settings.from_env().with_overrides(**{name: given[name] for name in _SETTINGS})
    spark = SparkSession.builder.master("local[1]").appName("tidewater").config("spark.ui.enabled", "false").getOrCreate()
    replies = complete(
        prompt_table(spark, given["prompt"], sys.stdin),
        functools.partial(_TRANSPORTS[given["provider"]], settings),
        ["prompt_id"],
        model=settings.model, max_retries=settings.max_retries, backoff=settings.retry_backoff,
    )
    row = replies.withColumn("exit_code", exit_code(F.coalesce("error_class", F.lit("ok")))).head()
    failed = row["exit_code"] != 0
    print(f"error: {row['error_class']}: {row['error_message']}" if failed else row["text"], file=sys.stderr if failed else sys.stdout)
    return row["exit_code"]
