"""White space and prompt text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that count as white space at the ends of a prompt (Unicode spaces and the ASCII separators).
SPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same but for the end of a line.
_BLANK = SPACE_CLASS.replace(r"\t-\r", r"\t\x0b-\r")


def strip(text: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def join_words(words: Column) -> Column:
    """An array of words as one prompt: one space between them, stripped."""
    return strip(F.array_join(words, " "))


def until_blank(text: Column) -> Column:
    """The lines from the first that isn't blank up to the next blank one, stripped."""
    begun = F.regexp_replace(text, f"^{SPACE_CLASS}+", "")
    return strip(F.regexp_replace(begun, rf"\n{_BLANK}*\n(?s:.*)", ""))


def prompt_status(prompt: Column) -> Column:
    """``ok``, or ``invalid_usage`` for a null or empty prompt."""
    return F.when(F.coalesce(F.length(prompt), F.lit(0)) == 0, "invalid_usage").otherwise("ok")
