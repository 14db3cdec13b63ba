"""Text to tokens, and tests on single words of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# fixed value: a term is a run of letters and digits
_TERM_CHAR = r"[\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Lower-case terms of a text: its runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def query_words(text: str) -> list[str]:
    """Terms of a query text (on the driver)."""
    return re.findall(r"[^\W_]+", text.lower())


def _word_pattern(word: str) -> str:
    # the literal comes first: a position that does not start with it fails at once
    quoted = re.escape(word)
    return f"{quoted}(?<!{_TERM_CHAR}{quoted})(?!{_TERM_CHAR})"


def has_word(lowered: Column, word: str) -> Column:
    """The lower-case text has the term; the same as looking it up among its tokens, without making them."""
    return lowered.rlike(_word_pattern(word))


def word_count(lowered: Column, word: str) -> Column:
    """How often the lower-case text has the term."""
    return F.regexp_count(lowered, F.lit(_word_pattern(word)))
