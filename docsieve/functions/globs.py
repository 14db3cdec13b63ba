"""Globs and regular-expression literals as Spark ``rlike`` patterns.

Two dialects exist on purpose. The *simple* one (host names, fields) lets ``*`` cross anything and ignores case. The *path*
one (bucket names) is case-sensitive, ``*`` stops at ``/`` and ``**`` crosses it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

_WILDCARD = re.compile(r"[?*\[{].*$", re.S)
_REGEX_FLAGS = "ixsmud"


def simple_glob_regex(glob: str) -> str:
    """Anchored regular expression of a simple glob (matched without regard to case)."""
    # fixed values: the four rewrites of the simple dialect
    rewrites = {"*": ".*", "?": ".", ".": "\\.", "\\": "\\\\"}
    return "^" + "".join(rewrites.get(char, char) for char in glob) + "$"


def pattern_regex(text: str) -> str:
    """Java regular expression, with inline flags, of ``/regex/flags`` or of a simple glob."""
    if text.startswith("/"):
        body, _, flags = text[1:].partition("/")
        kept = "".join(flag for flag in _REGEX_FLAGS if flag in flags)
        return (f"(?{kept})" if kept else "") + body
    return "(?i)" + simple_glob_regex(text)


#: Tokens of a path glob: crossing star, star, mark, set, choice, quoted character, character.
_TOKEN = r"(?s)\*\*|\*|\?|\[[^\]]*\]|\{[^}]*\}|\\.|."


def path_glob_regex(glob: str) -> str:
    """Anchored Java regular expression of a path glob."""
    tokens = re.findall(_TOKEN, glob)
    return "^" + "".join(_path_token(token) for token in tokens) + "$"


def _path_token(token: str) -> str:
    if token == "**":
        return ".*"
    if token == "*":
        return "[^/]*"
    if token == "?":
        return "[^/]"
    if len(token) > 2 and token[0] == "[":  # an empty set is its own text
        return "[" + ("^" + token[2:-1] if token[1] == "!" else token[1:-1]) + "]"
    if len(token) > 1 and token[0] == "{":
        inner = (path_glob_regex(choice)[1:-1] for choice in token[1:-1].split(","))
        return "(?:" + "|".join(inner) + ")"
    if len(token) == 2 and token[0] == "\\":
        return re.escape(token[1])
    return re.escape(token)


def path_glob_regex_column(glob: Column) -> Column:
    """``path_glob_regex`` for a column of patterns: the same tokens, the same rule for each."""

    def quoted(char: Column) -> Column:
        return F.when(char.rlike(r"^[A-Za-z0-9_/]$"), char).otherwise(F.concat(F.lit("\\"), char))

    def plain(token: Column) -> Column:
        inner = F.substr(token, F.lit(2), F.length(token) - 2)
        negated = F.concat(F.lit("^"), F.substr(inner, F.lit(2)))
        return (
            F.when(token == "**", ".*")
            .when(token == "*", "[^/]*")
            .when(token == "?", "[^/]")
            .when(token.rlike(r"(?s)^\[.+\]$"), F.concat(F.lit("["), F.when(inner.startswith("!"), negated).otherwise(inner), F.lit("]")))
            .when(token.rlike(r"(?s)^\\.$"), quoted(F.substr(token, F.lit(2))))
            .otherwise(quoted(token))
        )

    def joined(text: Column, rule) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), 0), rule), "")

    def whole(token: Column) -> Column:
        choices = F.split(F.substr(token, F.lit(2), F.length(token) - 2), ",")
        choice = F.concat(F.lit("(?:"), F.array_join(F.transform(choices, lambda c: joined(c, plain)), "|"), F.lit(")"))
        return F.when(token.rlike(r"(?s)^\{.*\}$"), choice).otherwise(plain(token))

    return F.concat(F.lit("^"), joined(glob, whole), F.lit("$"))


def literal_prefix(glob: str) -> str:
    """The part of a glob before its first wildcard."""
    return _WILDCARD.sub("", glob)


def is_literal(glob: str) -> bool:
    return literal_prefix(glob) == glob


def prefix_upper_bound(prefix: str) -> str:
    """Smallest string above every string that starts with ``prefix``."""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def matches_path(path: Column, globs: list[str]) -> Column:
    """True when ``path`` matches any glob.

    Literal globs become one ``IN``; the others carry a prefix range next to the regular expression so that the range can be
    pushed to the scan (Catalyst does not derive one from ``rlike``).
    """
    literals = sorted({glob for glob in globs if is_literal(glob)})
    terms = [path.isin(literals)] if literals else []
    for glob in globs:
        if is_literal(glob):
            continue
        prefix = literal_prefix(glob)
        exact = path.rlike(path_glob_regex(glob))
        if prefix:
            exact = (path >= prefix) & (path < prefix_upper_bound(prefix)) & exact
        terms.append(exact)
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def rule_list(value: Column, rules: list[str], names: Column | None = None) -> Column:
    """Include/exclude rules: ``+pattern`` (or no sign) accepts matches, ``-pattern`` accepts non-matches, any rule suffices.

    ``$name`` (or ``-$name``) tests whether the array ``names`` holds the name.
    """
    terms = []
    for rule in rules:
        body = rule[1:] if rule[:1] in ("+", "-") else rule
        if body.startswith("$"):
            if names is None:
                raise ValueError(f"{rule} needs a set of names")
            hit = F.coalesce(F.array_contains(names, body[1:]), F.lit(False))
        else:
            hit = value.rlike(pattern_regex(body))
        terms.append(~hit if rule.startswith("-") else hit)
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(True)


def rule_lists(value: Column, lists: list[list[str]], names: Column | None = None) -> Column:
    """Several rule lists, each of which has to accept."""
    return reduce(lambda a, b: a & b, [rule_list(value, rules, names) for rules in lists], F.lit(True))
