"""URL rules fetched by their rarest literal token (columns, joins and aggregates only).

A rule is compiled to a regular expression and a list of literal tokens every matching URL must hold. The rule is filed under the one of
its tokens that the fewest URLs hold. A URL's tokens fetch the rules filed under them, and only those run their expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.common import LOWER, UPPER

#: Rules without a usable token are filed under the empty token, which every URL holds.
EVERY = ""
#: Keys the rows of the empty token are dealt over, so that a join by token has no key that holds every URL.
SALTS = 64
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``kind`` "prefix": ``text`` is host/path-prefix, fits the host and its subdomains, longest wins, and it outranks patterns.

    ``kind`` "pattern": ``||`` anchors at a host label, ``|`` at either end, ``^`` is a separator or the end, ``*`` is any text; the
    rest is literal, without regard to the case of A-Z. Among fitting patterns an allowing one wins over blocking ones.
    """

    text: str
    action: str
    kind: str = "prefix"


#: Rules of the method itself, for URLs no prefix rule fits. Names of junk hosts.
PATTERNS = tuple(Rule(f"||{name}.", "block", "pattern") for name in ("casino-win", "cheap-pills", "free-bets", "spam-farm", "ads-track"))


def _literal_tokens(literal: str, open_left: bool, open_right: bool) -> list[str]:
    """Whole tokens of a literal; a token at an open end may go on in the URL and is left out."""
    folded = literal.translate(str.maketrans(UPPER, LOWER))
    return [m[0] for m in _TOKEN.finditer(folded) if not (open_left and m.start() == 0) and not (open_right and m.end() == len(folded))]


def compiled(rule: Rule) -> tuple[str, list[str]]:
    """(Java regular expression over host + path, tokens)."""
    if rule.kind == "prefix":
        host, _, path = rule.text.partition("/")
        host = host.translate(str.maketrans(UPPER, LOWER))
        tokens = _literal_tokens(host, False, False) + _literal_tokens("/" + path, False, True)
        return rf"(?s)^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tokens
    body, start, end = rule.text, "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], r"\z"
    parts = re.split(r"([*^])", body)
    regex, tokens = "", []
    for i, part in enumerate(parts):
        if part == "*":
            # behind a host anchor the wildcard stays inside the host
            regex += "[^/]*" if start.startswith("^(") and "/" not in "".join(parts[:i]) else ".*"
        elif part == "^":
            regex += r"(?:[^a-zA-Z0-9_.%-]|\z)"
        elif part:
            regex += re.escape(part)
            left = parts[i - 1] == "*" if i else not start
            right = (parts[i + 1] == "*") if i + 1 < len(parts) else not end
            tokens += _literal_tokens(part, left, right)
    return f"(?is){start}{regex}{end}", tokens


_RULE_SCHEMA = "array<struct<rank: int, rule: string, action: string, kind: string, regex: string, tokens: array<string>>>"


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rank, rule, action, kind, regex, tokens), one row per different rule.

    The rules are one JSON text that Spark parses, so the plan has the same size for three rules and for a list of many thousands.
    """
    rows = []
    for rank, rule in enumerate(dict.fromkeys(rules)):
        regex, tokens = compiled(rule)
        rows.append({"rank": rank, "rule": rule.text, "action": rule.action, "kind": rule.kind, "regex": regex, "tokens": sorted(set(tokens))})
    text = spark.range(1).select(F.lit(json.dumps(rows)).alias("rules"))
    return text.select(F.inline(F.from_json("rules", _RULE_SCHEMA)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there to ``?``, ``#`` or the end.

    Both are empty without ``://`` and for a null URL.
    """
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.expr("substring(coalesce(__url, ''), instr(coalesce(__url, ''), '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): one row per page row.

    ``rule`` is the longest fitting prefix rule (ties: the longer host, then the text; equal rules with both actions block) and sets the
    verdict; without one, ``pattern`` is the deciding pattern rule, else the verdict is ``default``. Null, empty and malformed URLs
    have an empty host and path and the default verdict. Repeated rows stay repeated. Duplicate rules count once.
    """
    spark = pages.sparkSession
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    urls = named.select("page_id", host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    # equal rows are judged once and repeated at the end
    rows = urls.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    found = F.array_distinct(F.split(F.translate(target, UPPER, LOWER), "[^a-z0-9]+"))
    tokens = rows.withColumn("token", F.explode(F.array_union(found, F.array(F.lit(EVERY)))))

    table = rule_table(spark, rules)
    wanted = table.select("rank", F.explode("tokens").alias("token"))
    # how many URLs hold each token that some rule could be filed under: a count over all URLs
    held = tokens.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("urls"))
    filed = (
        wanted.join(held, "token", "left")
        .groupBy("rank")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("best"))
        .select("rank", F.col("best.token").alias("token"))
    )
    index = table.drop("tokens").join(filed, "rank", "left").withColumn("token", F.coalesce("token", F.lit(EVERY)))

    # the empty token keeps a row for every URL, so it is dealt over SALTS keys; a rule's expression runs only in rows its token fetched
    salts = F.when(F.col("token") == EVERY, F.lit(SALTS - 1)).otherwise(0)
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), salts)))
    tokens = tokens.withColumn("salt", F.when(F.col("token") == EVERY, F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    fetched = tokens.join(index, ["token", "salt"], "left").where(F.col("rank").isNotNull() | (F.col("token") == EVERY))
    prefix = F.col("kind") == "prefix"
    order = F.struct(
        prefix.alias("prefix"),
        F.when(prefix, F.length("rule")).otherwise((F.col("action") == "allow").cast("int")).alias("length"),
        F.when(prefix, F.instr("rule", "/")).otherwise(0).alias("host_length"),
        "rule",
        (F.col("action") == "block").alias("blocks"),
        "action",
    )
    best = fetched.groupBy("page_id", "host", "path").agg(
        F.max("copies").alias("copies"), F.max(F.when(F.expr("regexp_like(concat(host, path), regex)"), order)).alias("won")
    )
    by_prefix = F.col("won.prefix")
    return best.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        "page_id",
        "host",
        "path",
        F.when(by_prefix, F.col("won.rule")).alias("rule"),
        F.coalesce("won.action", F.lit(default)).alias("verdict"),
        F.when(~by_prefix, F.col("won.rule")).alias("pattern"),
    )
