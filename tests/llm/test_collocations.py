"""Collocations against counting every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from docsieve.llm import collocations as module
from docsieve.llm.collocations import collocations, compact_paths, phrase_counts

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    """Per language the count of every phrase."""
    out = {}
    for lang, text in rows:
        count = out.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count[tuple(words[i : i + m])] += 1
    return out


def brute(rows, longest, least, covered, top):
    out = []
    for lang, count in counted(rows, longest).items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        candidates = {p: c for p, c in count.items() if len(p) >= 2 and c >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * c >= covered * a for q, c in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]], n, score))
        kept.sort()
        out += [(lang, i + 1, row[2].decode(), *row[3:]) for i, row in enumerate(kept[:top])]
    return sorted(out)


def texts(n, seed):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "the", "É", "zz", "x-y", "of"]
    marks = [" ", " ", "  ", "\t", ". ", ", ", "\n", "! "]
    made = ["".join(draw.choice(vocabulary) + draw.choice(marks) for _ in range(draw.randint(0, 25))) for _ in range(n)]
    passage = " one two three four five six seven eight, nine"
    return [(draw.choice(["en", "de", None]), draw.choice(["", "a ", "the of "]) + t + (passage if i % 3 == 0 else "")) for i, t in enumerate(made)]


EDGES = [("en", None), ("en", ""), (None, "..."), ("fr", "solo"), ("fr", "a b c " * 30), ("fr", "a\x00b a\x00b " * 9), ("es", "x y. " * 12), ("es", "X\ty\nx  y")]


@pytest.mark.parametrize("longest,block", [(3, 1 << 20), (3, 40), (2, 1 << 20), (4, 40), (5, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, longest, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rows = texts(120, longest) + EDGES
    docs = spark.createDataFrame([(t, lang, 7) for lang, t in rows], "text string, lang string, n int")
    got = sorted(tuple(r) for r in collocations(docs, max_words=longest, min_count=5, covered=50, top=40).collect())
    assert got == brute(rows, longest, 5, 50, 40)


def test_shorter_counts_come_from_the_edges(spark):
    rows = texts(60, 9) + EDGES
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    got = {(r["lang"], r["gram"]): r["n"] for r in phrase_counts(docs, 3, 1).collect()}
    want = {(lang, " ".join(p)): c for lang, count in counted(rows, 3).items() for p, c in count.items()}
    totals = {(lang, ""): sum(c for p, c in count.items() if len(p) == 1) for lang, count in counted(rows, 3).items() if count}
    assert got == want | totals


def test_paths(spark):
    docs = spark.createDataFrame([("en", "p q r s t u v"), ("en", "p q r s t u w"), ("en", "o p q r")] * 3, "lang string, text string")
    grams = phrase_counts(docs, 3, 1)
    m = "size(split(gram, ' '))"
    paths = {(r["path"], r["n"], r["words"]) for r in compact_paths(grams.where(f"{m} = 3"), grams.where(f"{m} = 2 and gram <> ''")).collect()}
    assert paths == {("o p q", 3, 3), ("p q r", 9, 3), ("q r s t u", 6, 5), ("t u v", 3, 3), ("t u w", 3, 3)}


def test_exact_beyond_64_bits(spark):
    # counts of ten thousand give products above 2^63 once multiplied by a million
    rows = [("en", "aa bb. " * 4000)] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert [tuple(r) for r in collocations(docs).collect()] == [("en", 1, "aa bb", 12000, 12000, 12000, 24000, 1000000)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations(docs).count() == 0
