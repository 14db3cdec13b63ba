"""The language model against plain dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from docsieve.llm import ngram_lm, queries
from docsieve.llm.ngram_lm import discounts, trained, with_score

FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + ["<end>"]


class Plain:
    def __init__(self, texts):
        self.single, self.pairs = Counter(), Counter()
        for text in texts:
            words = tokens(text)
            self.single.update(words)
            self.pairs.update(zip(["<begin>", *words], words))
        self.follow = defaultdict(list)
        self.ends = Counter(w for _, w in self.pairs)
        for (h, _), c in self.pairs.items():
            self.follow[h].append(c)
        self.d2, self.d1 = self.cuts(self.pairs.values()), self.cuts(self.ends.values())
        self.even = sum(self.d1[min(c, 3) - 1] for c in self.ends.values()) / max(len(self.pairs), 1)
        self.left = {h: (sum(self.d2[min(n, 3) - 1] for n in counts), sum(counts)) for h, counts in self.follow.items()}

    @staticmethod
    def cuts(counts):
        of = Counter(counts)
        return discounts(of[1], of[2], of[3], of[4])

    def word(self, w):
        size, types = len(self.single) + 1, len(self.pairs)
        if not types:
            return 1 / size
        c = self.ends[w]
        return (c - (self.d1[min(c, 3) - 1] if c else 0)) / types + self.even / size

    def pair(self, h, w):
        if h not in self.follow:
            return self.word(w)
        c, (left, total) = self.pairs[h, w], self.left[h]
        return (c - (self.d2[min(c, 3) - 1] if c else 0) + left * self.word(w)) / total

    def row(self, text):
        words, n, v = tokens(text), sum(self.single.values()), len(self.single)
        base = sum(math.log10((self.single[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        score = sum(math.log10(self.pair(h, w)) for h, w in zip(["<begin>", *words], words))
        return len(words), sum(self.single[w] > 0 for w in words), base, score


def made(n, seed=4):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["The", "the", "É", "é", "x.", "\x1c"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return ["".join(w + draw.choice([" ", "\n", "  ", "\t"]) for w in draw.choices(vocabulary, weights, k=draw.randint(0, 40))) for _ in range(n)]


def same(row, want):
    assert (row["n_tokens"], row["n_known"]) == want[:2]
    assert math.isclose(row["base_score"], want[2], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(row["score"], want[3], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("shard,block", [(4_000_000, 1_500_000), (150, 60), (700, 40)])
def test_against_plain(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ngram_lm, "BLOCK", block)
    learn = [*made(60), None, "", "  ", "solo", *["same text again"] * 9]
    other = [*made(20, 8), None, "", "unknown w1 unheard the", "the " * 500]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(learn)], "doc_id long, text string, lm double")
    model = trained(docs, shard_tokens=shard)
    assert model.shards == 1 if shard > 1000 else model.shards > 1
    plain = Plain(learn)
    assert model.tokens == sum(plain.single.values()) and model.pair_types == len(plain.pairs)
    asked = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(learn + other)], "doc_id long, text string, lm double")
    for row in with_score(asked, model).collect():
        same(row["lm"], plain.row(row["text"]))
    # the model's probabilities equal the plain ones, which add up to 1 over known words and one unknown one
    for before in ("w1", "the", "<begin>", "never"):
        assert math.isclose(sum(plain.pair(before, w) for w in [*plain.single, "unknown"]), 1, rel_tol=1e-9)


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = trained(docs.where("false"))
    rows = {r["doc_id"]: r["lm"] for r in with_score(docs, model).collect()}
    assert tuple(rows[1]) == (3, 0, 0.0, 0.0) and tuple(rows[2]) == (1, 0, 0.0, 0.0)
    assert with_score(docs.where("false"), model).count() == 0


def test_discounts():
    assert discounts(0, 1, 1, 1) == (0.5, 1.0, 1.5) and discounts(1, 1, 50, 1) == (0.5, 1.0, 1.5)
    assert np.allclose(discounts(100, 40, 20, 12), (1 - 2 * (100 / 180) * 0.4, 2 - 3 * (100 / 180) * 0.5, 3 - 4 * (100 / 180) * 0.6))


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
def test_query_against_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    plain = Plain([t for i, t in docs if not held(i)])
    out = queries.QUERIES["op13_lm_scoring"](spark, FOLDER)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(docs)
    better = []
    for i, text in docs:
        assert rows[i]["held_out"] == held(i) and rows[i]["train_tokens"] == sum(plain.single.values())
        same(rows[i], plain.row(text))
        if held(i):
            better.append(rows[i]["score"] > rows[i]["base_score"])
    assert sum(better) > 0.9 * len(better)
