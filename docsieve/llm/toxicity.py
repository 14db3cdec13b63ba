"""Toxicity by weak supervision: many noisy voters, a generative model of their accuracies and correlations, a linear classifier.

Voters are a small fixed lexicon, words and word beginnings mined from labelled documents, and patterns of writing. The label model is a
latent class model: each voter fires with one rate in toxic and another in clean documents. It is fitted to the votes on all documents and
gives each document a posterior. The classifier is fitted to posteriors, not to labels.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import WORD_BYTES, held_out, saved, slices, worker_cache
from docsieve.llm.near_dup import shingle_hashes

#: Words of insult.
LEXICON = ("bastard", "clown", "disgusting", "dumb", "filth", "fool", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
#: Bounds: labelled documents of each class to mine voters from, documents to fit the classifier on, voters (bits of a long).
MINED = 2_000
FITTED = 8_000
VOTERS = 60
#: Words of which a worker remembers the votes.
WORDS = 150_000
BEGINNINGS = (4, 5, 6)
ROUNDS = 8
#: A mined voter fires in this share of toxic documents at least, and at least e^ODDS times as often as in clean ones.
SHARE = 0.01
ODDS = 3.0
PATTERNS = ("!shouting", "!exclaiming")
#: Letters a text of capitals needs to count as shouting.
SHOUTED = 20
_EXCLAIM = re.compile("!!")


@dataclass(frozen=True)
class Model:
    """Voters (a word, a beginning with ``*``, or a pattern), their rates by class, and the classifier's weights (last: bias)."""

    voters: tuple[str, ...]
    weights: tuple[float, ...]
    toxic_rates: tuple[float, ...]
    clean_rates: tuple[float, ...]
    correlations: tuple[tuple[float, ...], ...]
    prior: float


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def beginnings(word: bytes) -> list[str]:
    """The word itself, and its beginnings of several lengths if it is longer, as names of voters."""
    text = word.decode("utf-8", "replace")
    return [text, *(text[:n] + "*" for n in BEGINNINGS if len(text) >= n)]


def writing(text: str, n_words: int) -> list[bool]:
    """Votes of the patterns: no small letters, and ``SHOUTED`` letters anywhere in the text; doubled exclamation marks behind many words."""
    letters = sum(1 for _ in islice(filter(str.isalpha, text), SHOUTED)) if text.isupper() else 0
    return [letters >= SHOUTED, n_words >= 5 and len(_EXCLAIM.findall(text)) * 10 >= n_words]


def _features():
    """UDF: the different features of a text, for mining, and its family: the least hash of its shingles, which copies mostly share."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            texts = batch.to_pylist()
            found = pa.array([sorted({f for w in set(words_of(t or "")) for f in beginnings(w)}) for t in texts], pa.list_(pa.string()))
            families = pa.array([int(hashes[0]) if len(hashes) else None for hashes in (shingle_hashes(t, 4) for t in texts)], pa.int64())
            yield pa.StructArray.from_arrays([found, families], ["found", "family"])

    return F.arrow_udf(run, "found array<string>, family long").asNondeterministic()


def _votes(voters: tuple[str, ...], key: str):
    """UDF: votes as bits, words that some voter names, words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = {name: 1 << k for k, name in enumerate(voters)}
        patterns = [bits.get(p, 0) for p in PATTERNS]
        known: dict[bytes, int] = worker_cache(key, dict)
        for batch in slices(batches):
            masks, hits, sizes = [], [], []
            for text in batch.to_pylist():
                words = words_of(text or "")
                votes = list(map(known.get, words))
                if None in votes:
                    for i, vote in enumerate(votes):
                        if vote is None:
                            vote = 0
                            for name in beginnings(words[i]):
                                vote |= bits.get(name, 0)
                            votes[i] = vote
                            if len(known) < WORDS:
                                known[words[i]] = vote
                mask = 0
                for vote in set(votes):
                    mask |= vote
                for bit, fired in zip(patterns, writing(text or "", len(words))):
                    mask |= bit if fired else 0
                masks.append(mask)
                hits.append(len(votes) - votes.count(0))
                sizes.append(len(words))
            yield pa.StructArray.from_arrays([pa.array(masks, pa.int64()), pa.array(hits, pa.int64()), pa.array(sizes, pa.int64())], ["mask", "hits", "words"])

    return F.arrow_udf(run, "mask long, hits long, words long").asNondeterministic()


def _bits(masks: np.ndarray, n: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(n)) & 1).astype(np.float64)


def _evidence(masks: np.ndarray, n: int) -> np.ndarray:
    """Votes, and a last column for texts without a vote of a word. A single voter that is silent says nothing: most voters belong to
    one language or topic, so their silences are not independent."""
    votes = _bits(masks, n)
    return np.column_stack([votes, (masks & ((1 << (n - len(PATTERNS))) - 1)) == 0])


def _posterior(evidence: np.ndarray, prior: float, toxic: np.ndarray, clean: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Probability of the toxic class. A vote's evidence counts by its trust, which correlated voters share."""
    logit = np.log(prior / (1 - prior)) + evidence @ (np.log(toxic / clean) * trust)
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def mined_voters(labelled: DataFrame) -> tuple[list[tuple[str, float, float]], int]:
    """(voter, rate in toxic, rate in clean) from counts over labelled rows (columns text, toxic), and the clean rows counted.

    Of a family of copies one row counts, else the words of a much copied text would look telling. A beginning stands for what it
    begins where it is as telling; the most frequent voters stay.
    """
    rows = labelled.select("toxic", _features()(F.col("text")).alias("x")).select("toxic", "x.found", "x.family")
    rows = saved(rows.dropDuplicates(["toxic", "family"]), "families")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return [], clean
    counts = rows.select("toxic", F.explode("found").alias("f")).groupBy("f")
    counts = counts.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    told = counts.where((F.col("a") >= max(5, SHARE * toxic)) & (odds >= ODDS)).orderBy(F.desc("a"), "f").limit(20 * VOTERS).collect()
    chosen: dict[str, tuple[int, int]] = {}
    for row in sorted(told, key=lambda r: (len(r["f"].rstrip("*")), not r["f"].endswith("*"), r["f"])):
        stem = row["f"].rstrip("*")
        covered = [c for c in chosen if c.endswith("*") and stem.startswith(c[:-1])]
        if not any(row["b"] / max(row["a"], 1) >= 0.5 * chosen[c][1] / max(chosen[c][0], 1) for c in covered):
            chosen[row["f"]] = (row["a"], row["b"])
    # a beginning gives way to a longer one that fires about as often in toxic texts and far less in clean ones
    for name, (a, b) in list(chosen.items()):
        longer = [v for other, v in chosen.items() if other != name and other.startswith(name.rstrip("*"))]
        if name.endswith("*") and any(v[0] >= 0.8 * a and v[1] < 0.5 * b for v in longer):
            del chosen[name]
    kept = sorted(chosen.items(), key=lambda kv: (-kv[1][0], kv[0]))
    return [(name, a / toxic, b / clean) for name, (a, b) in kept], clean


def _expectation(patterns: DataFrame, n: int, prior: float, toxic: np.ndarray, clean: np.ndarray, trust: np.ndarray, pairs: bool) -> np.ndarray:
    """Sums over all documents, one partial sum a task: weight, toxic weight, votes by class, and with ``pairs`` toxic pairs of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * n + (n * n if pairs else 0))
        for batch in batches:
            count = batch.column("count").to_numpy().astype(np.float64)
            votes = _evidence(batch.column("mask").to_numpy(), n - 1)
            p = _posterior(votes, prior, toxic, clean, trust) * count
            parts = [[count.sum(), p.sum()], p @ votes, (count - p) @ votes]
            total += np.concatenate(parts + ([((votes * p[:, None]).T @ votes).ravel()] if pairs else []))
        yield pa.record_batch([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["k", "x"])

    sums = patterns.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(2 + 2 * n + (n * n if pairs else 0))
    for row in sums:
        out[row["k"]] = row["x"]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression on fractional labels by Newton steps; the last column is the bias and not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), penalty)
    shrink[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (shrink * w * w).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + shrink * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), gradient)
        now, part = loss(w), 1.0
        while part > 1e-6 and not loss(w - part * step) <= now:
            part /= 2  # a full step can overshoot where the classes are apart
        w -= part * step
        if part * np.abs(step).max() < 1e-8:
            break
    return w


def _design(masks: np.ndarray, hits: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """The classifier's inputs: votes, log of hits, hits per hundred words (up to ten), bias."""
    return np.column_stack([_bits(masks, n), np.log1p(hits), np.minimum(10.0, 100.0 * hits / np.maximum(words, 1)), np.ones(len(masks))])


def _calibrated(weights: np.ndarray, labelled: list, counts: dict[int, int], n: int) -> np.ndarray:
    """The classifier with its scale and bias set on the labelled sample, in the proportions of the labels, so that 0.5 is the place to
    cut. As it is where the sample lacks a class or runs against the classifier."""
    y = np.array([r["toxic"] for r in labelled], np.float64)
    if not len(y) or y.min() == y.max():
        return weights
    masks, hits, words = (np.array([r[k] for r in labelled], np.int64) for k in ("mask", "hits", "words"))
    logit = _design(masks, hits, words, n) @ weights
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    scale, bias = _logistic(np.column_stack([logit, np.ones(len(y))]), y, weight / weight.mean())
    if scale <= 0:
        return weights
    out = weights * scale
    out[-1] += bias
    return out


def trained(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fit voters, label model and classifier.

    Labels are used of rows that are not held out, and only to mine voters (``MINED`` documents of a class), to start the label model,
    for its prior, and to set scale and bias of the classifier. The label model's rates come from the votes on all documents, half a weight being on the labelled start. Documents
    without label train too. Repeated labels of an id are averaged; null ids and labels are left out. Without labels of both classes
    the fixed lexicon votes alone.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    known = known.agg((F.avg(toxic) >= 0.5).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    scale = 1 << 40
    limits = [min(scale, MINED * scale // max(1, counts.get(c, 0))) for c in (0, 1)]
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(scale))
    drawn = saved(known.where(place < F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0])), "labelled")
    sampled = docs.join(F.broadcast(drawn), "doc_id")  # about MINED ids of a class
    mined, n_clean = mined_voters(sampled)
    fixed = [(name, 0.05, 0.001) for name in LEXICON if name not in {m[0] for m in mined}]
    # the patterns come last; behind them stands the silence of all words
    voters = mined[: VOTERS - len(fixed) - len(PATTERNS)] + fixed + [(name, 0.1, 0.1) for name in PATTERNS]
    names, n = tuple(v[0] for v in voters), len(voters)
    start_toxic = np.clip([v[1] for v in voters] + [0.05], 1e-3, 0.9)
    unseen = 1 / (n_clean + 2) if mined else 0.0  # a rate of 0 in a sample is no rate of 0
    start_clean = np.clip([v[2] + unseen for v in voters] + [0.9], 1e-5, 0.9)
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 10)

    voted = docs.select("doc_id", _votes(names, uuid.uuid4().hex)(F.col("text")).alias("v"))
    voted = saved(voted.select("doc_id", "v.mask", "v.hits", "v.words"), "votes")
    patterns = saved(voted.groupBy("mask").count(), "vote-patterns")
    m = n + 1
    alpha, beta, trust = start_toxic, start_clean, np.ones(m)
    for _ in range(ROUNDS):
        sums = _expectation(patterns, m, prior, alpha, beta, trust, False)
        if not sums[0]:
            break
        inside, outside = max(sums[1], 1e-9), max(sums[0] - sums[1], 1e-9)
        alpha = np.clip(0.5 * sums[2 : 2 + m] / inside + 0.5 * start_toxic, 1e-3, 0.95)
        beta = np.clip(0.5 * sums[2 + m : 2 + 2 * m] / outside + 0.5 * start_clean, 1e-5, 0.95)
        prior = float(np.clip(0.5 * inside / sums[0] + 0.5 * prior, 1e-4, 0.5))
    sums = _expectation(patterns, m, prior, alpha, beta, trust, True)
    inside = max(sums[1], 1e-9)
    first, second = sums[2 : 2 + m] / inside, sums[2 + 2 * m :].reshape(m, m) / inside
    spread = np.sqrt(np.maximum(first * (1 - first), 1e-12))
    correlation = (second - np.outer(first, first)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 1.0)
    # voters that fire together beyond what the class explains share their evidence
    trust = 1 / np.where(correlation > 0.3, correlation, 0.0).sum(axis=1)

    share = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(scale))
    by_vote = {bool(r["voted"]): r["count"] for r in voted.where(~held_out(F.col("doc_id"))).groupBy((F.col("hits") > 0).alias("voted")).count().collect()}
    part = [min(scale, FITTED // 2 * scale // max(1, by_vote.get(c, 0))) for c in (False, True)]
    rows = voted.where(~held_out(F.col("doc_id")) & (share < F.when(F.col("hits") > 0, part[1]).otherwise(part[0]))).select("mask", "hits", "words").collect()
    if not rows:
        fired = np.log(alpha / beta) * trust
        weights = np.concatenate([fired[:n], [0.0, 0.0, np.log(prior / (1 - prior)) + fired[n]]])
    else:
        masks, hits, words = (np.array([r[k] for r in rows], np.int64) for k in ("mask", "hits", "words"))
        weight = np.where(hits > 0, scale / part[1], scale / part[0])  # back to the corpus's proportions
        weights = _logistic(_design(masks, hits, words, n), _posterior(_evidence(masks, n), prior, alpha, beta, trust), weight / weight.mean())
    weights = _calibrated(weights, voted.join(F.broadcast(drawn), "doc_id").select("mask", "hits", "words", "toxic").collect(), counts, n)
    return Model(names, tuple(map(float, weights)), tuple(map(float, alpha)), tuple(map(float, beta)), tuple(map(tuple, correlation.tolist())), float(prior))


def with_toxicity(documents: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``documents`` with a struct column ``into``: score (0 to 1), votes (names of the voters that fired). Only the text is read.

    Null and empty texts get the score of a text without votes.
    """
    n, name = len(model.voters), f"__votes_{uuid.uuid4().hex[:8]}"
    out = documents.withColumn(name, _votes(model.voters, uuid.uuid4().hex)(F.col(text)))
    mask, hits, words = (F.col(f"{name}.{k}") for k in ("mask", "hits", "words"))
    terms = F.array(*[F.lit(w) for w in model.weights[:n]])
    voted = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.call_function("shiftright", mask, k).bitwiseAND(F.lit(1)) == 1)
    density = F.least(F.lit(10.0), hits * 100.0 / F.greatest(words, F.lit(1)))
    logit = F.aggregate(voted, F.lit(0.0), lambda total, k: total + F.get(terms, k))
    logit = logit + F.log1p(hits) * model.weights[n] + density * model.weights[n + 1] + model.weights[n + 2]
    fired = F.transform(voted, lambda k: F.get(F.array(*[F.lit(v) for v in model.voters]), k))
    return out.withColumn(into, F.struct((1 / (1 + F.exp(-logit))).alias("score"), fired.alias("votes"))).drop(name)


def is_toxic(score: Column) -> Column:
    return score >= 0.5
