"""Weak supervision: held-out accuracy and edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docsieve.llm.common import held_out
from docsieve.llm.toxicity import LEXICON, is_toxic, trained, with_toxicity, writing


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean and toxic texts of two made-up languages, whose insults share a beginning in one; labels of two thirds."""
    draw = random.Random(9)
    one, two = ["lorem%d" % i for i in range(200)], ["ipsum%d" % i for i in range(200)]
    docs, labels = [], []
    for i in range(1500):
        toxic, first = int(draw.random() < 0.2), draw.random() < 0.6
        words = [draw.choice(one if first else two) for _ in range(draw.randint(20, 120))]
        if toxic:
            for _ in range(draw.randint(2, 5)):
                words.insert(draw.randrange(len(words)), draw.choice(LEXICON[:6]) if first else "vilez" + draw.choice(["a", "on", "ist", "ier", "um", "os"]))
        docs.append((i, " ".join(words).upper() if draw.random() < 0.1 else " ".join(words), "x"))
        if draw.random() < 0.67:
            labels.append((i, toxic, 1))
    docs += [(5000, None, "x"), (5001, "", "x"), (5002, "...", "x"), (None, "plain text", "x"), (3, docs[3][1], "x"), (5003, "idiot " * 30_000, "x")]
    labels += [(None, 1, 1), (4, None, 1), labels[0], labels[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, votes string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    model = trained(docs, labels)
    assert any(v == "vile*" or v == "vilez*" for v in model.voters) and set(LEXICON[:6]) <= {v.rstrip("*") for v in model.voters} | {v for v in LEXICON}
    scored = with_toxicity(docs, model)
    assert scored.columns == ["doc_id", "text", "votes", "toxicity"]
    told = scored.join(labels.where("toxic is not null").distinct(), "doc_id").where(held_out(F.col("doc_id"))).where("doc_id < 1500")
    right, n = told.agg(F.avg((is_toxic(F.col("toxicity.score")) == (F.col("toxic") == 1)).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97
    edge = {r["doc_id"]: r["toxicity"]["score"] for r in scored.where("doc_id >= 5000 or doc_id is null").collect()}
    assert all(0 <= s <= 1 for s in edge.values()) and max(edge[i] for i in (5000, 5001, 5002, None)) < 0.5 < edge[5003]
    assert scored.count() == docs.count()


def test_labels_of_held_out_rows_are_not_used(spark, corpus):
    docs, labels = corpus
    wrong = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert trained(docs, labels).voters == trained(docs, wrong).voters


def test_without_labels_or_rows(spark, corpus):
    docs, labels = corpus
    for d, l in ((docs, labels.where("false")), (docs.where("false"), labels), (docs.where("false"), labels.where("false"))):
        model = trained(d, l)
        scores = [r[0] for r in with_toxicity(spark.createDataFrame([(1, "you idiot you moron"), (2, "good day")], "doc_id long, text string"), model).select("toxicity.score").collect()]
        assert scores[0] > scores[1] and all(0 <= s <= 1 for s in scores)


def test_shouting_behind_a_long_beginning_without_letters():
    for beginning in ("", "0" * 2_000, "- " * 50_000):
        assert writing(beginning + "GO AWAY " * 4, 4) == [True, False]
        assert writing(beginning + "GO AWAY " * 3, 4) == [False, False]  # 18 letters
        assert writing(beginning + "GO AWAY " * 4 + "x", 4) == [False, False]
