"""A corpus pipeline of five stages: toxicity, language, near duplicates, benchmark contamination, tokens.

Each stage takes (spark, docs, folder of tables) and works on all its predecessor kept. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.bpe import round_trip
from docsieve.llm.common import saved
from docsieve.llm.decontaminate import contamination, is_contaminated
from docsieve.llm.language import learned_dictionaries, with_language
from docsieve.llm.near_dup import BROADCAST_IDS, near_duplicates
from docsieve.llm.toxicity import is_toxic, trained, with_toxicity


def _marked(docs: DataFrame, add, keep) -> DataFrame:
    """Rows for which ``keep`` holds of the struct column that ``add`` appends under a name no column has; the columns of docs."""
    name = "__mark"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return add(docs, name).where(keep(name)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents the toxicity classifier predicts toxic go."""
    model = trained(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return _marked(docs, lambda d, name: with_toxicity(d, model, into=name), lambda name: ~is_toxic(F.col(f"{name}.score")))


def drop_undetermined(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without letters, or between two languages, go."""
    dictionaries = learned_dictionaries(docs)
    return _marked(docs, lambda d, name: with_language(d, dictionaries, into=name), lambda name: ~F.col(f"{name}.rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of rows that share an id and stay, one."""
    found = saved(near_duplicates(docs, words=5, percent=80).select("doc_id", "kept"), "near-duplicates")
    gone = saved(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    # few ids go to every task, so that the texts stay where they are
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = saved(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return left
    single = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(single.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which at least one word in twenty lies in a benchmark passage go."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return _marked(
        docs, lambda d, name: contamination(d, benchmark, window=13, into=name), lambda name: ~is_contaminated(F.col(f"{name}.n_words"), F.col(f"{name}.n_hit"))
    )


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    import public_tokenizers

    both = round_trip(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return both.select(
        "doc_id",
        F.size("tokens.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("tokens.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_undetermined),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", tokens),
]

#: SQL has no label model, compression or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, folder)
