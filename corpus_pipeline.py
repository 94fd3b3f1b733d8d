"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the
columns of ``documents``. :func:`run` writes every stage's rows to the shared folder and reads them
again as the next one's input, so a lost executor never reaches back beyond one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltacell.llm import mixing, ngram_join, packing, pii, toxicity
from deltacell.llm.ids import by_ids
from deltacell.session import settle

#: Models and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Learns from labelled rows that are not held out.

    Null and empty texts hold no term of the lexicon and stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out("doc_id")))
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, once if its row repeats.

    Near copies share at least 80 % of their five-word shingles (Jaccard), or are linked by such pairs.
    Documents without words link with nothing and stay. A row without doc_id names no document and
    stays. Only ids of what goes are joined, as they are few.
    """
    groups = settle(ngram_join.jaccard_components(docs, size=5, percent=80))
    gone = settle(groups.where("doc_id <> component_id").select("doc_id"))
    many = settle(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = by_ids(docs.where("doc_id is not null"), gone.union(many), "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "lang", "source", "n_chars"))
    repeated = by_ids(by_ids(docs, many, "left_semi"), gone, "left_anti")
    once = repeated.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    names = docs.columns
    return kept.select(*names).union(once.select(*names)).union(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in angle brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight draws them, as many words in all as came in."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece of a document."""
    return packing.pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
