"""Queries of the operators over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltacell.llm import audit, bpe, centroids, mixing, neighbours, ngram_join, packing, pii, quality, repeats, template, toxicity, url_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.span_digest(table(spark, sf, "documents"))


@query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.draws(table(spark, sf, "documents"))


ORACLES["op8_mixing"] = mixing.MIX_SQL


@query
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pieces(table(spark, sf, "documents"))


@query
def op2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rules(table(spark, sf, "documents"))


@query
def op4_template(spark: SparkSession, sf: str) -> DataFrame:
    return template.texts(table(spark, sf, "pages"))


@query
def op6_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeats(table(spark, sf, "documents"))


@query
def op5_url_lists(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return url_lists.judge(url_lists.dated_captures(pages), url_lists.dated_lists(pages))


ORACLES["op5_url_lists"] = url_lists.LISTS_SQL


@query
def op12_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLES["op12_audit"] = audit.AUDIT_SQL


@query
def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(table(spark, sf, "embeddings"))


ORACLES["op11_centroids"] = centroids.cluster_sql()


@query
def op13_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"))
