"""The ten operators as queries over the tables of a folder: thin, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm import decontam, langid, linededup, mixing, neardup, pii, quality, topk, toxicity, warc
from edgetide.llm.oracles import ORACLES
from edgetide.llm.runtime import remainder

TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, rest: int) -> F.Column:
    """A row without doc_id belongs to neither side; it counts as not held out and is never learned from."""
    return F.coalesce(remainder("doc_id", modulus) == rest, F.lit(False)).alias("held_out")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    return toxicity.train(docs, labels)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 3) != 1))
    found = langid.detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(3, 1), "lang_pred", F.col("lang_score").alias("score"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs.where(remainder("doc_id", 3) != 1), table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    s = quality.score(docs, model)
    return s.select("doc_id", held_out(3, 1), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, archives = warc.write_archives(table(spark, sf_dir, "pages"), revisit_from=0)
    return warc.records(warc.read_archives(folder, archives, with_chunks=False))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.numbered(topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return s.select("doc_id", held_out(4, 2), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_source_mixing, op3_line_dedup, op4_decontamination, op5_quality, op6_warc, op7_exact_topk, op8_toxicity, op9_pii, op10_near_dedup)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
