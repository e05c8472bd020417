"""A corpus pipeline of five stages over ``documents``: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Any column may hold nulls, rows may repeat and the table may be empty. A row without doc_id or text is a document like
all others: a stage decides by doc_id and text together, never by doc_id alone. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm import decontam, linededup, mixing, neardup, toxicity
from edgetide.llm.queries import TOXIC_FROM, table, toxicity_model
from edgetide.llm.runtime import lookup, new_path, stage, text_keys

#: SQL can't express the trained classifier of the first stage, on which all others depend.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of the text (t1, t2), whatever other columns docs have."""
    return docs.select("doc_id", *text_keys(), "text")


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose doc_id and text are those of a row of ``keys`` (doc_id, t1, t2), or (left_anti) the others."""
    keys = stage(keys.select(F.col("doc_id").alias("g"), F.col("t1").alias("g1"), F.col("t2").alias("g2")).distinct(), "keys")
    t1, t2 = text_keys()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "doc_id", t1, t2)
    same = F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2"))
    return whole.join(lookup(keys), same, how).select(*[F.col("document")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold. A null or empty text is scored like any other, as an empty one;
    repeated rows are scored alike. An empty table stays empty."""
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.where(F.col("toxicity_score") < TOXIC_FROM).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats or nearly repeats go; a document that loses lines and has only whitespace left
    goes too. Null and empty texts stay. Rows with the same doc_id and text are one document and stay as they are."""
    return linededup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) one document stays: the one with the smallest doc_id
    (null last), then by a key of the text; of identical rows one. Null and empty texts are no one's duplicates: all
    stay, repeated or not."""
    groups = stage(neardup.near_duplicates(docs), "near-groups")
    out = matched(docs, groups.where("not first"), "left_anti")
    again = groups.where("first and n_shingles > 0").groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if again.isEmpty():
        return out
    # identical rows are few next to all others, which are not shuffled for them
    return matched(out, again, "left_anti").unionByName(matched(out, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's five-word shingles go, whole; all others stay, also null and
    empty texts and repeated rows. An empty benchmark takes nothing."""
    return matched(docs, decontam.contaminated(keyed(docs), table(spark, sf_dir, "benchmark"), keep=("t1", "t2")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that the sources meet their targets; a row a document, also those not taken."""
    return mixing.pareto_mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
