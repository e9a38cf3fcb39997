"""A corpus in five stages: known languages, nothing toxic, one of each group of near copies, no benchmark, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and is written as Parquet and read
again for the next. All but the last return the columns of documents unchanged. Near copies are texts whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more; a group's row with the smallest id stays. Rows that share an
id are one document: equal ones count once, and an id that goes takes all its rows with it. Rows with a null id are
judged by their text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontamination, jaccard_join, language_id, toxicity
from skein.llm.common import filter_rows, small_batches, work_path, work_tables
from skein.llm.queries import tokenizer_path

TOXIC, FOREIGN, WIDTH, OVER, UNDER, FEW = 0.7, 0.5, 5, 80, 100, 200_000
ORACLE_SQL = None  # classifiers and a tokenizer are not SQL


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that could be learnt stay; without a text or a letter, or with most letters in scripts that no learnt language is written in, a row goes."""
    small_batches(spark)
    model = language_id.learn(docs, F.lit(True))
    return filter_rows(docs, "text", lambda texts: [name != language_id.UNKNOWN and odd <= FOREIGN for name, odd in zip(model.predict(texts)[0], model.foreign(texts))])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return filter_rows(docs, "text", lambda texts: (model.score(texts) < TOXIC).tolist())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = jaccard_join.join(docs, WIDTH, OVER, UNDER).filter("doc_id is not null")
    path = work_path(spark, "groups")
    groups.write.parquet(path)
    groups = spark.read.schema(groups.schema).parquet(path)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, "doc_id", "left_anti").select(docs.columns)
    again = groups.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, their number, and the SHA-256 of what they decode to."""
    small_batches(spark)
    return bpe.encode_rows(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", languages),
    ("toxicity", toxic),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_free),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are a table in the shared folder, which goes once the next one is written, as all other work tables do."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with work_tables(spark) as last:
        for name, stage in STAGES:
            with work_tables(spark) as kept:
                out = stage(spark, docs, sf_dir)
                kept.append(path := work_path(spark, f"pipeline-{name}"))
                out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        last.append(path)
    return docs
