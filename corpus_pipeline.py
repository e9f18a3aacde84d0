"""From raw documents to packed training sequences.

Each stage takes all that the one before kept; its result is written as Parquet in the shared folder and read again.  All
but the last return the columns of ``documents``, whatever further ones it has and whatever they are called.

Defined results for odd input: null, empty and short texts fail the base test of the first stage and go; of rows with equal ids and texts, as of all near
duplicates, one stays; rows with equal ids and different texts are different documents; a null id counts as the largest; texts of any
length are processed whole; an empty table of documents gives no pieces, an empty benchmark cuts nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import decontam, jaccard, packing, quality, secrets
from keelson.llm.common import quoted
from keelson.plans.staging import stage, unstage


def _named(columns: list[str]) -> list[Column]:
    """Columns by their names, dots and backticks in them taken as they are."""
    return [F.col(quoted(c)) for c in columns]


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """``docs`` with another text and the n_chars that belongs to it."""
    changed = docs.withColumn("text", text)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*_named(columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and that the label model takes for good."""
    names = quality.added_columns(docs.columns)
    narrow = stage(quality.with_counts(docs.select("text")).drop("text"), "pipeline-counts")
    model = quality.learn(narrow, quality.added_columns(["text"]))
    unstage(narrow)
    judged = quality.judge(quality.with_counts(docs), model, names)
    return judged.where(F.col(f"`{names['kept']}`")).select(*_named(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates."""
    return jaccard.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark windows cover; those with no word left go."""
    cleaned = decontam.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_text(cleaned, F.col("text"), docs.columns).where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    found, spans = secrets.find_secrets(docs)
    return _with_text(found, secrets.redact(F.coalesce("text", F.lit("")), F.col(spans)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmark),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: Tokenisation has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, f) in enumerate(STAGES):
        result = f(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return result
        docs = stage(result, f"pipeline-{i + 1}")
        if last is not None:
            unstage(last)
        last = docs
    return docs
