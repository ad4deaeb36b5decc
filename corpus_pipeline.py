"""A corpus pipeline of five stages; each works on all that the stage before has kept.

toxicity removes documents that the classifier rejects; near_duplicates keeps the document of the least id of each group of linked
word-shingle sets; benchmark_leaks removes documents with a benchmark window; personal_data replaces identifiers by their
kind; tokens encodes what is left. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import bpe, decontaminate, jaccard, pii, toxicity
from groundwork.llm.queries import learn_toxicity, table, vocabulary
from groundwork.llm.store import ready, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold; learnt from the labels of the documents that come in."""
    model = learn_toxicity(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name="_toxicity").filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component, and all documents without id. Rows of one id count as one document."""
    ready(spark)
    found = jaccard.jaccard_components(docs)
    removed = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(removed, "doc_id", "left_anti").select(docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), name="_leak")
    return found.filter("not _leak.contaminated").drop("_leak")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers replaced and n_chars counted anew."""
    ready(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    out = bpe.encode_exactly(docs, vocabulary(spark), name="_bpe")
    return out.select("doc_id", "lang", "source", F.size("_bpe.ids").cast("long").alias("n_tokens"), F.col("_bpe.ids").alias("ids"), F.col("_bpe.exact").alias("exact"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("benchmark_leaks", remove_leaks),
    ("personal_data", mask_personal_data),
    ("tokens", encode),
]

#: A trained classifier and connected components aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
