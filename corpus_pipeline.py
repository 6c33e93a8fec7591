"""The corpus pipeline: raw documents to token ids in five stages.

Each stage takes all documents that its predecessor kept and returns them with their columns; only the last one
returns token ids instead of texts. ``run`` writes each stage's result to the shared folder, so that a later stage never
recomputes an earlier one, also when executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, jaccard, mixing, quality, secrets
from granary.llm.common import fresh, saved, table

#: Near copies on the pipeline's terms: five words, similarity 0.8 or more.
WIDTH, P, Q = 5, 80, 100


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this table's labels, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near copies, that with the smallest id; texts without words have no copies.

    Rows that repeat an id and its text are copies as well: one of them stays. Rows without an id stay.
    """
    found = jaccard.near_copies(docs, WIDTH, P, Q)
    gone = saved(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    id_name, again = fresh(docs, "id_of_copy", "times")
    repeated = saved(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(
        F.col("doc_id").alias(id_name), F.lit(True).alias(again)), "repeated")
    rest = docs.join(gone.select(F.col("doc_id").alias(id_name)), F.col("doc_id") == F.col(id_name), "left_anti")
    marked = rest.join(repeated, F.col("doc_id") == F.col(id_name), "left")
    once = marked.where(F.col(again).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
    if repeated.isEmpty():
        return once
    return once.union(marked.where(F.col(again)).select(*(F.col(f"`{c}`") for c in docs.columns)).dropDuplicates(["doc_id", "text"]))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of the secrets found replaced."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of the text, with their number."""
    return bpe.encode(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality classifier", keep_good_quality), ("n-gram Jaccard join", keep_one_of_near_copies),
          ("secret scans", redact_secrets), ("mixing sources", mix_sources), ("byte-level BPE", encode)]

#: The classifier and the forest are fitted models, which SQL does not express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
