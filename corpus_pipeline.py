"""Documents to packed training sequences: quality, near duplicates, repeated passages, benchmark contamination, packing."""

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, jaccard, packing, quality, suffix_index
from lattica.llm.common import durable, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. It learns from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(quality.fold("doc_id", 5) != 0)
    return quality.keep_good(docs, labels)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id."""
    return jaccard.keep_first(docs)


def _repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of smaller doc_id has too. Some may be left empty."""
    return suffix_index.cut_repeats(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, with their token ids."""
    return packing.pack_documents(docs, packing.vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", _quality),
    ("n-gram Jaccard join", _near_duplicates),
    ("suffix-array dedup", _repeated_passages),
    ("benchmark decontamination", _decontaminate),
    ("packing", _pack),
]
#: The classifier is trained, so SQL can't give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
