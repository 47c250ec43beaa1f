"""The training corpus, from documents to packed sequences, stage by stage.

Defined results. Language: a null or empty text, or one without letters, goes; a null lang isn't learned from. Near
duplicates: documents without words stay, of each other group one row stays, that of the smallest doc_id, and of equal
rows the first by their content. Secrets: null and empty texts stay as they are. Mix: documents without words, which
language identification has rejected already, aren't taken; a null source is a source of its own; repeated rows are
separate documents. Packing: a null text is its closing id alone; null doc_ids stay null. Very long texts go through each
stage whole, an empty table through all of them, and columns besides those of documents are carried along to the mix,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contigra.llm import langid, mixing, neardup, packing, secrets
from contigra.llm.common import new_path

#: A prediction under this probability rejects a document: less sure than a guess between two languages.
LEAST_SCORE = 0.4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; those without letters, or of which it isn't sure, go. Without any
    label to learn from there is no network, and all documents with letters pass."""
    network = langid.fit(docs)
    if network is None:
        return docs.where(langid.lettered(docs["text"]))
    found = langid.predict(docs, network)
    return found.where((found.lang_pred != "und") & (found.score >= LEAST_SCORE)).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.without_copies(docs)


def scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets take them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language identification", identify),
    ("near-duplicates", deduplicate),
    ("secret scan", scan),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each one's rows written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A trained network, sketches and a tokenizer's ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
