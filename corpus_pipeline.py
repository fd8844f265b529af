"""Corpus pipeline: a chain of filtering and rewriting stages over ``documents``.

Language ID rejects documents without an accepted language; of each group of near copies one document stays; documents
with benchmark passages go; personal data are replaced; what is left is packed into sequences. A stage returns the
columns of its documents, but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.decontaminate import contaminated
from tallyframe.llm.jaccard_join import ngram_groups
from tallyframe.llm.language_id import declared_in, identified, train_languages
from tallyframe.llm.packing import document_pieces, packed_sequences
from tallyframe.llm.pii import sanitised
from tallyframe.llm.storage import discard, free_names, set_aside, small_batches, staged

#: Keys of documents that are broadcast at most, some 40 bytes each; more are joined by shuffles.
BROADCAST_KEYS = 1 << 21


def accepted_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough. The text models are fitted on the documents' own ``lang``."""
    small_batches(spark)
    own, names = set_aside(docs, "language", "confidence", "evidence", "accepted")
    found = identified(own, train_languages(docs), host=F.col("source"), declared=declared_in(F.col("text")))
    return found.where("accepted").select(own.columns).withColumnsRenamed(names).select(docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text, and its name: rows of one id with unlike texts are told apart, and so are rows
    without an id; rows that repeat have one key."""
    (key,) = free_names(docs, "key")
    return docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))), key


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near copies connect, the document with the smallest id, and of rows that repeat, one. Documents
    without an id stand behind those with one."""
    small_batches(spark)
    rows, key = _keyed(docs)
    groups = ngram_groups(rows, id_col=key).select(key, "component_id").distinct()
    ids = rows.select(key, F.col("doc_id").cast("long").alias("id")).groupBy(key, "id").agg(F.count("*").alias("copies"))
    named = staged(groups.join(ids, key), "named")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", key)).alias("first")).select(F.col(f"first.{key}").alias(key), F.lit(True).alias("stays"))
    marked = named.join(kept, key, "left").where("copies > 1 or stays is null").select(key, F.col("stays").isNotNull().alias("stays"))
    marked = staged(marked.distinct(), "marked")
    if marked.count() <= BROADCAST_KEYS:  # so that texts stay where they are
        marked = F.broadcast(marked)
    once = rows.join(marked.select(key), key, "left_anti").unionByName(rows.join(marked.where("stays").select(key), key, "left_semi").dropDuplicates([key]))
    return once.select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    small_batches(spark)
    rows, key = _keyed(docs)
    found = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(found, key, "left_anti").select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced and ``n_chars`` counted anew."""
    clean = sanitised(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    small_batches(spark)
    return packed_sequences(document_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", accepted_languages),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: The stages hold trained models, a singular value decomposition and a tokenizer, none of which SQL can express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; each stage's rows are written and read again, and deleted when the next
    ones are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
