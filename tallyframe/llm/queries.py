"""The queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores, train_quality

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = train_quality(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import PATTERNS, spans_text, with_spans

    rows = with_spans(_table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    counts = [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(PATTERNS)]
    return rows.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address; their source stands for the host, and a text may itself be markup."""
    from .language_id import declared_in, identified, train_languages

    docs = _table(spark, sf_dir, "documents")
    found = identified(docs.drop("lang"), train_languages(docs), host=F.col("source"), declared=declared_in(F.col("text")))
    return found.select("doc_id", "language", "confidence", "evidence", "accepted")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of web pages, with all four kinds of evidence; the text models are those of the documents."""
    from .language_id import declared_in, host_of, identified, suffix_of, train_languages

    model = train_languages(_table(spark, sf_dir, "documents"))
    host = host_of(F.col("url"))
    found = identified(_table(spark, sf_dir, "pages"), model, "html", host, suffix_of(host), declared_in(F.col("html")))
    return found.select("page_id", "language", "confidence", "evidence", "accepted")


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_id_files

    return token_id_files(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_texts

    return main_texts(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import document_pieces, packed_sequences

    return packed_sequences(document_pieces(_table(spark, sf_dir, "documents")))


def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    vectors = quantised(_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import ngram_groups

    return ngram_groups(_table(spark, sf_dir, "documents"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import interaction_audit, verdicts

    return interaction_audit(verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import with_copies

    return with_copies(_table(spark, sf_dir, "documents"), largest=True)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pii_sanitisation": op2_pii_sanitisation,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "pages_language_id": pages_language_id,
    "op5_token_id_files": op5_token_id_files,
    "op6_html_extraction": op6_html_extraction,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_topk_search": op8_exact_topk_search,
    "op9_warc_zip": op9_warc_zip,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}
