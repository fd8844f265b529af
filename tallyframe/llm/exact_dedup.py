"""Exact duplicates of whole texts: groups by a 128-bit content hash, told apart byte by byte.

Native: built-in DataFrame functions only. A first aggregate groups by hash *and* text, so that copies meet before the
shuffle (one row a task for however many copies) and the engine compares the bytes of texts whose hashes are equal. What
it finds is a slim table of texts, by hash; the rows find their text there by hash alone, or, should a hash stand for
several texts, by hash and text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_names, staged

#: A text is hot if more than one in so many rows has it; there are fewer such texts than that, so they are broadcast.
HOT = 1024


def content_hash(sha256: Column) -> Column:
    """The first 128 bits of a SHA-256 in hex."""
    return F.unhex(F.substring(sha256, 1, 32))


def _texts(docs: DataFrame, text_col: str, id_col: str, largest: bool, digest: Callable[[Column], Column]) -> DataFrame:
    """(h, sha, size, keep) of every text. Its id is NULL only if no row of it has one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", digest(F.sha2("text", 256)))
    best = F.max if largest else F.min
    return rows.groupBy("h", "text").agg(F.count("*").alias("size"), best("id").alias("keep")).select("h", F.sha2("text", 256).alias("sha"), "size", "keep")


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, carry: Mapping[str, Column] | None = None, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row a row of ``docs``: (id_col, keep_id, group_size, kept, text_sha256), and the columns of ``carry``.

    Of rows with equal texts the one with the smallest id stays, or the ``largest``. A NULL text counts as empty. A row
    without an id stays only if no row of its text has one. Rows that repeat both id and text cannot be told apart, so they
    are all marked alike and count as many in the size; ``deduplicated`` keeps one of them. An empty table gives no rows.
    Other columns of ``docs`` take no part, whatever their names. ``digest`` makes the hash, of type binary, from the
    SHA-256 in hex; a weak one gives the same result, more slowly.
    """
    carry = dict(carry or {})
    texts = staged(_texts(docs, text_col, id_col, largest, digest), "texts")
    total = texts.agg(F.sum("size")).first()[0] or 0
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.struct(*(c.alias(n) for n, c in carry.items()), F.lit(0).alias("_")).alias("carried")).withColumn("h", digest(F.sha2("text", 256)))

    # texts that share a hash with another are met by their SHA-256 as well, and those whose SHA-256 is equal by their bytes
    per_hash = texts.groupBy("h").agg(F.count("*").alias("n"), F.first("sha").alias("sha"), F.first("size").alias("size"), F.first("keep").alias("keep"))
    clashing = per_hash.where("n > 1").select("h")
    if clashing.isEmpty():
        met = _met(rows.select("id", "h", "carried"), per_hash.drop("n"), total)
    else:
        again = rows.join(clashing, "h", "left_semi")
        whole = again.groupBy("h", "text").agg(F.count("*").alias("size"), (F.max if largest else F.min)("id").alias("keep"))
        exact = again.join(whole, ["h", "text"]).select("id", "carried", F.sha2("text", 256).alias("sha"), "size", "keep")
        met = _met(rows.join(clashing, "h", "left_anti").select("id", "h", "carried"), per_hash.where("n = 1").drop("n"), total).unionByName(exact)
    return met.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
        *(F.col("carried")[n].alias(n) for n in carry),
    )


def _met(rows: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """``rows`` with the (sha, size, keep) of their hash. Rows of hot texts meet them in a broadcast of fewer than ``HOT`` rows
    and are dealt out by their id in the shuffle that the others need."""
    is_hot = F.col("size") * HOT > F.lit(total)
    hot = F.broadcast(texts.where(is_hot).select("h", F.struct("sha", "size", "keep").alias("hot")))
    dealt = rows.join(hot, "h", "left").withColumn("k", F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.unhex(F.hex(F.xxhash64("id", "h")))))
    cold = texts.where(~is_hot).select(F.col("h").alias("k"), F.struct("sha", "size", "keep").alias("cold"))
    some = F.coalesce("hot", "cold")
    return dealt.join(cold, "k", "left").select("id", "carried", some["sha"].alias("sha"), some["size"].alias("size"), some["keep"].alias("keep"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """One whole row of ``docs`` for every text, by the rules of ``with_copies``; of rows that repeat id and text, one.

    One aggregate: rows of a text meet before the shuffle, and no task holds a group."""
    text, h, order, row = free_names(docs, "text", "h", "order", "row")
    rows = docs.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text),
        F.struct(F.col(id_col).isNotNull() if largest else F.col(id_col).isNull(), F.col(id_col)).alias(order),
        F.struct(*(F.col(c) for c in docs.columns)).alias(row),
    )
    best = F.max_by if largest else F.min_by
    return rows.withColumn(h, content_hash(F.sha2(text, 256))).groupBy(h, text).agg(best(row, order).alias(row)).select(f"{row}.*")
