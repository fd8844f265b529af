"""How filters of documents interact: all orders of a set of filters, by a trie of which each state is made once.

The documents that are left after some filters do not depend on the order of these, so the trie of all orders has one state
for every subset. States are walked depth first: a state's survivors are those of the state before it without what one more
filter removes, persisted while its branch is walked; one job per state counts what each next filter actually removes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import with_copies
from .storage import staged

#: Words are what stands between these.
WHITE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides: A too few words, B too many repeated words, C too many capitals, D
    a character of markup or code. The words of a text are split once."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    return {
        "words": counted,
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, A, B, C, D, E), one row a document; E is a text that a smaller doc_id has as well.

    A NULL text is empty, a NULL language an empty one. A document without an id neither fails E nor has labels. A document
    is good, or toxic, if any of its labels says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    carry = {"part": F.coalesce(F.col("lang").cast("string"), F.lit(""))} | text_failures(text)
    rows = with_copies(docs, carry=carry).withColumn("E", F.coalesce(F.col("doc_id") > F.col("keep_id"), F.lit(False)))
    rows = rows.withColumn("A", F.col("words.n") < LEAST_WORDS).withColumn("B", 100 * F.col("words.d") < LEAST_DISTINCT * F.col("words.n"))
    any_ = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(any_("quality").alias("good"), any_("toxic").alias("toxic"))
    met = rows.join(known, rows["doc_id"] == known["labelled"], "left")
    return met.select("part", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic", "A", "B", "C", "D", "E")))


def edges(rows: DataFrame, filters: Sequence[str], key: str, tallies: Mapping[str, Column]) -> DataFrame:
    """(key, state, filter, kept, removed, and each tally of what is removed) of every edge of the trie of ``filters``, which
    are columns that are true where a row fails. ``state`` is the sum of the bits of the filters before the edge, the first
    filter being bit 0. A key without survivors in a state has no row there.
    """
    bit = {f: 1 << i for i, f in enumerate(filters)}
    known: dict[int, DataFrame] = {}

    def walk(state: int, survivors: DataFrame) -> None:
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        next_ = [f for f in filters if not state & bit[f]]
        counts = [F.struct(F.lit(f).alias("filter"), F.count_if(~F.col(f)).alias("kept"), F.count_if(f).alias("removed"), *(F.count_if(F.col(f) & t).alias(n) for n, t in tallies.items())) for f in next_]
        found = survivors.groupBy(key).agg(F.array(*counts).alias("each"))
        known[state] = staged(found.select(key, F.lit(state).alias("state"), F.inline("each")), "edges")
        for f in next_:
            after = state | bit[f]
            if after not in known and after + 1 < 1 << len(filters):  # nothing follows when all filters are applied
                walk(after, survivors.where(~F.col(f)))
        survivors.unpersist()

    walk(0, rows)
    out = None
    for found in known.values():
        out = found if out is None else out.unionByName(found)
    return out


def interaction_audit(rows: DataFrame, filters: Sequence[str] = ("A", "B", "C", "D", "E"), key: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """Every order of ``filters`` and every step of it, for every value of ``key``: what is kept and removed, what fails the
    filter but was removed before (``redundant``), what fails it alone, the good and toxic rows it removes, and its removals
    summed over all orders (``shapley``, as a sum: divide by the number of orders for the mean).

    NULLs of ``key`` make no rows of their own and must be named by the caller; NULL flags count as false. An empty table has
    no rows. Rows that repeat count as often as they are there.
    """
    bit = {f: 1 << i for i, f in enumerate(filters)}
    full = (1 << len(filters)) - 1
    spark = rows.sparkSession
    flags = rows.select(F.col(key).alias("part"), *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, good, toxic)))
    flags = staged(flags, "verdicts")
    found = edges(flags, filters, "part", {"good_lost": F.col(good), "toxic_lost": F.col(toxic)})
    steps = [("".join(o), k + 1, f, sum(bit[x] for x in o[:k])) for o in permutations(filters) for k, f in enumerate(o)]
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter string, state int")
    # per filter: what fails it at all (the edge out of the root), alone (the edge behind all others), and in all orders
    n = len(filters)
    shares = F.create_map(*(F.lit(x) for s in range(full + 1) for x in (s, math.factorial(s.bit_count()) * math.factorial(max(0, n - 1 - s.bit_count())))))
    alone = F.create_map(*(F.lit(x) for f in filters for x in (f, full ^ bit[f])))
    about = found.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.coalesce(F.sum(F.when(F.col("state") == alone[F.col("filter")], F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(shares[F.col("state")] * F.col("removed")).cast("long").alias("shapley"),
    )
    # a part that a state leaves empty still has its rows of zeros
    every = about.join(F.broadcast(plan), "filter")
    met = every.join(found, ["part", "filter", "state"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return met.select(
        "part", "filter_order", "step", count("kept"), count("removed"), (F.col("fails") - F.coalesce("removed", F.lit(0))).cast("long").alias("redundant"),
        F.col("unique_fails").cast("long").alias("unique_fails"), count("good_lost"), count("toxic_lost"), "shapley",
    )
