"""N-gram Jaccard self-join by vertical partitioning, and the groups of documents that its links connect.

All word shingles stand in one global order: rare ones by hash, frequent ones last, so that a passage which many
documents hold doesn't bring each to all others. Two sets that reach the
threshold must share a shingle within their first ``n - ceil(t * n) + 1`` ones, so only these are dealt out by
shingle. The order is then cut into fragments; the overlap of a candidate pair is counted in each fragment
separately and the partial counts are summed per pair. Documents with equal sets form one class, represented
once. A set's partners are first sought among two hubs of each of its shingles; whatever these leave in different
groups is paired in full, so no link that matters to a group is lost, and a group of n near copies costs about n
comparisons, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, staged
from .textarrays import lean, mix64, pieces, shingle_sets, word_hashes, word_spans

#: Shingles that each task reports, and that all tasks together keep, as frequent. They only shape the order.
FREQUENT_PER_TASK, FREQUENT = 4096, 1 << 18
#: Of shingles below this hash, those that come first in the order, all are counted, in parts of ``1 << PART_BITS`` hashes. What
#: is counted, and looked up, is told apart by all but the last ``QUANTUM`` bits.
COUNTED, PART_BITS, QUANTUM = 3 << 61, 54, np.uint64(22)
#: Tables of numbers of up to so many bytes, eight a number, are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 2 << 20
#: Rows whose sets a task holds at a time, numbers of shingles that it counts together, and sets that it knows again.
BLOCK_ROWS, POOL, SEEN = 500, 1_000_000, 250_000
#: Cuts of the global order; the frequent shingles at its end are one more fragment.
FRAGMENTS = 4
_CUTS = np.array([k * (1 << 64) // FRAGMENTS for k in range(1, FRAGMENTS)], np.uint64)
_SALT = np.uint64(0x5851F42D4C957F2D)


def _node(u: np.ndarray) -> int:
    """One 64-bit name for a set of shingles."""
    with np.errstate(over="ignore"):
        total = mix64(u * _SALT).sum(dtype=np.uint64) + np.uint64(len(u))
        return int(mix64(np.array([total]))[0].astype(np.int64))


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int | None, np.ndarray]]:
    ids = batch.column(0).to_pylist()
    for row, _, body, off in pieces(batch.column(1)):
        starts, ends, first = word_spans(body, off)
        for k, u in enumerate(shingle_sets(word_hashes(body, starts, ends), first, words)):
            yield ids[row + k], u


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of some hundred rows, so that a task never holds the sets of a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def _classes(words: int):
    """Rows (0, id, size, node) of documents, (1, shingle, count, null) of the task's frequent shingles, and (2, part, count,
    null, numbers) of all shingles that are counted. Each set that the task knows again counts once."""
    names = ["kind", "id", "n", "node", "low"]

    def run(batches):
        kept, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pool, held, seen = [], 0, set()

        def settle(pool):
            """The shingles to be counted, sorted, without the bits that tell the part and the last ones."""
            nonlocal kept, counts
            u = np.sort(np.concatenate(pool))
            until = np.searchsorted(u, np.uint64(COUNTED))
            part, low = u[:until] >> np.uint64(PART_BITS), (u[:until] >> QUANTUM).astype(np.uint32)
            u, c = np.unique(np.concatenate([u[until:], kept]), return_counts=True)
            if len(kept):
                c[np.searchsorted(u, kept)] += counts - 1
            top = np.flatnonzero(c > 2)
            top = top[np.argsort(-c[top], kind="stable")[:FREQUENT_PER_TASK]]
            top.sort()
            kept, counts = u[top], c[top]
            parts, at = np.unique(part, return_index=True)
            sizes = np.diff(np.append(at, until))
            low = pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(np.append(at, until).astype(np.int32) * np.int32(4)), pa.py_buffer(low)])
            return pa.RecordBatch.from_arrays([pa.array([2] * len(parts), pa.int32()), pa.array(parts.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.nulls(len(parts), pa.int64()), low], names)

        for batch in _blocks(batches):
            ids, sizes, nodes = [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for i, u in _sets(batch, words):
                node = _node(u) if len(u) else None
                ids.append(i), sizes.append(len(u)), nodes.append(node)
                if node is not None and node not in seen:
                    seen.add(node)
                    pool.append(u)
                    held += len(u)
                    if held > POOL:
                        yield settle(pool)
                        pool, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(ids), pa.binary())], names)
        if pool:
            yield settle(pool)
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(kept), pa.int32()), pa.array((kept >> QUANTUM).astype(np.int64)), pa.array(counts), pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.binary())], names)

    return run


def _counted(part: tuple, table: pa.Table) -> pa.Table:
    """(id, n): the shingles of a part that 8 sets have, or more."""
    low = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for chunk in table["low"].chunks for x in chunk]))
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    n = np.diff(np.append(first, len(low)))
    first, n = first[n >= 8], n[n >= 8]
    return pa.table({"id": (part[0].as_py() << (PART_BITS - int(QUANTUM))) + low[first].astype(np.int64), "n": n.astype(np.int64)})


def _often(u: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are frequent, and where in ``often``, which is not empty."""
    short = u >> QUANTUM
    at = np.minimum(np.searchsorted(often, short), len(often) - 1)
    return often[at] == short, at


def _ordered(u: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: rare shingles by hash, then the frequent ones, rarest first."""
    if not len(often):
        return u
    hit, at = _often(u, often)
    if not hit.any():
        return u
    return np.concatenate([u[~hit], u[hit][np.argsort(rank[at[hit]], kind="stable")]])


def _heads(words: int, percent: int, order: Broadcast):
    """Rows (shingle, node, size, place) for the first shingles of each set that is new to the batch."""

    def run(batches):
        often, rank = order.value
        seen: set[int] = set()
        for batch in _blocks(batches):
            keys, nodes, sizes, lens = [], [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for _, u in _sets(batch, words):
                if not len(u) or (node := _node(u)) in seen:
                    continue
                seen.add(node)
                n = len(u)
                head = _ordered(u, often, rank)[: n - (percent * n + 99) // 100 + 1]
                keys.append(head), nodes.append(node), sizes.append(n), lens.append(len(head))
            reps = np.array(lens, np.int64)
            key = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
            place = np.arange(len(key)) - np.repeat(np.cumsum(reps) - reps, reps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(np.array(nodes, np.int64), reps)), pa.array(np.repeat(np.array(sizes, np.int32), reps)), pa.array(place.astype(np.int32))], ["key", "node", "n", "place"])

    return run


def _segments(words: int, wanted: Broadcast, order: Broadcast):
    """Rows (id, node, fragment, shingles) of the documents whose id may be wanted; a batch tells each set once."""

    def run(batches):
        bits, often = wanted.value, order.value[0]
        for batch in _blocks(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = mix64(ids.astype(np.int64).astype(np.uint64)) % np.uint64(len(bits) * 8)
            keep = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(keep.astype(bool)))
            out, seen = ([], [], [], []), set()
            for i, u in _sets(batch, words):
                node = _node(u)
                if (i, node) in seen:
                    continue
                seen.add((i, node))
                last = _often(u, often)[0] if len(often) else np.zeros(len(u), bool)
                rare = u[~last].astype(np.int64)
                cut = np.searchsorted(u[~last], _CUTS)
                for f, seg in enumerate([*np.split(rare, cut), u[last].astype(np.int64)]):
                    if len(seg):
                        for column, value in zip(out, (i, node, f, seg), strict=True):
                            column.append(value)
            flat = np.concatenate(out[3]) if out[3] else np.zeros(0, np.int64)
            off = np.concatenate([[0], np.cumsum([len(x) for x in out[3]])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["id", "node", "fragment", "seg"])

    return run


def _bitmap(ids: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """A bitmap of fixed size over hashed ids; made per task and merged as distinct set words."""

    def run(batches):
        mine = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = mix64(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(bits)
            np.bitwise_or.at(mine, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        words = mine.view(np.uint64).astype(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], ["at", "word"])

    rows = ids.mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return out.view(np.uint8)


def _verified(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the threshold: partial overlaps by fragment, summed per pair."""
    one = segs.select(F.col("node").alias("a"), "fragment", F.col("seg").alias("sa"))
    two = segs.select(F.col("node").alias("b"), "fragment", F.col("seg").alias("sb"))
    partial = _sized(pairs).join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("sa", "sb")).alias("c"))
    partial = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("c").alias("c"))  # rows that repeat have repeated segments
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("both"))
    return total.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _sized(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it is short enough."""
    return F.broadcast(df) if df.count() * 8 * len(df.columns) <= BROADCAST_BYTES else df


def _second(rows: DataFrame, field: str) -> DataFrame:
    """(node, n, place, node2, n2, place2): each row with what the struct ``field`` holds."""
    return rows.select("node", "n", "place", *(F.col(f"{field}.{c}").alias(c + "2") for c in ("node", "n", "place")))


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z in lower case; a set holds the distinct runs of
    ``words`` words, or the whole text as one run if it has fewer. Two documents link when their sets' Jaccard
    similarity is at least ``percent`` / 100; component_id is the smallest id reachable over links.

    Null or empty texts have no shingles and are their own component; a null id stays null and takes no part in
    links; rows that repeat an id are each returned; extra columns are ignored; an empty table gives an empty
    result. Shingles and sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = staged(docs.mapInArrow(lean(_classes(words)), "kind int, id long, n long, node long, low binary"), "sets")
    often = made.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where("n >= 8")
    counted = staged(made.where("kind = 2").select("id", "low").groupBy("id").applyInArrow(_counted, "id long, n long"), "counted")
    often = often.unionByName(counted).orderBy(F.desc("n"), "id").limit(FREQUENT).toPandas()
    often = often.sort_values(["n", "id"], ascending=[True, True])
    hashes = often["id"].to_numpy(np.int64).astype(np.uint64)
    by = np.argsort(hashes)
    order = spark.sparkContext.broadcast((hashes[by], np.arange(len(by))[by]))
    rows = staged(made.where("kind = 0").select("id", "n", "node"), "rows")
    discard(made)
    reps = staged(rows.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "reps")

    heads = docs.where("id is not null and text is not null").mapInArrow(lean(_heads(words, percent, order)), "key long, node long, n int, place int")
    per = Window.partitionBy("key")
    shared = heads.withColumn("low", F.min("node").over(per)).withColumn("high", F.max("node").over(per)).where("low != high")
    shared = staged(shared.select("key", "node", "n", "place").distinct(), "shared")

    def candidates(x: DataFrame) -> DataFrame:
        """Pairs of rows that share keys, less those that can't reach the threshold: what the first common shingle leaves
        bounds the overlap, and so do the common first shingles plus the longer rest."""
        x = x.where((F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")) & (F.col("node") != F.col("node2")))
        left = F.col("node") < F.col("node2")
        side = lambda p, q: F.when(left, F.col(p)).otherwise(F.col(q))
        x = x.select(side("node", "node2").alias("a"), side("node2", "node").alias("b"), side("n", "n2").cast("long").alias("na"), side("n2", "n").cast("long").alias("nb"), side("place", "place2").alias("ia"), side("place2", "place").alias("ib"))
        x = x.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.min("ia").alias("ia"), F.min("ib").alias("ib"))
        rest = lambda n: F.floor((F.lit(percent) * n + 99) / 100) - 1
        most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"), F.col("c") + F.greatest(rest(F.col("na")), rest(F.col("nb"))))
        return staged(x.where(F.lit(100) * most >= F.lit(percent) * (F.col("na") + F.col("nb") - most)).select("a", "b", "na", "nb"), "candidates")

    def apart(x: DataFrame) -> DataFrame:
        """Pairs of rows of different components that share keys. At their first common shingle, what either set has from
        there on bounds the overlap: a row at which that is too little can't be a linking pair's first one, and is
        dropped. Then the common first shingles of the pairs left are counted in full."""
        other = x.select("key", *(F.col(c).alias(c + "2") for c in ("node", "n", "place", "component")))
        left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
        enough = F.lit(100 + percent) * left >= F.lit(percent) * (F.col("n") + F.col("n2"))
        met = x.join(other, "key").where((F.col("component") < F.col("component2")) & enough)
        first = F.col("node") < F.col("node2")
        side = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
        pairs = met.select(side("node", "node2").alias("a"), side("node2", "node").alias("b"), side("n", "n2").cast("long").alias("na"), side("n2", "n").cast("long").alias("nb"))
        pairs = staged(pairs.distinct(), "pairs")
        keys = x.groupBy("node").agg(F.collect_list("key").alias("keys"))
        both = _sized(pairs).join(keys.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a").join(keys.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b")
        both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ka", "kb")).alias("c"))
        rest = lambda n: F.floor((F.lit(percent) * n + 99) / 100) - 1
        most = F.col("c") + F.greatest(rest(F.col("na")), rest(F.col("nb")))
        return staged(both.where(F.lit(100 + percent) * most >= F.lit(percent) * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb"), "candidates")

    def links(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ends = staged(reps.join(ends, "node", "left_semi").select("node", F.col("rep").alias("id")), "ends")
        wanted = spark.sparkContext.broadcast(_bitmap(ends.select("id")))
        segs = docs.where("id is not null and text is not null").mapInArrow(lean(_segments(words, wanted, order)), "id long, node long, fragment int, seg array<long>")
        segs = staged(segs.join(_sized(ends), ["id", "node"], "left_semi").select("node", "fragment", "seg"), "segments")
        # links join the smallest ids of their sets, so that a group is named by the smallest of all
        name = _sized(ends)
        linked = _verified(pairs, segs, percent).join(name.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a").join(name.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b")
        linked = staged(linked.select(F.col("ia").alias("a"), F.col("ib").alias("b")), "linked")
        discard(segs)
        return linked

    def renamed(components: DataFrame) -> DataFrame:
        return components.withColumnRenamed("node", "node_id")

    # Of a group of near copies, the text that they were made from shares the largest part of its shingles.
    central = _sized(staged(shared.groupBy("node").agg(F.count("*").alias("held")), "central"))
    weight = F.struct(F.col("held") / F.col("n"), F.xxhash64("node"))
    row = F.struct("node", "n", "place")
    hubs = shared.join(central, "node").select("key", "node", "n", "place", weight.alias("weight"))
    hubs = hubs.select("key", "node", "n", "place", F.max_by(row, "weight").over(per).alias("hub"), F.min_by(row, F.xxhash64("node")).over(per).alias("other"))
    hubs = staged(hubs.select("node", "n", "place", "hub", F.when(F.col("other.node") != F.col("hub.node"), F.col("other")).alias("other")), "hubs")
    linked = links(candidates(_second(hubs, "hub").unionByName(_second(hubs.where("other is not null"), "other"))))
    discard(hubs)
    comp = staged(reps.join(renamed(connected_components(linked)), F.col("node_id") == F.col("rep")).select("node", "component"), "components")
    named = shared.join(_sized(comp), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.withColumn("low", F.min("component").over(per)).withColumn("high", F.max("component").over(per)).where("low != high")
    named = staged(named.drop("low", "high"), "apart")
    discard(shared)
    linked = linked.unionByName(links(apart(named)))

    comp = renamed(connected_components(linked))
    classes = reps.join(comp, F.col("node_id") == F.col("rep"), "left").select("node", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(classes, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
