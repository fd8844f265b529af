"""Benchmark decontamination by latent semantic retrieval.

The words of the benchmark are the terms. One pass over the corpus writes every document as term numbers and counts
the terms, whose rarity among the corpus's words gives the weights of TF-IDF. The benchmark's items are cut into
passages, weighted and dealt into small blocks; a distributed randomised SVD gives each block a latent space
of as many directions as leave every passage nearly its whole length. The corpus's passages, cut likewise, are folded
into each space; those whose cosine with an item's passage is high enough make the item a candidate. A candidate is
settled by the weighted longest common subsequence of words with the whole item: near complete, it is a copy; about
half, it is a paraphrase if the item's answer, its last words, is there too. Short items must be there word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged
from .textarrays import lean, pieces, word_hashes, word_spans

#: Words in a passage, and from one passage to the next.
STRIDE = 16
PASSAGE = 2 * STRIDE
#: Items of a latent space, the least squared length that each of them (of length 1) keeps in it, and rounds of power
#: iteration. The random range is as wide as a space has items, so that no item is out of reach.
SPACE_ITEMS, RETAINED, ROUNDS = 256, 0.9, 2
#: Bytes of the spaces that are broadcast and searched at a time.
SPACE_BYTES = 64 << 20
#: Bytes of the items whose words number the terms of one encoding, and the fewest words of an item that can be
#: paraphrased.
ITEM_BYTES, LEAST_WORDS = 16 << 20, 12
#: Cosine of a candidate, and, where less, the part of an item's passage that a passage holds; part of an item's weight in common for a copy and for a paraphrase; words of an answer and
#: the part of their weight that a paraphrase has.
COSINE, HELD, COPY, PARAPHRASE, ANSWER, ANSWERED = 0.25, 0.8, 0.8, 0.5, 6, 0.6
#: Bytes that stand between words: all but letters, digits and those of other alphabets.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_TERM_BLOCK = 1024


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words, index of each row's first word); letters and digits make words, in lower case."""
    for row, _, body, off in pieces(column):
        low = body.copy()
        low[1:] += np.uint8(0x20) * ((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97))
        low[_BETWEEN[low]] = 32
        starts, ends, first = word_spans(low, off)
        yield row, word_hashes(low, starts, ends), first


@dataclass(frozen=True)
class _Items:
    """Items in term numbers (from 1), with the terms' sorted hashes."""

    ids: np.ndarray
    terms: list[np.ndarray]
    hashes: np.ndarray

    def numbers(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words), np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at + 1, 0).astype(np.uint32)


def _items(rows: pa.Table) -> _Items:
    ids, words = [], []
    for k, column in enumerate(rows.column("text").chunks):
        own = rows.column("item_id").chunk(k).to_pylist()
        for row, hashes, first in _words(column):
            for j in range(len(first) - 1):
                if first[j + 1] > first[j]:
                    ids.append(own[row + j])
                    words.append(hashes[first[j] : first[j + 1]])
    hashes = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    found = _Items(np.array(ids, np.int64), [], hashes)
    found.terms.extend(found.numbers(w) for w in words)
    return found


def _encoded(held):
    """Rows (0, id, term numbers of the words, null) of documents, and (1, term, null, count) of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        size = len(items.hashes) + 1
        count = np.zeros(size, np.int64)
        for batch in batches:
            out: list[bytes] = []
            for _, hashes, first in _words(batch.column(1)):
                terms = items.numbers(hashes)
                count += np.bincount(terms, minlength=size)
                raw = terms.astype("<u4" if size > 1 << 16 else "<u2")
                out += [raw[a:z].tobytes() for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column(0), pa.array(out, pa.binary()), pa.nulls(n, pa.int64())], ["kind", "id", "terms", "n"])
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(at), pa.int32()), pa.array(at), pa.nulls(len(at), pa.binary()), pa.array(count[at])], ["kind", "id", "terms", "n"])

    return run


def _weights(made: DataFrame, terms: int) -> np.ndarray:
    """Inverse frequency of each term among the words of the corpus. At 0 stands the weight of words that aren't terms: a
    quarter of the largest, so that a short item still shows in a passage of other words."""
    rows = made.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most one row a term
    count = np.zeros(terms + 1)
    count[rows["id"].to_numpy(np.intp)] = rows["n"].to_numpy(np.float64)
    total = count.sum()
    idf = np.log((total + 2) / (count + 1)) + 0.1
    idf[0] = np.log(total + 2) / 4
    return idf


def telling(terms: np.ndarray, idf: np.ndarray) -> bool:
    """Whether a run of words is too rare to be expected in the corpus by chance: its words' frequencies, multiplied, put
    it there less than once."""
    return bool((idf[terms] - 0.1).sum() >= 4 * idf[0])


def _passages(items: _Items) -> list[tuple[int, np.ndarray]]:
    """(item, terms) of an item's passages, one after the other: at least three quarters of each stand in one of the
    corpus's overlapping passages. The last one ends with the item; less than a stride of words is left without its own."""
    out = []
    for i, t in enumerate(items.terms):
        last = max(0, len(t) - PASSAGE)
        out += [(i, t[min(a, last) :][:PASSAGE]) for a in range(0, max(1, len(t) - STRIDE + 1), PASSAGE)]
    return out


def _vectors(passages: list[tuple[int, np.ndarray]], idf: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Each passage's terms and TF-IDF weights, of length 1, and the length that they had."""
    out, lengths = [], []
    for _, t in passages:
        u, c = np.unique(t, return_counts=True)
        w = c * idf[u]
        lengths.append(np.linalg.norm(w))
        out.append((u, w / lengths[-1]))
    return out, np.array(lengths, np.float32)


@dataclass(frozen=True)
class _Space:
    """Passages of items: their sorted terms, what a word of each term adds to a passage, the passages, the lengths that they
    had, and the items that they are of."""

    terms: np.ndarray
    folding: np.ndarray
    latent: np.ndarray
    lengths: np.ndarray
    items: np.ndarray


def _blocks(vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(first item, end, terms) of the spaces, as many at a time as ``SPACE_BYTES`` hold."""
    some, size = [], 0
    for a in range(0, len(vectors), SPACE_ITEMS):
        z = min(a + SPACE_ITEMS, len(vectors))
        terms = np.unique(np.concatenate([u for u, _ in vectors[a:z]]))
        own = 4 * len(terms) * (z - a)
        if some and size + own > SPACE_BYTES:
            yield some
            some, size = [], 0
        some.append((a, z, terms))
        size += own
    if some:
        yield some


def latent_spaces(spark, vectors: list[tuple[np.ndarray, np.ndarray]], blocks: list[tuple[int, int, np.ndarray]], retained: float = RETAINED) -> list[np.ndarray]:
    """For each block (first row, end, sorted terms) the leading right singular vectors (terms, rank) of its sparse rows,
    by randomised range finding: as many as leave each row, of length 1, at least ``retained`` of its squared length.

    The rows are dealt out as a table by block; a round multiplies a block's rows with its range, and what they add to
    the terms is summed by slice.
    """
    local = [[(np.searchsorted(terms, u), w) for u, w in vectors[a:z]] for a, z, terms in blocks]
    flat = [(b, u, w) for b, rows in enumerate(local) for u, w in rows]
    table = pa.table({"space": pa.array([b for b, _, _ in flat], pa.int64()), "terms": pa.array([u.tolist() for _, u, _ in flat], pa.list_(pa.int64())), "weights": pa.array([w.tolist() for _, _, w in flat], pa.list_(pa.float64()))})
    rows = spark.createDataFrame(table).repartition(min(64, len(blocks)), "space")
    rng = np.random.default_rng(11)
    ranges = [rng.standard_normal((len(terms), z - a)) for a, z, terms in blocks]
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(ranges)

        def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, u, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    u, w, q = u.values.to_numpy(), w.values.to_numpy(), held.value[b]
                    totals.setdefault(b, np.zeros(q.shape))[u] += w[:, None] * (w @ q[u])
            for b, total in totals.items():
                slices = range(0, len(total), _TERM_BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b] * len(slices), pa.int64()), pa.array(list(slices), pa.int64()), pa.array([total[k : k + _TERM_BLOCK].tobytes() for k in slices], pa.binary())], ["space", "slice", "part"]
                )

        def summed(table: pa.Table) -> pa.Table:
            parts = [np.frombuffer(x) for x in table["part"].to_pylist()]
            return pa.table({"space": table["space"][:1], "slice": table["slice"][:1], "part": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

        schema = "space long, slice long, part binary"
        found = rows.mapInArrow(multiplied, schema).groupBy("space", "slice").applyInArrow(summed, schema).toArrow().sort_by([("space", "ascending"), ("slice", "ascending")])
        held.destroy()
        spaces, parts = found["space"].to_numpy(), found["part"].to_pylist()
        turned = []
        for b, q in enumerate(ranges):
            total = np.concatenate([np.frombuffer(parts[k]) for k in np.flatnonzero(spaces == b)]).reshape(q.shape)
            turned.append(np.linalg.qr(total))
        ranges = [q for q, _ in turned]
    out = []
    for own, (q, r) in zip(local, turned, strict=True):
        # of the last product Aᵀ(AQ) = q r, the leading left vectors of r turn q to the singular vectors
        left, _, _ = np.linalg.svd(r)
        space = q @ left
        kept = np.cumsum(np.array([w @ space[u] for u, w in own]) ** 2, axis=1).min(axis=0)
        # all directions hold every row; rounding may leave it a trace short
        rank = min(int(np.searchsorted(kept, min(retained, kept[-1]))) + 1, len(kept))
        out.append(space[:, :rank])
    return out


def common_weight(item: np.ndarray, text: np.ndarray, idf: np.ndarray) -> float:
    """The largest weight of a common subsequence of words, as part of the item's weight."""
    best = np.zeros(len(text) + 1)
    for t in item.tolist():
        gain = best.copy()
        gain[1:] = np.maximum(gain[1:], np.where(text == t, best[:-1] + idf[t], 0.0))
        best = np.maximum.accumulate(gain)
    return float(best[-1] / idf[item].sum())


def _found(held, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, spaces, square = held.value
        rows_of = []
        for space in spaces:
            of = np.zeros(len(idf), np.intp)
            of[space.terms] = np.arange(1, len(space.terms) + 1)
            rows_of.append(of)
        for batch in batches:
            out: dict[tuple[int, int], tuple[float, float, bool]] = {}
            ids = batch.column(0).to_pylist()
            raw, at, row = batch.column(1).to_pylist(), 0, 0
            while row < len(raw):
                end, size = row, 0
                while end < len(raw) and (end == row or size < 1 << 20):
                    size += len(raw[end])
                    end += 1
                terms = np.frombuffer(b"".join(raw[row:end]), dtype).astype(np.intp)
                first = np.concatenate([[0], np.cumsum([len(x) // np.dtype(dtype).itemsize for x in raw[row:end]])])
                for d, item, cosine, share, answered in _matches(terms, first, items, idf, spaces, rows_of, square):
                    key = (ids[row + d], item)
                    if key not in out or out[key][1] < share:
                        out[key] = (cosine, share, answered)
                row = end
            keys, values = list(out), list(out.values())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([k[0] for k in keys], pa.int64()),
                    "item_id": pa.array([k[1] for k in keys], pa.int64()),
                    "cosine": pa.array([v[0] for v in values], pa.float64()),
                    "common": pa.array([v[1] for v in values], pa.float64()),
                    "answered": pa.array([v[2] for v in values], pa.bool_()),
                }
            )

    return run


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows between cuts; empty runs sum to 0."""
    out = np.zeros((len(cuts) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, cuts[full], axis=0)
    return out


def _folded(space: np.ndarray, terms: np.ndarray, known: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of ``n`` entries of ``known`` the sum of their terms' rows of ``space``; the first row is no term."""
    order = np.argsort(-n, kind="stable")
    at, n = at[order], n[order]
    total = np.zeros((len(at), space.shape[1]), space.dtype)
    for j in range(int(n[0]) if len(n) else 0):
        many = int(np.searchsorted(-n, -j))
        total[:many] += space[terms[known[at[:many] + j]]]
    out = np.empty_like(total)
    out[order] = total
    return out


def _lengths(terms: np.ndarray, start: np.ndarray, stop: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Lengths of passages as vectors of counts times weights: a term that is there c times adds c * c of its square."""
    place = start[:, None] + np.arange(PASSAGE)
    words = np.where(place < stop[:, None], terms[np.minimum(place, len(terms) - 1)], -1)
    words.sort(axis=1)
    weight = np.where(words >= 0, square[words], 0.0)
    total = weight.sum(axis=1)
    for lag in range(1, PASSAGE):
        same = (words[:, lag:] == words[:, :-lag]) & (words[:, lag:] > 0)
        if not same.any():
            break
        total += 2 * (weight[:, lag:] * same).sum(axis=1)
    return np.sqrt(np.maximum(total, 1e-12)).astype(np.float32)


def _matches(terms, first, items, idf, spaces, rows_of, square) -> Iterator[tuple[int, int, float, float, bool]]:
    """(document, item, cosine, common weight, answer is there) of the pairs that a piece of the corpus holds.

    A passage is two strides of words. What a stride adds to its passages is projected once for each space. A candidate's
    passages that lie within an item's length of each other are settled together, with as much text on either side.
    """
    near: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    strides = np.maximum(1, -(-np.diff(first) // STRIDE))
    docs = np.repeat(np.arange(len(first) - 1), strides)
    place = np.arange(len(docs)) - (np.cumsum(strides) - strides)[docs]
    start = first[docs] + STRIDE * place
    cuts = np.append(start, first[-1])
    weight = _sums(square[terms], cuts)
    follows = np.append(docs[1:] == docs[:-1], False)
    alone = follows | (place == 0)  # a document's last stride stands in the passage before
    after = lambda x: np.concatenate([x[1:], np.zeros_like(x[:1])]) * follows.reshape(-1, *[1] * (x.ndim - 1))
    norm = np.sqrt(np.maximum(weight + after(weight), 1e-12))
    for space, of in zip(spaces, rows_of, strict=True):
        own_terms = of[terms]
        known = np.flatnonzero(own_terms)
        inner = np.searchsorted(known, cuts)
        inside = _sums(square[terms[known]], inner)
        # A passage's cosine with any other is at most the part of its length that stands in the space's terms; repeated
        # terms make that part larger than it is here, by up to the root of their number.
        least = 0.5 * np.minimum(COSINE * norm, HELD * space.lengths.min())
        open_ = np.flatnonzero(alone & (inside + after(inside) >= least**2) & (inside + after(inside) > 0))
        for k in range(0, len(open_), 4096):
            some = open_[k : k + 4096]
            need = np.unique(np.concatenate([some, some[follows[some]] + 1]))
            folded = _folded(space.folding, own_terms, known, inner[need], inner[need + 1] - inner[need])
            at = np.searchsorted(need, some)
            own = folded[at]
            own[follows[some]] += folded[at[follows[some]] + 1]
            stop = np.minimum(start[some] + PASSAGE, first[docs[some] + 1])
            length = _lengths(terms, start[some], stop, square)[:, None]
            cosine = own @ space.latent.T / length
            for p, j in zip(*np.nonzero(cosine >= np.minimum(COSINE, HELD * space.lengths[None, :] / length)), strict=True):
                near.setdefault((int(docs[some[p]]), int(space.items[j])), []).append((int(start[some[p]]), int(stop[p]), float(cosine[p, j])))
    marks = np.zeros(len(idf), bool)
    for (d, i), found in near.items():
        item, weight = items.terms[i], idf[items.terms[i]]
        reach = len(item)
        begin, end, best = None, 0, 0.0
        for a, z, cosine in [*sorted(found), (None, None, None)]:
            if begin is not None and (a is None or a > end + reach):
                text = terms[max(int(first[d]), begin - reach) : min(int(first[d + 1]), end + reach)]
                share, there = _settled(item, weight, text, idf, marks)
                if share >= COPY or share >= PARAPHRASE and there:
                    yield d, int(items.ids[i]), best, share, there
                begin = None
            if a is not None:
                begin, end, best = (a, z, cosine) if begin is None else (begin, max(end, z), max(best, cosine))


def _settled(item: np.ndarray, weight: np.ndarray, text: np.ndarray, idf: np.ndarray, marks: np.ndarray) -> tuple[float, bool]:
    """The part of an item's weight that stands in a text in order, and whether its answer is there. ``marks`` has a False
    for every term, before and after."""
    if len(item) < LEAST_WORDS:
        whole = len(text) >= len(item) and bool((np.lib.stride_tricks.sliding_window_view(text, len(item)) == item).all(axis=1).any())
        return float(whole), whole
    marks[text] = True
    there = marks[item]
    marks[text] = False
    if weight[there].sum() < PARAPHRASE * weight.sum():
        return 0.0, False  # no more can be common in order than at all
    share = common_weight(item, text, idf)
    answer = item[-ANSWER:]
    return share, bool(idf[answer[there[-ANSWER:]]].sum() >= ANSWERED * idf[answer].sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, common, answered, kind) of every pair of a document and a benchmark item found in it;
    kind is ``copy`` or ``paraphrase``.

    Null texts count as empty; documents and items without an id take no part, and neither do items without words and
    those so short and common that chance puts them into the corpus (``telling``). Rows that repeat a document's id count as
    one document, and the better of equal pairs is told. Empty tables give an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = staged(asked.dropDuplicates(["item_id", "text"]), "benchmark")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    found = None
    for b in range(blocks):
        items = _items(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow())
        if not len(items.ids):
            continue
        terms = len(items.hashes)
        made = staged(texts.mapInArrow(lean(_encoded(spark.sparkContext.broadcast(items))), "kind int, id long, terms binary, n long"), "terms")
        idf = _weights(made, terms)
        passages = [(i, t) for i, t in _passages(items) if telling(items.terms[i], idf)]
        vectors, lengths = _vectors(passages, idf)
        dtype = "<u4" if terms + 1 > 1 << 16 else "<u2"
        for some in _blocks(vectors):
            spaces = []
            for (first, end, own), space in zip(some, latent_spaces(spark, vectors, some), strict=True):
                latent = np.array([w @ space[np.searchsorted(own, u)] for u, w in vectors[first:end]])
                folding = np.concatenate([np.zeros((1, space.shape[1])), space * idf[own][:, None]])
                spaces.append(_Space(own, folding.astype(np.float32), latent.astype(np.float32), lengths[first:end], np.array([i for i, _ in passages[first:end]])))
            held = spark.sparkContext.broadcast((items, idf, spaces, idf * idf))
            part = made.where("kind = 0").select("id", "terms").mapInArrow(lean(_found(held, dtype)), "doc_id long, item_id long, cosine double, common double, answered boolean")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, common double, answered boolean, kind string")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("common", "cosine", "answered")).alias("x"))
    return best.select("doc_id", "item_id", "x.cosine", "x.common", "x.answered", F.when(F.col("x.common") >= COPY, "copy").otherwise("paraphrase").alias("kind"))
