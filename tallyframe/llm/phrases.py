"""Collocations: phrases of two to ``max_n`` words that stand together more often than their parts would by chance.

Phrases are counted by their suffixes: every word of a piece begins one, cut off after ``max_n`` words. Suffixes are shuffled
by language and first word and sorted backwards, so that all phrases that begin alike follow one another and one stack of
``max_n`` counters counts all prefixes in one pass. The counts of a phrase's parts are joined to it afterwards.

A suffix is one string, ``language TAB word SPACE word SPACE ...``: no word holds a tab or a space, and every prefix of words,
its last space included, is a range of such strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small_batches, staged

#: Characters between pieces become line ends and tabs spaces; words are what stands between spaces inside a piece.
_ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
#: Suffixes that a task holds before it adds up equal ones and passes them on, and bytes of them that it makes at once.
HELD, MADE = 1_000_000, 4_000_000
#: A first word is hot if more than one suffix in so many begins with it; there are fewer such words than that.
HOT = 512
#: Sorted suffixes that are compared with one another at once.
BLOCK = 20_000
_COUNTED = "s string, c long"


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, edges, ends) of texts in lower case: their words one after the other, each followed by a space; where each begins and
    the last one ends; and for each word the place of the first word after its piece."""
    raw = np.frombuffer(b"\n".join(texts).translate(_ENDS), np.uint8)
    inside = (raw != 10) & (raw != 32)
    padded = np.concatenate([[False], inside, [False]])
    starts, stops = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:])
    if not len(starts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, np.int64)
    size = stops - starts
    edges = np.concatenate([[0], np.cumsum(size + 1)])
    data = np.full(edges[-1], 32, np.uint8)
    data[np.flatnonzero(inside) + np.repeat(edges[:-1] - starts, size)] = raw[inside]
    piece = np.cumsum(raw == 10)[starts]
    last = np.append(np.flatnonzero(np.diff(piece)) + 1, len(starts))
    return data, edges, last[np.searchsorted(last, np.arange(len(starts)), side="right")]


def _parts(texts: list[bytes], max_n: int, made: int) -> Iterator[pa.Array]:
    """The words of the texts, or with a ``max_n`` above 1 their suffixes of two words or more, some ``made`` bytes at a time."""
    data, edges, ends = _words(texts)
    if max_n == 1:
        first = 0
        while first < len(ends):
            until = max(first + 1, int(np.searchsorted(edges, edges[first] + 64 * made)) - 1)
            yield _binary(data[edges[first] : edges[until]], edges[first : until + 1] - edges[first])
            first = until
        return
    after = np.minimum(np.arange(len(ends)) + max_n, ends)
    long = np.flatnonzero(after - np.arange(len(ends)) > 1)
    start, size = edges[long], edges[after[long]] - edges[long]
    total = np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < len(long):
        until = max(first + 1, int(np.searchsorted(total, total[first] + made)) - 1)
        offsets = total[first : until + 1] - total[first]
        from_ = np.repeat(start[first:until] - offsets[:-1], size[first:until])
        yield _binary(data[from_ + np.arange(offsets[-1])], offsets)
        first = until


def _counted(batches: Iterator[pa.RecordBatch], max_n: int, most: int, made: int) -> Iterator[pa.RecordBatch]:
    """(s, c) of the words or suffixes of (lang, text) rows, equal ones added up as far as ``most`` of them reach. Passed on in
    order, as neighbours that begin alike take less room in a shuffle."""
    held: dict[str, list[pa.Array]] = {}
    rows = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, arrays in held.items():
            table = pa.table({"s": pa.chunked_array(arrays, pa.binary())}).group_by("s", use_threads=False).aggregate([([], "count_all")])
            table = table.sort_by("s").combine_chunks()
            for part in table.to_batches(max_chunksize=50_000):
                head = pa.scalar(lang.encode("utf-8", "replace") + b"\t", pa.binary())
                s = pc.binary_join_element_wise(head, part.column("s"), pa.scalar(b"", pa.binary()))
                yield pa.RecordBatch.from_arrays([s.cast(pa.string()), part.column("count_all")], ["s", "c"])
        held.clear()

    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text.encode("utf-8", "replace").lower())
        for lang, own in texts.items():
            for array in _parts(own, max_n, made):
                held.setdefault(lang, []).append(array)
                rows += len(array)
                if rows >= most:
                    yield from passed_on()
                    rows = 0
    yield from passed_on()


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _common(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes that each string but the first has in common with the one before it, from their beginnings on."""
    most = np.minimum(size[:-1], size[1:])
    a, b, out = start[:-1], start[1:], np.zeros(len(most), dtype=np.int64)
    alive, at = np.flatnonzero(most > 0), 0
    while len(alive) and at < 256:
        alive = alive[data[a[alive] + at] == data[b[alive] + at]]
        at += 1
        out[alive] = at
        alive = alive[most[alive] > at]
    for i in alive:  # long words
        other = data[a[i] : a[i] + most[i]] != data[b[i] : b[i] + most[i]]
        out[i] = other.argmax() if other.any() else most[i]
    return out


class _Stack:
    """Counts the prefixes of two words or more of suffixes in descending order: of every length one counter is open, that of
    the last suffix's prefix, and it is closed by the first suffix that begins otherwise."""

    def __init__(self, max_n: int, least: int, hot: frozenset[bytes]) -> None:
        self.max_n, self.least, self.hot = max_n, least, hot
        self.last, self.words, self.open = b"", 0, [0] * (max_n + 1)
        self.keys: list[bytes] = []
        self.counts: list[int] = []

    def _closed(self, s: bytes, k: int, count: int) -> None:
        at = s.rindex(b"\t")
        for _ in range(k):
            at = s.index(b" ", at + 1)
        self.keys.append(s[: at + 1])
        self.counts.append(int(count))

    def _is_hot(self, s: bytes) -> bool:
        return s[: s.index(b" ", s.rindex(b"\t")) + 1] in self.hot

    def end(self, common: int = 0) -> None:
        """Closes the counters of prefixes of more than ``common`` words."""
        for k in range(max(2, common + 1), self.words + 1):
            if self.open[k] >= self.least or (k == 2 and self._is_hot(self.last)):
                self._closed(self.last, k, self.open[k])
            self.open[k] = 0

    def push(self, strings: pa.Array, counts: np.ndarray) -> None:
        """A block of suffixes, not empty. The counters' sums over the block come from the places where prefixes change."""
        _, offsets, buffer = strings.buffers()
        edge = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
        data = np.frombuffer(buffer, np.uint8)[: edge[-1]]
        start, size = edge[:-1], np.diff(edge)
        spaces = np.concatenate([[0], np.cumsum(data == 32)])
        tabs = np.flatnonzero(data == 9)
        tab = tabs[np.searchsorted(tabs, edge[1:]) - 1]  # the last one: a language may hold tabs, words don't
        before = spaces[tab]
        words = spaces[edge[1:]] - before
        same = np.concatenate([[0], np.maximum(0, spaces[start[1:] + _common(data, start, size)] - before[1:])])
        same[1:][np.diff(tab - start) != 0] = 0
        text = lambda i: data[edge[i] : edge[i + 1]].tobytes()
        first = text(0)
        if self.last:
            both = pa.array([self.last, first], pa.binary())
            e = np.frombuffer(both.buffers()[1], np.int32)[:3].astype(np.int64)
            d = np.frombuffer(both.buffers()[2], np.uint8)
            shared = d[e[1] : e[1] + _common(d, e[:-1], np.diff(e))[0]].tobytes()
            if self.last.rindex(b"\t") == first.rindex(b"\t") < len(shared):
                same[0] = shared.count(b" ", first.rindex(b"\t"))
        self.end(int(same[0]))
        begins = np.flatnonzero(same < 1)
        hot = np.zeros(len(begins) + 1, dtype=bool)
        hot[0] = bool(self.last) and self._is_hot(self.last)
        hot[1:] = [self._is_hot(text(i)) for i in begins] if self.hot else False
        for k in range(2, self.max_n + 1):
            new = np.flatnonzero(same < k)
            if not len(new):
                self.open[k] += int(counts.sum())
                continue
            self.open[k] += int(counts[: new[0]].sum())
            if new[0] > 0 and self.words >= k:  # the open prefix ends inside this block
                if self.open[k] >= self.least or (k == 2 and hot[0]):
                    self._closed(self.last, k, self.open[k])
            sums = np.add.reduceat(counts, new)
            told = (words[new[:-1]] >= k) & (sums[:-1] >= self.least)
            if k == 2 and hot.any():
                told |= (words[new[:-1]] >= 2) & hot[np.searchsorted(begins, new[:-1], side="right")]
            for i, c in zip(new[:-1][told], sums[:-1][told], strict=True):
                self._closed(text(i), k, c)
            self.open[k] = int(sums[-1])
        self.last, self.words = text(len(strings) - 1), int(words[-1])

    def found(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([_strings(self.keys), pa.array(self.counts, pa.int64())], ["s", "c"])
        self.keys, self.counts = [], []
        return out


def _prefixes(batches: Iterator[pa.RecordBatch], max_n: int, least: int, hot: frozenset[bytes], block: int) -> Iterator[pa.RecordBatch]:
    """(s, c) of the prefixes, of two words or more, of suffixes in descending order. Those met ``least`` times are passed on; of
    the suffixes of a hot first word others may hold more of the same pair, so their pairs are passed on in any case."""
    stack, waiting, rows = _Stack(max_n, least, hot), [], 0

    def pushed() -> None:
        table = pa.Table.from_batches(waiting).combine_chunks()
        for part in table.to_batches():
            if part.num_rows:
                stack.push(part.column(0).cast(pa.binary()), part.column(1).to_numpy())
        waiting.clear()

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= block:
                pushed()
                rows = 0
                yield stack.found()
    if waiting:
        pushed()
    stack.end()
    yield stack.found()


def _named(counted: DataFrame) -> DataFrame:
    """(lang, phrase, words, c) of (s, c)."""
    lang = F.regexp_extract("s", r"(?s)^(.*)\t", 1)  # a language may hold tabs, words don't
    rows = counted.select(lang.alias("lang"), F.expr("substr(s, 1 + length(regexp_extract(s, '(?s)^(.*\\\\t)', 1)))").alias("p"), "c")
    rows = rows.withColumn("p", F.expr("substr(p, 1, length(p) - 1)"))
    return rows.select("lang", F.col("p").alias("phrase"), F.split("p", " ").alias("words"), "c")


def phrase_counts(docs: DataFrame, least: int = 100, max_n: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, phrase, words, c)): the word occurrences of each language, and all phrases of 1 to ``max_n`` words that
    occur ``least`` times in it or more. A NULL text is empty, a NULL language ``und``.

    The words are counted first. They tell which first words are hot: the suffixes of these are dealt out by their first three
    words, all others by the first one. A count is then whole in one task, but for the pairs of hot words, which are added up.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held, made, block = HELD, MADE, BLOCK
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = lambda n: rows.mapInArrow(lambda batches: _counted(batches, n, held, made), _COUNTED)
    words = staged(counted(1).groupBy("s").agg(F.sum("c").alias("c")), "words")
    total = words.agg(F.sum("c")).first()[0] or 0
    hot = [r[0] for r in words.where(F.col("c") * HOT > F.lit(total)).select("s").collect()]  # fewer than HOT words
    suffixes = counted(max_n)
    first = F.substring_index(F.substring_index("s", "\t", -1), " ", 1)
    lang = F.expr("substr(s, 1, length(s) - length(substring_index(s, '\t', -1)))")
    key = F.when(F.concat(lang, first, F.lit(" ")).isin(hot), F.substring_index(F.substring_index("s", "\t", -1), " ", 3)).otherwise(first) if hot else first
    dealt = suffixes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), lang, key).sortWithinPartitions(F.desc("s"))
    marked = frozenset(h.encode() for h in hot)
    found = dealt.mapInArrow(lambda batches: _prefixes(batches, max_n, least, marked, block), _COUNTED)
    found = found.groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    counts = staged(_named(found.unionByName(words.where(F.col("c") >= least))), "phrases")
    sizes = words.groupBy(F.regexp_extract("s", r"(?s)^(.*)\t", 1).alias("lang")).agg(F.sum("c").alias("n"))
    return sizes, counts


def collocations(docs: DataFrame, least: int = 100, max_n: int = 5, top: int = 2000, covered: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``max_n`` words by score, then a, then
    phrase in byte order.

    a counts the phrase, l and r the two parts of its cut, n the language's words; score is floor(1000 a n / (l r)) of the
    cut with the lowest score, the first of equal ones, in exact decimals. A phrase that lies inside a longer one with
    ``covered`` percent of its count or more is left out. A language without words, and an empty table, give no rows. Rows
    that repeat count each time; other columns of ``docs`` take no part.
    """
    sizes, counts = phrase_counts(docs, least, max_n, lang_col, text_col)
    size = F.size("words")
    longer = counts.where(size > 2)
    inside = longer.select("lang", "c", F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))))")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("c").alias("within"))
    kept = counts.where(size > 1).join(inside, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < covered * F.col("c")))
    cuts = kept.select("lang", "phrase", F.col("c").alias("a"), F.explode(F.expr("transform(sequence(1, size(words) - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') as left, array_join(slice(words, k + 1, size(words)), ' ') as right))")).alias("cut"))
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("c").alias(name))
    cuts = cuts.select("lang", "phrase", "a", "cut.*").join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(sizes, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    # 38 digits hold 1000 a n and l r up to 10^17 occurrences; div cuts off what is behind the point
    cuts = cuts.withColumn("top", (whole("a") * 1000 * whole("n")).cast("decimal(38,0)")).withColumn("bottom", (whole("l") * whole("r")).cast("decimal(38,0)")).withColumn("score", F.expr("top div bottom"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))
