"""Personal data: patterns, and terms that give protected entities away, by information-theoretic sanitisation.

The patterns find e-mail and IP addresses, card and phone numbers; each distinct value is a protected entity. The words
near an entity are its contexts; equal contexts count once, so that copies of a text are no new evidence. From the
contexts and the corpus's document counts follows how much a term says about an entity, as pointwise mutual
information; a term that says more than ``1 / ALPHA`` of the entity's information content discloses it, if it doesn't
stand there by chance. Rare words stand in every text: how many as rare as a term, and written like it, may be expected
near the entity follows from the part of the corpus's words that are. In the documents with that entity a disclosing
term is generalised, or removed if it says everything.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free_names, set_aside, staged

#: The kinds in the order in which spans of one start stand, with patterns. They find what the plain patterns do
#: (see the README), without trying a start inside a run or a shorter match again.
KINDS = ("email", "ip", "card", "phone", "term", "removed")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters on either side of an entity that make its context.
WINDOW = 64
#: Terms of an entity's contexts that may be expected there by chance, of those as rare as one that counts; and the
#: part of an entity's information content that a term may say.
CHANCE, ALPHA = 0.05, 1.25
#: Words that can be terms, and those written like names: with a capital, though not at the start of a sentence.
WORD, NAME = r"[\p{L}\p{N}]{2,}", r"\p{Lu}(?<=[\p{Ll}\p{N},;] .)[\p{L}\p{N}]++"
#: Letters from which on a word can be a term however it is written; shorter ones must be written like names.
SHORT = 4
#: Words in more documents than this count as this common.
COMMON = 4096
#: Elements of an array, and code points of a text, that are gone through at once.
BLOCK, CHUNK = 256, 512
#: Texts with disclosing terms are broadcast if these have up to so many bytes.
BROADCAST_BYTES = 16 << 20
#: Replacements of the kinds; a generalised term becomes the class that its form tells, a removed one goes.
REPLACEMENTS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}
CLASSES = ((r"^[\p{N}]+$", "[NUMBER]"), (r"[\p{N}]", "[CODE]"), (r"^\p{Lu}", "[NAME]"))
_ONE = "struct<start: int, rank: int, end: int, value: string>"
_SPAN = f"array<{_ONE}>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(x)).between(14, 19) & F.expr("true").eqNullSafe(F.call_function("luhn_check", _digits(x)))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _scanned(items: Column, add: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column], show: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``show`` makes of each item and of what ``add`` made of those before it, starting from 0; ``join`` does what ``add``
    does with the sum of a block. A fold that appends to an array copies it each time, so it is done by blocks."""
    none = F.array().cast(f"array<{kind}>")

    def inside(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(join(F.element_at(a, -1), t))))
        zipped = F.arrays_zip(blocks.alias("b"), F.slice(starts, 1, F.size(blocks)).alias("s"))
        one = lambda z: F.aggregate(
            z["b"], F.struct(z["s"].alias("at"), none.alias("all")), lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(show(acc["at"], x))).alias("all")), lambda acc: acc["all"]
        )
        return F.flatten(F.transform(zipped, one))

    numbers = lambda all_: F.sequence(F.lit(0), ((F.size(all_) - 1) / BLOCK).cast("int"))
    return _let(items, lambda all_: F.when(F.size(all_) > 0, _let(F.transform(numbers(all_), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK))), inside)).otherwise(none))


def _chunks(text: Column) -> Column:
    """A text in pieces, from which ``_cut`` takes parts without going through all of it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    first = (start / CHUNK).cast("int")
    some = F.slice(chunks, first + 1, ((end - 1) / CHUNK).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(some, ""), start % CHUNK + 1, end - start)).otherwise("")


def _placed(text: Column, pattern: str, rank: Callable[[Column], Column]) -> Column:
    """The matches of a pattern as spans in code points, with the rank that their values have, or without those that have none:
    what lies between the matches gives their places."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    add = lambda at, p: at + size(p["gap"]) + size(p["value"])

    def show(at: Column, p: Column) -> Column:
        start = at + size(p["gap"])
        return F.struct(start.alias("start"), rank(p["value"]).alias("rank"), (start + size(p["value"])).alias("end"), p["value"].alias("value"))

    return F.filter(_scanned(pairs, add, lambda a, b: a + b, show, _ONE), lambda s: s["value"].isNotNull() & s["rank"].isNotNull())


def pattern_spans(text: Column, kind: str) -> Column:
    """The valid matches of a kind, as spans in code points."""
    needed = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9]"), "phone": text.contains("+")}[kind]
    return F.when(needed, _placed(text, PATTERNS[kind], lambda v: F.when(_valid(kind, v), F.lit(KINDS.index(kind))))).otherwise(F.array().cast(_SPAN))


def with_base_spans(docs: DataFrame, text_col: str = "text", into: str = "base") -> DataFrame:
    """``docs`` with the array of all base spans, by start and then kind. A null text has none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.array_sort(F.concat(*(pattern_spans(text, k) for k in PATTERNS)))
    return docs.withColumn(into, F.when(text.rlike(r"[0-9]|@"), found).otherwise(F.array().cast(_SPAN)))


def _terms(text: Column) -> Column:
    """Words of two letters or digits or more, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _contexts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, entity, terms) of every base span: the text's hash, the document, and the words nearby."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    holding = with_base_spans(texts).where(F.size("base") > 0)
    at = lambda c, s: F.struct(_entity(s).alias("entity"), _cut(c, F.greatest(s["start"] - WINDOW, F.lit(0)), s["start"]).alias("left"), _cut(c, s["end"], s["end"] + WINDOW).alias("right"))
    near = _let(_chunks(F.col("text")), lambda c: F.transform("base", lambda s: at(c, s)))
    # a context's outer words may be cut, and are left out
    cut = lambda side, pattern: F.when(F.length(side) == WINDOW, F.regexp_replace(side, pattern, "")).otherwise(F.col(side))
    words = F.concat(cut("n.left", r"^[^\s]*\s"), F.lit(" "), cut("n.right", r"\s[^\s]*$"))
    each = holding.select("id", F.xxhash64("text").alias("key"), near.alias("near"))  # no text in the rows of its spans
    found = each.select("id", "key", F.explode("near").alias("n"))
    return staged(found.select("key", "id", "n.entity", F.array_distinct(_terms(words)).alias("terms")), "contexts")


def _entity(s: Column) -> Column:
    return F.concat(s["rank"].cast("string"), F.lit(":"), F.lower(s["value"]))


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chance: float = CHANCE, alpha: float = ALPHA) -> DataFrame:
    """(entity, term, contexts, pmi, ic): the terms that say at least ``1 / alpha`` of an entity's information content.

    An entity is a kind and a value. Documents without an id or text are left out; rows that repeat an id count as one
    document. A term is written like a name if it is, in most of its documents, with a capital inside a sentence. Of the
    words of the corpus, each counted once a document, let r be those written like the term and in as many documents or
    fewer, as a part of all. By chance, of ``near`` terms near the entity, near * r are such words, and near * r *
    (dt / n) ** (contexts - 1) stand in all its ``contexts``, of dt of n documents with the term; that must be at most
    ``chance``. So a word that occurs once is no evidence in a corpus that is full of such words. Words of fewer than
    ``SHORT`` letters or digits count only if they are written like names.
    """
    return _disclosing(docs, _contexts(docs, id_col, text_col), id_col, text_col, chance, alpha)


def _counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, dt, named): the documents with a term, and whether it is written like a name in most of them."""
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    words = lambda t: F.array_distinct(_terms(t))
    names = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(NAME), F.lit(0)), F.lower))
    each = lambda rows: rows.select("id", F.explode(words(F.col("text"))).alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c")).unionByName(rows.select("id", F.explode(names(F.col("text"))).alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c")))
    again = staged(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    if again.isEmpty():
        rows = each(texts)
    else:  # rows that repeat an id count once
        twice = each(texts.join(again, "id", "left_semi")).groupBy("id", "term").agg(F.max("d").alias("d"), F.max("c").alias("c"))
        rows = each(texts.join(again, "id", "left_anti")).unionByName(twice)
    counted = rows.groupBy("term").agg(F.sum("d").alias("dt"), F.sum("c").alias("c"))
    return counted.where("dt > 0").select("term", "dt", (2 * F.col("c") > F.col("dt")).alias("named"))


def _disclosing(docs: DataFrame, contexts: DataFrame, id_col: str, text_col: str, chance: float, alpha: float) -> DataFrame:
    contexts = contexts.where("id is not null")
    each = contexts.select("id", "entity", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term"))
    pairs = each.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("id").alias("both"))
    near = pairs.groupBy("entity").agg(F.count("*").alias("near"))
    entities = staged(contexts.groupBy("entity").agg(F.countDistinct("id").alias("de")).join(near, "entity"), "entities")
    # At least the documents in whose contexts a term stands have it, which bounds what it can say.
    seen = contexts.select("id", F.explode("terms").alias("term")).groupBy("term").agg(F.countDistinct("id").alias("least_dt"))
    total = float(max(docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().count(), 1))
    ic = F.log2(F.lit(total) / F.col("de"))
    at_most = F.log2(F.col("both") * F.lit(total) / (F.col("least_dt") * F.col("de")))
    pairs = staged(pairs.join(entities, "entity").join(seen, "term").where((ic > 0) & (at_most >= ic / alpha)).drop("least_dt"), "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", "contexts", F.lit(0.0).alias("pmi"), F.lit(0.0).alias("ic"))
    counts = staged(_counts(docs, id_col, text_col), "counts")
    rare = F.least("dt", F.lit(COMMON)).alias("rare")
    held = counts.groupBy("named", rare).agg(F.sum("dt").alias("held"))  # at most 2 * COMMON rows
    run = F.sum("held").over(Window.partitionBy("named").orderBy("rare").rowsBetween(Window.unboundedPreceding, 0))
    parts = held.select("named", "rare", run.alias("run"), F.sum("held").over(Window.partitionBy()).alias("all")).select("named", "rare", (F.col("run") / F.col("all")).alias("part"))
    known = pairs.join(counts.withColumn("rare", rare), "term").join(F.broadcast(parts), ["named", "rare"])
    expected = F.col("near") * F.col("part") * F.pow(F.col("dt") / F.lit(total), F.col("contexts") - 1)
    pmi = F.log2(F.col("both") * F.lit(total) / (F.col("dt") * F.col("de")))
    long_enough = (F.length("term") >= SHORT) | F.col("named")
    said = known.where((expected <= chance) & long_enough).select("entity", "term", "contexts", pmi.alias("pmi"), ic.alias("ic"))
    return staged(said.where(F.col("pmi") >= F.col("ic") / alpha), "disclosing")


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """The places of ``terms`` (structs of term and all) in a text, but those that a base span covers in part or whole."""
    removed = F.transform(F.filter(terms, lambda t: t["all"]), lambda t: t["term"])
    general = F.transform(F.filter(terms, lambda t: ~t["all"]), lambda t: t["term"])
    rank = lambda t, v: F.when(F.array_contains(t["removed"], F.lower(v)), F.lit(KINDS.index("removed"))).when(F.array_contains(t["general"], F.lower(v)), F.lit(KINDS.index("term")))
    first = KINDS.index("term")

    def free(all_: Column) -> Column:
        # a span of the text begins in a base span if one before it ends later, and reaches into one if that is next
        ends = _scanned(all_, lambda at, s: F.when(s["rank"] < first, F.greatest(at, s["end"])).otherwise(at), lambda a, b: F.greatest(a, b), lambda at, s: at, "int")
        zipped = F.arrays_zip(all_.alias("s"), ends.alias("covered"), F.slice(all_, 2, F.size(all_)).alias("after"))
        kept = F.filter(zipped, lambda z: z["s"].isNotNull() & (z["s"]["rank"] >= first) & (z["covered"] <= z["s"]["start"]) & (z["after"].isNull() | (z["after"]["start"] >= z["s"]["end"])))
        return F.transform(kept, lambda z: z["s"])

    found = _let(F.struct(removed.alias("removed"), general.alias("general")), lambda t: _placed(text, WORD, lambda v: rank(t, v)))
    return _let(F.array_sort(F.concat(base, found)), free)


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chance: float = CHANCE, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: the base spans, and all spans, each by start and then kind.

    Spans are structs of start, rank (the kind's place in ``KINDS``), end and value, in code points, the end exclusive. A
    null text counts as empty. Rows that repeat are dealt with each, those without an id too; an empty table stays
    empty. Columns named ``base`` and ``spans`` are replaced, all others stay.
    """
    contexts = _contexts(docs, id_col, text_col)
    said = _disclosing(docs, contexts, id_col, text_col, chance, alpha)
    rows = with_base_spans(docs.drop("base", "spans"), text_col, "base")
    if said.limit(1).count() == 0:
        return rows.withColumn("spans", F.col("base"))
    key, terms = free_names(rows, "key", "terms")
    term = F.struct("term", (F.col("pmi") >= F.col("ic") - 1e-9).alias("all"))
    affected = contexts.select("key", "entity").distinct().join(said, "entity").groupBy(F.col("key").alias(key)).agg(F.collect_set(term).alias(terms))
    affected = staged(affected, "affected")
    if (affected.agg(F.sum(F.octet_length(F.to_json(terms)) + 8)).first()[0] or 0) <= BROADCAST_BYTES:
        affected = F.broadcast(affected)
    text = F.col(text_col).cast("string")
    rows = rows.withColumn(key, F.xxhash64(text)).join(affected, key, "left")
    spans = F.when(F.col(terms).isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", _term_spans(text, F.col(terms), F.col("base")))))
    return rows.withColumn("spans", spans).drop(key, terms)


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _class(value: Column) -> Column:
    """What a generalised term becomes: a number, a code with digits, a name (by its capital letter), or any other term."""
    out = F.lit(REPLACEMENTS["term"])
    for pattern, name in reversed(CLASSES):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text's spans replaced: patterns by ``REPLACEMENTS``, generalised terms by their class, removed terms by
    nothing; of overlapping spans the first is replaced up to the end of the last. A null text stays null. Other
    columns are untouched; rows are those of ``with_spans``."""
    own, names = set_aside(docs, "base", "spans")
    rows = with_spans(own, id_col, text_col)
    put = F.array(*(F.lit(REPLACEMENTS[k]) for k in KINDS))
    text = F.col(text_col).cast("string")
    new = lambda s: F.when(s["rank"] == KINDS.index("term"), _class(s["value"])).otherwise(F.element_at(put, s["rank"] + 1))

    def cleaned(chunks: Column) -> Column:
        # each span with where the last one before it ends
        step = _scanned(F.col("spans"), lambda at, s: F.greatest(at, s["end"]), lambda a, b: F.greatest(a, b), lambda at, s: F.struct(at.alias("at"), s.alias("s")), f"struct<at: int, s: {_ONE}>")
        parts = F.transform(F.filter(step, lambda x: x["s"]["start"] >= x["at"]), lambda x: F.concat(_cut(chunks, x["at"], x["s"]["start"]), new(x["s"])))
        return F.concat(F.array_join(parts, ""), _cut(chunks, F.array_max(F.transform("spans", lambda s: s["end"])), F.length(text)))

    clean = _let(_chunks(text), cleaned)
    rows = rows.withColumn(text_col, F.when(F.size("spans") == 0, text).otherwise(clean)).drop("base", "spans")
    return rows.withColumnsRenamed(names).select(docs.columns)
