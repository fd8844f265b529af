"""Language identification by Bayesian evidence fusion.

Four sources of evidence meet for each row: the likelihood of the text under byte-trigram models of the languages, the
language that its markup declares, the suffix of its address, and the language habits of its host. A host's prior is
smoothed towards that of its suffix, which is smoothed towards that of the whole table; how far a declaration is to be
trusted is measured in the same grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_names, small_batches, staged
from .textarrays import give_back, lean, pieces

#: Rows that a Python worker gets at a time, so that what it holds doesn't grow with the table.
BATCH_ROWS = 1_000
#: Byte classes of the trigrams: a-z, everything but letters, and the bytes of other alphabets folded into the rest.
_CODES = 64
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27 + np.arange(128) % 37
#: Trigrams overlap, so each counts as this part of an independent observation.
TEMPER = 1 / 3
#: Rows that a prior of the level above is worth.
SMOOTHING = 20.0
#: Host tables of up to so many rows are broadcast; larger ones are joined in ``SALTS`` parts a host.
BROADCAST_HOSTS, SALTS = 50_000, 16
#: Where markup declares a language: the html tag's lang or xml:lang, or a meta tag's content language. No tag is longer
#: than the next angle bracket, so that a text is read once.
HTML_TAG, LANG = r"(?i)<html\b[^<>]*+", r"(?i)[\s:]lang\s*=\s*[\"']?\s*([a-z]+)"
META_TAG, CONTENT = r"(?i)<meta\b(?=[^<>]*?http-equiv\s*=\s*[\"']?\s*content-language)[^<>]*+", r"(?i)\scontent\s*=\s*[\"']?\s*([a-z]+)"
#: Codes of three letters whose language has one of two letters (fixed values of ISO 639).
THREE_LETTERS = {
    "ara": "ar", "bul": "bg", "ces": "cs", "cze": "cs", "chi": "zh", "zho": "zh", "dan": "da", "deu": "de", "ger": "de", "dut": "nl", "nld": "nl", "ell": "el", "gre": "el",
    "eng": "en", "est": "et", "fin": "fi", "fra": "fr", "fre": "fr", "heb": "he", "hin": "hi", "hrv": "hr", "hun": "hu", "ind": "id", "ita": "it", "jpn": "ja", "kor": "ko",
    "lav": "lv", "lit": "lt", "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "slk": "sk", "slo": "sk", "slv": "sl", "spa": "es", "swe": "sv",
    "tur": "tr", "ukr": "uk", "vie": "vi",
}


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of byte trigrams, one row a language."""

    languages: tuple[str, ...]
    table: np.ndarray


def _trigrams(body: np.ndarray) -> np.ndarray:
    """The trigram that starts at each byte but the last two. Capital letters with an accent count as small ones."""
    if len(body) < 3:
        return np.zeros(0, np.intp)
    b = body.copy()
    b[1:] += np.uint8(0x20) * ((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97))
    c = _CODE[b]
    return ((c[:-2] * np.uint32(_CODES) + c[1:-1]) * np.uint32(_CODES) + c[2:]).astype(np.intp)


def train_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Models of the languages that ``lang_col`` names, from all labelled rows.

    Rows without text or label are left out. The table of counts has at most 64 ** 3 rows a language.
    """
    small_batches(docs.sparkSession, BATCH_ROWS)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for row, end, body, off in pieces(batch.column(1)):
                found: dict[str, list[np.ndarray]] = {}
                for k in range(row, end):
                    found.setdefault(langs[k], []).append(_trigrams(body[off[k - row] : off[k - row + 1]]))
                for lang, grams in found.items():
                    if lang not in total:
                        total[lang] = np.zeros(_CODES**3, np.int64)
                    total[lang] += np.bincount(np.concatenate(grams), minlength=_CODES**3)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

    found = rows.mapInArrow(lean(counts), "lang string, gram int, n long")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    table = np.full((max(1, len(languages)), _CODES**3), 0.1)
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        table[k, own["gram"].to_numpy(np.intp)] += own["n"].to_numpy(np.float64)
    return LanguageModel(languages or ("und",), np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _likelihoods(docs: DataFrame, model: LanguageModel, text: str) -> Column:
    """For each row's text the tempered log likelihood of each language, the best one's being 0; null without letters."""
    small_batches(docs.sparkSession, BATCH_ROWS)
    table = docs.sparkSession.sparkContext.broadcast(model.table)

    def each(column: pa.Array) -> pa.Array:
        t = table.value
        out = np.zeros((len(column), len(t)))
        none = np.ones(len(column), bool)
        for row, end, body, off in pieces(column):
            grams = _trigrams(body)
            a, z = off[:-1], np.maximum(off[:-1], off[1:] - 2)
            full = np.flatnonzero(z > a)
            letters = np.concatenate([[0], np.cumsum(_CODE[body] > 0)])
            none[row:end] = letters[off[1:]] == letters[off[:-1]]
            for k in range(len(t)):
                total = np.concatenate([[0.0], np.cumsum(t[k][grams], dtype=np.float64)])
                out[row + full, k] = total[z[full]] - total[a[full]]
            del grams, letters
        give_back()
        out = (out - out.max(axis=1, keepdims=True)) * TEMPER
        off = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(off), pa.array(out.ravel()), mask=pa.array(none)) if len(out) else pa.array([], pa.list_(pa.float64()))

    from pyspark.sql.functions import arrow_udf

    return arrow_udf(each, "array<double>")(F.col(text))


def _softmax(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(F.greatest(x - F.array_max(logs), F.lit(-700.0))))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", host: Column | None = None, suffix: Column | None = None, declared: Column | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with ``language``, ``confidence`` (posterior probability), ``evidence`` (its posterior without text) and
    ``accepted`` (the text has letters, and the confidence reaches ``least``).

    ``host``, ``suffix`` and ``declared`` are columns of ``docs``; each may be null in any row, which then has no such
    evidence. Null and empty texts and those without a letter are judged by the other evidence and never accepted. Ties
    go to the language first by name. Rows that repeat are judged each; an empty table stays empty. Columns named like
    the four new ones are replaced.
    """
    langs = model.languages
    n = len(langs)
    none = F.lit(None).cast("string")
    names = F.array(*map(F.lit, langs))
    rows = docs.drop("language", "confidence", "evidence", "accepted")
    host_, suffix_, declared_, ll_, salt_, prior_, fused_, all_ = free_names(rows, "host", "suffix", "declared", "ll", "salt", "prior", "fused", "all")
    slim = lambda c: F.lower(F.trim(c.cast("string"))) if c is not None else none
    rows = rows.withColumns({host_: F.coalesce(slim(host), F.lit("")), suffix_: F.coalesce(slim(suffix), F.lit("")), declared_: _two_letters(slim(declared)), ll_: _likelihoods(docs, model, text_col)})

    sure = rows.where(F.col(ll_).isNotNull()).select(host_, suffix_, declared_, _softmax(F.col(ll_)).alias("p"))
    stated = F.col(declared_).isNotNull() & F.array_contains(names, F.col(declared_))
    agreed = F.when(stated, F.element_at("p", F.array_position(names, F.col(declared_)).cast("int")))
    by_host = staged(sure.groupBy(host_, suffix_).agg(F.count(agreed).alias("stated"), F.sum(agreed).alias("agreed"), *(F.sum(F.col("p")[k]).alias(f"n{k}") for k in range(n))), "hosts")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(n)]
    whole = by_host.agg(F.sum("stated").alias("stated"), F.sum("agreed").alias("agreed"), *sums).first()
    count = [float(whole[f"n{k}"] or 0) for k in range(n)]
    top = [(c + 1) / (sum(count) + n) for c in count]
    trust = ((whole["agreed"] or 0.0) + 9.0) / ((whole["stated"] or 0) + 10.0)

    def smoothed(names_: list[str], above: list[Column]) -> list[Column]:
        total = sum((F.col(c) for c in names_), F.lit(0.0))
        return [(F.col(c) + F.lit(SMOOTHING) * a) / (total + SMOOTHING) for c, a in zip(names_, above, strict=True)]

    suffixes = by_host.where(F.col(suffix_) != "").groupBy(suffix_).agg(*(F.sum(f"n{k}").alias(f"s{k}") for k in range(n)))
    suffixes = suffixes.select(suffix_, *(p.alias(f"q{k}") for k, p in enumerate(smoothed([f"s{k}" for k in range(n)], [F.lit(t) for t in top]))))
    above = [F.coalesce(F.col(f"q{k}"), F.lit(t)) for k, t in enumerate(top)]
    hosts = by_host.where((F.col(host_) != "") | (F.col(suffix_) != "")).join(suffixes, suffix_, "left")
    own = [F.when(F.col(host_) == "", a).otherwise(p) for a, p in zip(above, smoothed([f"n{k}" for k in range(n)], above), strict=True)]
    hosts = staged(hosts.select(host_, suffix_, F.array(*own).alias(prior_)), "host-priors")
    if hosts.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(hosts), [host_, suffix_], "left")
    else:
        parts = hosts.withColumn(salt_, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt_, F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int")).join(parts, [host_, suffix_, salt_], "left")

    prior = F.coalesce(prior_, F.array(*map(F.lit, top)))
    off = (1 - trust) / max(1, n - 1)
    stated = F.col(declared_).isNotNull() & F.array_contains(names, F.col(declared_))
    fused = F.zip_with(prior, names, lambda p, l: F.log(p) + F.when(stated, F.when(l == F.col(declared_), F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log(max(off, 1e-9)))))).otherwise(0.0))
    rows = rows.withColumn(fused_, fused)
    rows = rows.withColumn("evidence", _softmax(F.col(fused_))).withColumn(all_, F.when(F.col(ll_).isNull(), F.col("evidence")).otherwise(_softmax(F.zip_with(fused_, ll_, lambda a, b: a + b))))
    rows = rows.withColumn("confidence", F.array_max(all_))
    rows = rows.withColumn("language", F.element_at(names, F.array_position(all_, F.col("confidence")).cast("int")))
    rows = rows.withColumn("evidence", F.element_at("evidence", F.array_position(all_, F.col("confidence")).cast("int")))
    rows = rows.withColumn("accepted", F.col(ll_).isNotNull() & (F.col("confidence") >= least))
    return rows.drop(host_, suffix_, declared_, ll_, salt_, prior_, fused_, all_)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; null without one."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    found = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    return F.when(found != "", found)


def _two_letters(code: Column) -> Column:
    """The language of a code without region and script, of two letters if it has such a code."""
    first = F.regexp_extract(code, "^[a-z]+", 0)
    known = F.create_map(*(F.lit(x) for pair in THREE_LETTERS.items() for x in pair))
    return F.when(first != "", F.coalesce(known[first], first))


def declared_in(markup: Column) -> Column:
    """The language code that markup declares, of whatever length, wherever in the text; null where there is none."""
    own = F.regexp_extract(F.regexp_extract(markup, HTML_TAG, 0), LANG, 1)
    meta = F.regexp_extract(F.regexp_extract(markup, META_TAG, 0), CONTENT, 1)
    found = F.lower(F.when(own != "", own).otherwise(meta))
    return F.when(found != "", found)
