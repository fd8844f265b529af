"""The operators on small fixtures, against brute force, round trips or held-out accuracy, with the odd cases of each."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import random
import re
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallyframe.llm import decontaminate, html_text, jaccard_join, language_id, packing, pii, quality, rangecoder, token_files, tokens, topk, warc_zip

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, span string, terms string, key string"
WORDS = "the quick brown fox jumps over lazy dog while seven wizards quietly mix potions under pale moonlight near old stone bridges beyond green hills".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "er", "ing"]) for _ in range(n))


def frame(spark, rows):
    """Documents with further columns whose names clash with what the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "y", "z", "k") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "   "), (4, "word"), (5, "w" * 300_000), (5, "w" * 300_000), (None, "an old friend without any number"), (6, "a b c d e f"), (7, "a b c d e f")]


# --- tokens, files, packing ---


def test_memoised_ids_equal_the_library():
    rng = random.Random(3)
    enc = tokens.Encoder(tokens.vocabulary())
    bits = ["a", "Bc", "é", "×", "÷", "ß", "œ", "Жд", "1", ".", "!", " ", "  ", "\n", "\n\n", "'s", "'", "\t", "\r\n", "\x0b", "漢", "_", "\u00a0", "\u2003", "“", "\x1d", "\x85", "\U0001f600", "λ", "\x7f", "w" * 300, "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    for _ in range(2):
        assert enc.encode([t.encode() for t in texts]) == [x.tobytes() for x in enc.whole(texts)]


def test_more_stretches_than_are_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    rng = random.Random(4)
    enc = tokens.Encoder(tokens.vocabulary())
    for _ in range(5):
        texts = [prose(rng, 40) for _ in range(20)]
        assert enc.encode([t.encode() for t in texts]) == [x.tobytes() for x in enc.whole(texts)]


@pytest.mark.parametrize("kind", ["skewed", "uniform", "constant", "cyclic", "short"])
def test_coder_round_trip_and_independent_blocks(kind):
    rng = np.random.default_rng(0)
    ids = {
        "skewed": lambda: rng.zipf(1.4, 20_000).clip(0, 50_000),
        "uniform": lambda: rng.integers(0, 1 << 16, 9_000),
        "constant": lambda: np.full(5_000, 65_535),
        "cyclic": lambda: np.arange(5_000) % 7,
        "short": lambda: np.array([3]),
    }[kind]().astype("<u2")
    coded = rangecoder.encode(ids)
    sizes = [min(rangecoder.BLOCK, len(ids) - k) for k in range(0, len(ids), rangecoder.BLOCK)]
    assert (rangecoder.decode(coded, sizes) == ids).all()
    if kind != "uniform":
        assert sum(map(len, coded)) < 2 * len(ids) + 10
    for k in (0, len(coded) - 1):  # a block decodes alone
        assert (rangecoder.decode(coded[k : k + 1], sizes[k : k + 1]) == ids[k * rangecoder.BLOCK :][: sizes[k]]).all()


def test_token_files_give_back_all_ids(spark):
    rng = random.Random(1)
    rows = [*ODD, *((k, prose(rng, rng.randint(0, 60))) for k in range(10, 60))]
    got = token_files.token_id_files(frame(spark, rows)).orderBy("start").collect()
    enc = tokens.Encoder(tokens.vocabulary())
    want = sorted((-1 if i is None else i, *(lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))(np.append(enc.whole([t or ""])[0], 0))) for i, t in rows)
    assert [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert token_files.token_id_files(frame(spark, rows).where("false")).count() == 0


def test_packing_holds_every_piece_once(spark):
    rng = random.Random(2)
    rows = [*ODD, *((k, prose(rng, rng.randint(0, 900))) for k in range(10, 200))]
    docs = frame(spark, rows).repartition(6)
    got = packing.packed_sequences(packing.document_pieces(docs)).toPandas()
    enc = tokens.Encoder(tokens.vocabulary())
    want = {}
    for i, t in rows:
        ids = np.append(np.frombuffer(enc.whole([t or ""])[0], enc.dtype), 0).astype("<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
            key = (-1 if i is None else i, p, a, z - a, zlib.crc32(ids[a:z].tobytes()))
            want[key] = want.get(key, 0) + 1
    have = got.fillna({"doc_id": -1}).groupby(["doc_id", "piece", "start", "length", "ids_crc32"]).size().to_dict()
    assert {tuple(map(int, k)): v for k, v in have.items()} == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * np.ceil(got.length.sum() / 2048) + 1
    assert packing.packed_sequences(packing.document_pieces(docs.where("false"))).count() == 0


# --- n-gram Jaccard join ---


def sets_of(text, n=5):
    w = [x for x in re.split(r"[\x20\t-\r]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups_by_hand(rows):
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = list(ODD)
    for k in range(10, 40):
        rows.append((k, prose(rng, rng.randint(1, 80))))
    for k in range(40, 140):
        words = rng.choice(rows[9:39])[1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        rows.append((k, " ".join(words).upper() if k % 7 == 0 else " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.ngram_groups(frame(spark, rows).repartition(5)).where("doc_id is not null").collect()}
    assert got == groups_by_hand(rows)
    assert jaccard_join.ngram_groups(frame(spark, rows).where("false")).count() == 0


# --- quality ---


def test_quality_on_held_out_rows_and_odd_ones(spark):
    rng = random.Random(4)
    good = [(k, prose(rng, 40)) for k in range(0, 300)]
    bad = [(k, " ".join(w.upper() + "!!" for w in prose(rng, 40).split())) for k in range(300, 600)]
    docs = frame(spark, [*good, *bad, *((1000 + k if i is not None else None, t) for k, (i, t) in enumerate(ODD))])
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(600) if k % 5] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    rows = quality.quality_scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [(r.doc_id, r.score) for r in rows if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 5 == 0]
    assert np.mean([(s >= 0.3) == (i < 300) for i, s in held]) > 0.97
    none = quality.train_quality(docs, labels.where("false"))
    assert {round(r.score, 6) for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(docs.where("false"), model).count() == 0


# --- language ---


def test_language_fuses_all_evidence(spark):
    rng = random.Random(5)
    vocab = {"en": "the and of that with from this have were their".split(), "de": "der die und nicht eine über für auch werden schön".split(), "fr": "le la les été une avec être pour français dans".split()}
    text = lambda l: " ".join(rng.choice(vocab[l]) for _ in range(30))
    train = spark.createDataFrame([(k, text(l), l) for k, l in enumerate(["en", "de", "fr"] * 40)] + [(None, "x", "en"), (500, None, "en"), (501, "y", None)], "doc_id long, text string, lang string")
    model = language_id.train_languages(train)
    assert model.languages == ("de", "en", "fr")
    pages = [(k, text(l), f"http://a.{l}/x", l, l) for k, l in enumerate(["en", "de", "fr"] * 30)]
    pages += [(900, "123 !!", "http://a.de/1", None, "de"), (901, None, None, "fr", "fr"), (902, "", "nonsense", None, None), (903, None, "http://b.fr/", None, None)]
    df = spark.createDataFrame(pages, "page_id long, html string, url string, declared string, language string")
    host = language_id.host_of(F.col("url"))
    got = {r.page_id: r for r in language_id.identified(df.withColumn("truth", F.col("language")), model, "html", host, language_id.suffix_of(host), F.col("declared")).collect()}
    assert all(r.language == r.truth and r.accepted for i, r in got.items() if i < 900)
    assert got[900].language == "de" and got[901].language == "fr" and not any(got[i].accepted for i in (900, 901, 902, 903))
    assert language_id.identified(df.where("false"), model, "html", host, language_id.suffix_of(host), F.col("declared")).count() == 0


def test_hosts_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    docs = frame(spark, [(k, prose(rng, 10)) for k in range(40)])
    model = language_id.train_languages(docs)
    a = sorted(language_id.identified(docs, model, host=F.col("source")).select("doc_id", F.round("confidence", 9)).collect())
    monkeypatch.setattr(language_id, "BROADCAST_HOSTS", 0)
    assert sorted(language_id.identified(docs, model, host=F.col("source")).select("doc_id", F.round("confidence", 9)).collect()) == a


# --- personal data ---

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(n if k % 2 == 0 else 2 * n - 9 * (n > 4) for k, n in enumerate(map(int, reversed(d)))) % 10 == 0


def spans_by_hand(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    found = [(m.start(), r, f"{k}:{m.start()}:{m.end()}") for r, (k, p) in enumerate(zip(ok, (EMAIL, IP, CARD, PHONE))) for m in p.finditer(text or "") if ok[k](m)]
    return ",".join(s for *_, s in sorted(found))


def test_pattern_spans_equal_the_plain_patterns(spark):
    rng = random.Random(8)
    bits = ["a", "b.c", "@", ".", "1", "4111 1111 1111 1111", "4111-1111-1111-1111", "192.168.0.1", "999.1.1.1", "+1 212 555 0123", "+", "(", ") ", " ", "-", "é", "😀", "x@y.zz", "_", "0", "\n"]
    rows = [*ODD, *((k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for k in range(10, 500)), (501, "1" * 60_000), (502, "a.a" * 30_000 + "@b" + ".c" * 20_000), (503, "+1" + " (" * 30_000)]
    got = pii.with_spans(frame(spark, rows)).select("text", pii.spans_text(F.col("base")).alias("s")).collect()
    assert len(got) == len(rows) and all(r.s == spans_by_hand(r.text) for r in got)


def test_terms_that_disclose_are_found_and_copies_are_no_evidence(spark):
    rng = random.Random(9)
    names = "alpha bravo charlie delta echo foxtrot golf hotel".split()
    rows = [(k, f"{prose(rng, 12)} {n} zorblax wrote to john@corp.com today {prose(rng, 12)}") for k, n in enumerate(names)]
    rows += [(100 + k, f"{n} wrote something today {prose(rng, 20)}") for k, n in enumerate(names * 12)]
    rows += [(300 + k, "copied quibble says mail jane@corp.com now") for k in range(30)]
    docs = frame(spark, rows)
    said = {(r.entity, r.term) for r in pii.disclosing_terms(docs).collect()}
    assert ("0:john@corp.com", "zorblax") in said and not any(t in ("today", "wrote", "quibble") for _, t in said)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).select("doc_id", "text").collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and "wrote to" in clean[0] and clean[100] == rows[8][1] and "quibble" in clean[300]
    assert pii.sanitised(docs).columns == docs.columns and pii.sanitised(docs.where("false")).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = pii.with_spans(frame(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- decontamination ---


def test_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(10)
    # a wide vocabulary, as of real text
    names = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(WORDS) if rng.random() < 0.4 else rng.choice(names) for _ in range(n))
    items = [(k, text(rng.randint(15, 60))) for k in range(25)]
    rows, want = [], {}
    for k in range(200):
        body = text(rng.randint(30, 300))
        if k % 4 == 0:
            item = items[k % 25]
            words = item[1].split()
            if k % 8 == 0:  # a few words are others
                for _ in range(max(1, len(words) // 12)):
                    words[rng.randrange(len(words) - 6)] = rng.choice(names)
            cut = rng.randint(0, len(body.split()))
            body = " ".join([*body.split()[:cut], *(w.upper() + "," for w in words), *body.split()[cut:]])
            want[k] = item[0]
        rows.append((k, body))
    docs = frame(spark, [*rows, *((None if i is None else 900 + i, t) for i, t in ODD)])
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "of the"), (None, "nothing at all in here")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {r.doc_id: r.item_id for r in got} == want
    assert len(got) == len(want)
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_common_weight_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b, idf = rng.integers(1, 6, 9), rng.integers(0, 6, 14), rng.uniform(0.1, 3, 6)
        best = np.zeros((10, 15))
        for i in range(9):
            for j in range(14):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + idf[a[i]] * (a[i] == b[j]))
        assert decontaminate.common_weight(a, b, idf) == pytest.approx(best[-1, -1] / idf[a].sum())


# --- pages ---

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class=wrap><div class="story 42"><h2>Head &amp; line</h2><script>var a="</p>";</script><p>First   <b>par</b>agraph
here &lt;x&gt;.<p>Second one<br>goes on.</p><ul><li>one<li>two</ul><aside>See also</aside><!-- no --><form><p>Mail</p></form></div><div id="comments"><p>Reader says hi there to all of us.</p></div></div>
<footer>&copy; me</footer></body></html>"""
WANT = "Head & line\n\nFirst paragraph here <x>.\n\nSecond one goes on.\n\none\n\ntwo"


def test_main_text_and_odd_pages(spark, monkeypatch):
    rows = [(1, "http://a.com/1", PAGE), (2, "http://a.com/2", PAGE.replace("story 42", "story 7")), (3, "http://a.com/3", None), (4, None, PAGE), (5, "odd", ""), (6, "http://a.com/6", "<p>only"), (7, "http://b.com", "< & <<p"), (7, "http://b.com", "< & <<p"), (8, "http://c.com", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("path", F.lit("y")).withColumn("text", F.lit("z"))
    got = html_text.main_texts(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[1] == text[2] == text[4] == WANT and text[3] == text[5] == "" and text[6] == "only" and text[8] == "deep"
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)
    assert {r.page_id: r.text for r in html_text.main_texts(pages).collect()} == text
    assert html_text.main_texts(pages.where("false")).count() == 0


def test_a_host_path_rescues_a_short_page():
    long = PAGE.replace("Second one", "Second one " + "word " * 80)
    _, boxes = html_text.parse(long)
    path = html_text._best(boxes).path
    short = '<body><div class="wrap"><div class="story"><p>Tiny.</p></div></div><div class="x"><p>' + "other " * 60 + "</p></div></body>"
    assert html_text.main_text(short, "/body/div.wrap/div.story") == "Tiny." and html_text.main_text(short, None).startswith("other") and path.endswith("div.story")


# --- search ---


@pytest.mark.parametrize("pivots", [1, 16])
def test_search_equals_brute_force(spark, pivots):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 12)]) for k in range(600)]
    rows += [(600, None), (601, [float("nan")] * 12), (602, [None] * 12), (603, [float("inf")] * 12), (700, rows[50][1]), (50, rows[50][1]), (None, rows[1][1]), (701, [0.5]), (702, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("id", F.lit("q"))
    v = topk.quantised(df)
    got = topk.top_k(v, v.where("id % 50 = 0"), 5, pivots).collect()
    usable = {k: np.array([np.floor(256 * x) for x in e] + [0] * (12 - len(e)), dtype=np.int64) for k, e in rows if k is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = set()
    for q in usable:
        if q % 50 == 0:
            best = sorted(((-int(usable[q] @ x), k) for k, x in usable.items() if k != q))[:5]
            want |= {(q, r + 1, k, -s) for r, (s, k) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0
    assert topk.top_k(v.where("id = 50"), v.where("id = 50")).count() == 0


# --- archives ---


def test_packages_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b c", "same"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é" * 100_000), (None, "http://f", "same"), (6, "http://g", "one")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x")).withColumn("salt", F.lit(1)).repartition(3)
    got = {r.page_id: r for r in warc_zip.warc_round_trip(df).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), None: ("response", None), 6: ("response", None)}
    assert {i: r.record_type for i, r in {r.page_id: r for r in warc_zip.warc_round_trip(df, least=5).collect()}.items()}[2] == "response"
    assert warc_zip.warc_round_trip(df.where("false")).count() == 0


def test_zip64_directory_and_comment(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\5\6 in a comment"
        for k in range(66_000):  # more entries than the plain directory can count
            z.writestr(zipfile.ZipInfo(f"m{k}"), b"%d" % k if k % 1000 == 0 else b"")
    with path.open("rb") as f:
        found = warc_zip.members(f, path.stat().st_size)
        assert len(found) == 66_000
        for m in found[::11_000]:
            f.seek(m.offset)
            assert f.read(m.size) == m.name[1:].encode() if int(m.name[1:]) % 1000 == 0 else b""


def test_damage_is_noticed(spark, tmp_path):
    with pytest.raises(ValueError):
        warc_zip.parse_record(b"HTTP/1.1 200")
    with pytest.raises(ValueError):
        warc_zip.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    assert dt and pd  # used by the fixtures' readers
