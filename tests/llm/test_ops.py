"""Each operator on small cases of its own and against plain versions of what it computes."""

import hashlib
import math
import random
import struct
import tracemalloc
from collections import Counter
from html.parser import HTMLParser
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import chat, decontam, fingerprint, html, langid, lm, mixing, neardup, quality, toxicity
from larkspur.llm.common import BATCH, Workspace, fold, table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the same names as those that operators make or use.
CLASH = ["score", "key", "node", "label", "n", "part", "size", "copies", "rate", "copy", "words", "chunk", "hits", "leaks"]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, one long text, one long word, and clashing names."""
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (3, "", "en", None, 0), (4, " \t\n", "xx", "s", 3),
            (5, "word " * 30000, "en", "s", 150000), (6, "x" * 100000, None, "t", 100000), (7, "é\U0001F600\x00 A", "en", "t", 5), (8, "A B C D E F", "en", "t", 11), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC)
    return df.select("*", *(F.lit(c).alias(c) for c in CLASH))


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def rows_of(df):
    return df.collect()


# 1 ------------------------------------------------------------------------------------------------------------------
def brute_components(rows, width, percent):
    sets = [(k, neardup.shingle_set(x, width)) for k, x in rows]
    low = {k: k for k, _ in sets}

    def top(k):
        while low[k] != k:
            k = low[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = top(a), top(b)
                low[max(p, q)] = min(p, q)
    return {k: (len(s), top(k)) for k, s in sets}


def variants(rng, n, words=60):
    """A group of copies around the threshold: each word of a base replaced with some chance."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(w if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else f"v{rng.randrange(10**6)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize(("width", "percent", "tile"), [(3, 85, 1000), (5, 80, 1000), (5, 80, 9)])
def test_near_duplicates_as_brute_force(spark, monkeypatch, width, percent, tile):
    """With small tiles a bucket's nodes are compared in many blocks."""
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(width)
    texts = [x for n in (2, 3, 40, 120) for x in variants(rng, n)] + variants(rng, 30, 200) + ["", "a", "A", "a b", "a b", "same text here now"] * 2
    texts += ["p q r s t u v p q r s t u v p q r s t", "p q r s t u v p q r s t u v p q r s t u v p q r s t"]  # equal sets of other words
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    want = brute_components(rows, width, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 50


def test_near_duplicates_odd(spark, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd, 3, 85).collect()), key=repr)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True), (None, 4, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 7, True), (8, 4, 1, False), (None, 0, None, True)], key=repr)
    assert neardup.near_duplicates(empty(spark, odd)).count() == 0
    kept = neardup.keep_one(odd, 3, 85)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 6, 7, None, None], key=repr)


def test_looks_prune_by_the_posterior():
    rng = np.random.default_rng(1)
    looks = neardup.least_matches(85)
    a = rng.integers(0, 1 << 32, (4000, neardup.HASHES), dtype=np.uint32)
    for s, low, high in ((0.9, 1.0, 1.0), (0.3, 0.0, 0.001)):
        b = np.where(rng.random(a.shape) < s, a, a ^ np.uint32(1))
        assert low <= neardup.may_link(a, b, looks).mean() <= high
    # P(S >= t | m of n) from the Beta posterior, by numeric integration, at the least number that goes on and one below.
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, m in looks:
        for k, keeps in ((m, True), (m - 1, False)):
            if 0 <= k <= n:
                logs = k * np.log(x) + (n - k) * np.log1p(-x)
                w = np.exp(logs - logs.max())
                assert (w[x >= 0.85].sum() / w.sum() >= neardup.MISS) == keeps


# 2 ------------------------------------------------------------------------------------------------------------------
class Plain(HTMLParser):
    """The article's blocks of the generator's pages, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.on, self.out = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on = self.on or tag == "article"
        if tag in ("p", "h1"):
            self.out.append("")
        if tag == "br":
            self.out[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1"):
            self.out.append("")
        if tag == "article":
            self.on = False

    def handle_data(self, data):
        if self.on:
            self.out[-1] += data


def test_html_as_a_plain_parser(spark):
    got = {r.page_id: r.text for r in html.op2_html_extraction(spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        assert got[r.page_id] == "\n".join(x for b in p.out if (x := " ".join(b.split())))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div class="content"><div class="post post-{n}"><h2>Title {n} &amp; more</h2><p>First   <b>bold</b>&nbsp;text<br>goes on &lt;here&gt; {long}<p>Second &#233; one, {long}
<form><input name=q><p>Search</p></form><script>document.write("<p>no</p>")</script><div class="ad-box"><p>Buy now</p></div><ul><li>one<li>two</ul></div>
<div id="comments"><p>A reader says {long}{long}{long}{long}</p></div></div><aside><p>Aside</p></aside><footer>&copy; x</footer></body></html>"""


def test_html_drops_what_surrounds_the_article(spark):
    pages = [(n, f"https://Blog.Example.com/{n}?q", PAGE.replace("{n}", str(n)).replace("{long}", "words and more words " * 10)) for n in range(5)]
    pages += [(10, None, None), (11, "x", ""), (12, "http://a.b/", "<p>only"), (13, "http://blog.example.com/z", "<main><p>Another template, with a text that is long enough.</main>"), (13, "http://blog.example.com/z", "<main><p>Another template, with a text that is long enough.</main>"), (None, "u", "a <b>b</b> < c <"), (15, "http://a.b/", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("path", F.lit(1))
    got = {}
    for r in html.extract_main_text(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    long = ("words and more words " * 10).strip()
    assert got[3] == [f"Title 3 & more\nFirst bold text goes on <here> {long}\nSecond é one, {long}\none\ntwo"]
    assert got[10] == [""] and got[11] == [""] and got[12] == ["only"] and got[13] == ["Another template, with a text that is long enough."] * 2
    assert got[None] == ["a b < c <"] and got[15] == ["deep"]
    assert html.extract_main_text(empty(spark, df)).count() == 0


def alone(source):
    return html.main_text(html.parse(source), [], {})


LONG = "words and more words " * 10


def test_html_deletes_nothing_for_a_name_alone():
    for wrapper in ("page right-sidebar", "header-fixed", "comments-enabled menu"):
        assert alone(f'<div class="{wrapper}"><h1>T</h1><p>{LONG}</div>') == f"T\n{LONG.strip()}"
        assert alone(f'<body><nav>n</nav><div class="{wrapper}"><nav>m</nav><div><h1>T</h1><p>{LONG}</div><div class="sidebar">aside</div></div>') == f"T\n{LONG.strip()}"
    assert alone(f"<article><h1>Title</h1><div class=body><p>{LONG}</div></article>") == f"Title\n{LONG.strip()}"
    parts = f"<h1>T</h1><p>intro<section class=a><p>{LONG * 4}</section><section class=b><p>short b</section>"
    for around in ("article", "div"):
        assert alone(f"<body><nav>n</nav><div><{around}>{parts}</{around}></div>") == f"T\nintro\n{(LONG * 4).strip()}\nshort b"
    assert alone(f'<article><p>{LONG}<section class="related-work"><h2>Related work</h2><p>{LONG}</section><div class=related><a href=x>{LONG}</a></div></article>') == f"{LONG.strip()}\nRelated work\n{LONG.strip()}"
    assert alone(f"<article><header class=article-header><h1>T</h1></header><p>{LONG}</article><header><h1>Site</h1></header>") == f"T\n{LONG.strip()}"
    assert alone(f"<form id=all><div><h1>T</h1><p>{LONG}</div><footer>f</footer></form>") == f"T\n{LONG.strip()}"


def test_html_drops_whole_pages_without_an_article():
    assert alone(f'<nav><a>{LONG}</a></nav><article></article><div class="ad">{LONG}</div><footer>{LONG}</footer>') == ""
    assert alone(f"<article><p>short</article><div id=comments><p>{LONG * 9}</div>") == "short"


def test_html_votes_change_the_text(spark):
    """On most pages of the host the story is long and a box beside it short; one page has it the other way round."""
    page = "<body><div class=box-{n}><p>{box}</div><div class=story><p>{story}</div>"
    pages = [(n, "http://h.org/x", page.format(n=n, box="box text", story=f"story {n} {LONG * 3}")) for n in range(8)] + [(8, "http://h.org/y", page.format(n=8, box=LONG * 3, story=f"story eight {LONG}"))]
    odd = f"<body><div class=ad><h1>T</h1><p>{LONG}</div><div class=story><p>story</div>"
    pages += [(9, "http://h.org/z", odd), (10, "http://other.org/z", odd), *((n, "http://h.org/w", f"<div class=ad><p>buy</div><div class=story><p>story {LONG * 2}</div>") for n in range(11, 20))]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert alone(pages[8][2]) == (LONG * 3).strip() and got[8] == f"story eight {LONG.strip()}"
    assert got[10] == alone(odd) == f"T\n{LONG.strip()}" and got[9] == "story"
    assert all(got[n] == f"story {n} {(LONG * 3).strip()}" for n in range(8))


def test_html_depth_takes_little_memory():
    import tracemalloc

    tracemalloc.start()
    assert alone("<div class=x>" * 100_000 + "deep") == "deep"
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


# 3 ------------------------------------------------------------------------------------------------------------------
def least_edits(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for k, c in enumerate(item):
            new.append(min(row[k] + (c != ch), row[k + 1] + 1, new[k] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_edit_matching_as_brute_force(spark):
    """Items without an edit to spare are found as whole words only."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6)))
    items = [(n, " ".join(word() for _ in range(rng.randrange(1, 14)))) for n in range(25)] + [(90, None), (91, " "), (92, "abc")]
    docs = []
    for n in range(60):
        text = [word() for _ in range(rng.randrange(0, 40))]
        item = list(rng.choice(items[:25])[1])
        for _ in range(rng.randrange(0, 8)):
            k = rng.randrange(len(item)) if item else 0
            item[k : k + rng.randrange(2)] = rng.choice(["", "z", "a"])
        docs.append((n, " ".join(text).upper() + "  " + "".join(item)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "x " * 20000 + items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("leaks", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_leaks(df, bench, 0.2).collect()}
    want = {}
    for k, text in docs:
        for i, item in items:
            plain = decontam.normalise(item)
            budget, whole = math.floor(0.2 * len(plain)), f" {decontam.normalise(text)} "
            if plain and (k != 102 or i == 3) and (d := least_edits(plain, decontam.normalise(text))) <= budget and (budget or f" {plain} " in whole):
                want[k, i] = d
    assert {x: d for x, d in got.items() if x[0] != 102 or x[1] == 3} == want and len(want) > 40
    clean = decontam.drop_leaked(df, bench, 0.2)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {k for k, _ in docs} - {k for k, _ in got}
    assert decontam.find_leaks(df, empty(spark, bench)).count() == 0 and decontam.find_leaks(empty(spark, df), bench).count() == 0
    # Many blocks, a pass each, find and leave the same.
    assert len(list(decontam.blocks(bench, 100))) > 4
    assert Counter((r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(df, bench, 0.2, 100).collect()) == Counter((*x, d) for x, d in got.items())
    assert {r.doc_id for r in decontam.drop_leaked(df, bench, 0.2, 100).collect()} == {k for k, _ in docs} - {k for k, _ in got}


# 4 ------------------------------------------------------------------------------------------------------------------
def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the hash so far as the seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


UNIT = regex.compile(fingerprint.UNIT, regex.V1)


def plain_anchors(text):
    """Hashes, rising, and places of a fingerprint, by definition."""
    units = UNIT.findall((text or "").lower())
    n, low = len(units), (1 << 32) - 1
    s = [spark_hash(*units[i : i + 2]) for i in range(n)]
    found = [spark_hash(u) & low for u in units] if n < 8 else []
    found += [x & low if i == 0 or i + 2 <= n else None for i, x in enumerate(s)] if n < 24 else []
    for i in range(n):
        inner = s[i : i + 4]
        found.append(spark_hash(inner[0], inner[2], inner[3]) & low if i + 5 <= n and min(inner) in (inner[0], inner[3]) else None)
    kept = sorted({x for x in found if x is not None})[:40]
    return kept, [found.index(x) % n for x in kept]


def plain_likeness(a, b):
    limit = min([x[0][-1] for x in (a, b) if len(x[0]) == 40], default=1 << 40)
    sizes = sum(h <= limit for x in (a, b) for h in x[0])
    moved = [b[1][b[0].index(h)] - p for h, p in zip(*a, strict=True) if h in b[0]]
    return 2 * max((sum(abs(x - y) <= 24 for y in moved) for x in moved), default=0) / sizes if sizes else 1.0


def read_print(x):
    pairs = [p.split(".") for p in x.split()]
    return [int(h, 16) for h, _ in pairs], [int(p, 16) for _, p in pairs]


def test_fingerprints_by_definition(spark, docs):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    texts = dict(sorted((r.doc_id, r.text) for r in docs.collect()))
    ids = list(texts)
    spelled, near, far = {}, [], []
    for k, i in enumerate(ids):
        text, ahead = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + ahead[:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert spelled.setdefault(text, r.fingerprint) == r.fingerprint
        a, b, c = plain_anchors(text), plain_anchors(edited), plain_anchors(ahead)
        assert read_print(r.fingerprint) == a and read_print(r.edited_fingerprint) == b
        assert math.isclose(r.near_edited, plain_likeness(a, b)) and math.isclose(r.near_next, plain_likeness(a, c))
        near.append(r.near_edited)
        far.append(r.near_next)
    assert np.median(near) > 0.65 and np.median(far) < 0.01
    assert sum(len(r.fingerprint) for r in got.values()) < sum(map(len, texts.values())) / 4


def test_likeness_by_length_class(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    near = {r.doc_id: (r.near_edited, r.near_next) for r in fingerprint.fingerprints(docs).collect()}
    for low, high, least in ((4, 8, 0.6), (8, 16, 0.6), (16, 64, 0.65), (64, 10**9, 0.65)):
        own = [near[k] for k, n in words.items() if low <= n < high]
        assert len(own) > 5 and all(x > 0 for x, _ in own) and np.median([x for x, _ in own]) > least and np.mean([x for _, x in own]) < 0.01, low


def test_unspaced_and_short_texts_have_several_anchors(spark):
    rng = random.Random(5)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(40))
    latin = "".join(rng.choice("bcdfghlmnrst") * rng.choice((1, 1, 2)) + rng.choice("aeiou") for _ in range(300))
    rows = [(1, cjk), (2, latin), (3, "just seven words stand in this line"), (4, "x" * 500), (5, latin[:400] + "k" + latin[400:]), (6, "0123456789abcdef" * 2), (7, latin[300:] + latin[:300]), (8, latin[:300] + latin)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {k: read_print(r.fingerprint) for k, r in got.items()}
    assert all(len(prints[k][0]) > 3 for k in (1, 2, 3, 5, 6)) and len(prints[4][0]) == 1
    assert min(got[k].near_edited for k in (1, 2, 3, 5, 6)) >= 0.55
    near = lambda a, b: plain_likeness(prints[a], prints[b])
    # An inserted letter changes little; passages in another order, or after a passage put before them, count by the larger part in step.
    assert near(2, 5) > 0.9 and 0.3 < near(2, 7) < 0.75 and near(2, 2) == 1


def test_fingerprints_of_texts_that_begin_alike(spark):
    """What a text and its edit share is hashed once; wherever the last space lies, both are what they are by definition."""
    rng = random.Random(8)
    parts = ["a", "strength", "Σας", "ΟΔΟΣ", "é", "\U0001F600", "字字", " ", "  ", "\t", "\n", " x ", "ing ", "word ", "\x00", "œuvre", "."]
    texts = {k: "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 6, 9, 14, 25, 60, 200]))) for k in range(300)} | {300: "字" * 90, 301: "b c" * 50, 302: " " * 50 + "a", 303: "a b c d e f g h " + "x" * 5}
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k, text in texts.items():
        cut = len(text) // 4
        edited = text[: len(text) - cut] + texts[(k + 1) % len(texts)][:cut]
        assert read_print(got[k].fingerprint) == plain_anchors(text) and read_print(got[k].edited_fingerprint) == plain_anchors(edited), (k, text, edited)


def test_units_are_as_with_ranges(spark, docs):
    """The classes name their characters one by one, which is faster; they are those of ranges less the vowels."""
    vowel, letter = "[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ]", "[a-zß-öø-ÿœ]"
    consonant = f"[{letter}&&[^{vowel}]]"
    ranges = rf"{consonant}{{0,3}}{vowel}{{1,3}}(?:{consonant}{{1,3}}(?!{letter}))?|{consonant}{{1,4}}|[^\x20\x09-\x0D]"
    rows = docs.select(F.concat("text", F.lit("".join(map(chr, [*range(1, 0x180), 0x3A3, 0x4E00, 0x1F600])))).alias("text"))
    one, two = (F.regexp_extract_all(F.lower("text"), F.lit(x), F.lit(0)) for x in (fingerprint.UNIT, ranges))
    assert rows.filter(one != two).count() == 0


def test_an_edit_is_not_read_whole_again(docs, monkeypatch):
    """Text and edited text, each read whole, took 1894 CPU seconds a GB; of what they share most is read once."""
    read = []
    whole = fingerprint.anchors

    def anchors(rows, *columns):
        names = [x for c in columns for x in (c if isinstance(c, dict) else [c])]
        read.append(rows.filter("not extra").agg(*(F.sum(F.length(x)) for x in names if x in rows.columns)).first())
        return whole(rows, *columns)

    monkeypatch.setattr(fingerprint, "anchors", anchors)
    fingerprint.fingerprints(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    assert chars < sum(sum(r) for r in read) < 1.6 * chars


def test_fingerprints_odd(spark, odd):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].n_chars == 0 and by[2][0].fingerprint == "" and by[3][0].near_edited == 1.0 and by[1][0] != by[5][0]
    assert by[1][0].fingerprint == by[1][1].fingerprint == by[8][0].fingerprint
    last = by[8][0]
    assert last.edited_sha256 == hashlib.sha256(b"A B C D E").hexdigest() or last.n_chars == 11
    assert fingerprint.fingerprints(empty(spark, odd)).count() == 0
    assert fingerprint.fingerprints(odd.filter("doc_id = 5")).first().near_edited == 1.0


def test_one_id_fills_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    rows = [(None, f"text {k}") for k in range(60)] + [(7, f"seven {k}") for k in range(70)] + [(k, f"own {k}") for k in range(-20, 60) if k != 7]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {r.part: r["count"] for r in fingerprint.with_ranges(df).filter("not extra").groupBy("part").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 45 and len(sizes) > 12
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1])))
    want = []
    for k, (i, text) in enumerate(order):
        cut = len(text) // 4
        want.append((i, hashlib.sha256((text[: len(text) - cut] + order[(k + 1) % len(order)][1][:cut]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprint.fingerprints(df).collect()) == Counter(want)


def test_many_ranges(spark, monkeypatch, docs):
    want = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    monkeypatch.setattr(fingerprint, "CHUNK", 4)
    assert {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()} == want


# 5 ------------------------------------------------------------------------------------------------------------------
def plain_katz(rows, order):
    """The same model with dictionaries: words, n-grams by order, probability of a word after a history, tokens, and what is held out."""
    tokens = {k: [*(x or "").encode().lower().split(), b""] for k, x in rows}
    held = {k: lm.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    grams = [Counter() for _ in range(order + 1)]
    for k, t in tokens.items():
        if not held[k]:
            grams[1].update((w,) for w in t)
            for n in range(2, order + 1):
                grams[n].update(zip(*([None, *t][j:] for j in range(n)), strict=False))
    of = lambda c: [sum(v == r for v in c.values()) for r in range(1, lm.KATZ + 2)]
    words = lm.Words(sum(grams[1].values()), len(grams[1]), of(grams[1]))
    d = [lm.discounts(of(c)) for c in grams]
    after = {}
    for c in grams[2:]:
        for g, n in c.items():
            after.setdefault(g[:-1], {})[g[-1]] = n
    known = {}

    def p(w, h):
        if (w, h) not in known:
            seen = after.get(h, {})
            if not h:
                known[w, h] = float(words.probability(np.array([grams[1][(w,)]]))[0])
            elif not seen:
                known[w, h] = p(w, h[1:])
            else:
                total, low = sum(seen.values()), d[len(h) + 1]
                disc = {x: (c * low[c] if c <= lm.KATZ else c) / total for x, c in seen.items()}
                left, free = 1 - sum(disc.values()), 1 - sum(p(x, h[1:]) for x in seen)
                kept = max(left, 1 / (total + 1))
                known[w, h] = disc[w] * (1 - kept) / (1 - left) if w in seen else kept / free * p(w, h[1:])
        return known[w, h]

    return words, grams, p, tokens, held


def history(t, k, order):
    """What stands before the k-th token of a text, as far as an order looks."""
    return tuple([None, *t][max(0, k + 2 - order) : k + 1]) if order > 1 else ()


@pytest.mark.parametrize(("order", "share"), [(1, 3000), (2, 3000), (3, 3000), (3, 200), (4, 3000)])
def test_katz_as_dictionaries(spark, docs, monkeypatch, order, share):
    monkeypatch.setattr(lm, "SHARE", share)
    monkeypatch.setattr(lm, "SPREAD", 10**6)
    monkeypatch.setattr(lm, "CHUNK", 4000)
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(1000, None), (1001, ""), (1002, "zzz never the seen")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumn("chunk", F.lit(1)).withColumn("p", F.lit(2))
    words, grams, p, tokens, held = plain_katz(rows, order)
    run = lm.Scorer(df, order)
    run.count_words()
    for k in range(2, order + 1):
        run.count(k)
    assert share > 200 or all(m.spread for m in run.models)
    got = run.finish().collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(grams[1][(w,)] > 0 for w in t), words.total)
        base = sum(math.log10((grams[1][(w,)] + 0.1) / (words.total + 0.1 * (len(grams[1]) + 1))) for w in t)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(w, history(t, k, order))) for k, w in enumerate(t)), rel_tol=1e-6), r.doc_id


def test_katz_adds_up_to_one(docs):
    rows = [(r.doc_id, r.text) for r in docs.limit(25).collect()]
    _, grams, p, _, _ = plain_katz(rows, 3)
    histories = [(), (None,), (b"",), (b"never",), (b"never", b""), *sorted({g[:-1] for c in grams[2:] for g in c if None not in g})[::97]]
    assert len(histories) > 20
    for h in histories:
        assert math.isclose(sum(p(w, h) for (w,) in grams[1]) + p(b"\x00unknown", h), 1.0, rel_tol=1e-9)


def test_a_chunk_is_small_beside_its_executor(monkeypatch):
    """The check tool once stopped the query at 3080 MB of an executor's memory, in the step that sends the third order."""
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.zipf(1.15, 400) % 50_000)) for _ in range(500)]
    made = list(lm.chunks(iter([pa.record_batch({"doc_id": pa.array(range(1, 501), pa.int64()), "text": texts})])))
    row, words = made[0].to_pylist()
    assert len(made) == 1 and row["size"] == 500 * 401
    answer = lambda t: {x["p"]: x for x in t.to_pylist() if x["chunk"] is not None}
    first = answer(lm.count_words(pa.table({"chunk": [0], "p": [0], "word": [words["word"]], "n": [words["n"]]})))
    tracemalloc.start()
    try:
        chunk = lm.Chunk(row, 1)
        chunk.learn_words(first, lm.Words(row["size"], 30_000, [9, 6, 5, 4, 3, 2]), row["learnt"])
        chunk.grams(2, 10**9)
        assert len(chunk.h) > 80_000
        sent = chunk.message(slice(0, len(chunk.h)))
        second = answer(lm.count_grams(pa.table({"chunk": [0], "p": [0]} | dict(zip(("h", "word", "n", "lower", "spread"), ([x] for x in sent), strict=True))), False))
        chunk.learn(second, lm.Grams([9, 6, 5, 4, 3, 2], {}), False)
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        chunk.grams(3, 10**9)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(chunk.h) > 100_000 and peak < 100 * row["size"], (peak / row["size"], before / row["size"])


def test_messages_stay_small_with_many_partitions(monkeypatch):
    """The check tool carried the query's disk on to 7.6 times the input: a triple took more bytes the more partitions there were."""
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.zipf(1.15, 400) % 50_000)) for _ in range(500)]
    row, words = next(lm.chunks(iter([pa.record_batch({"doc_id": pa.array(range(1, 501), pa.int64()), "text": texts})]))).to_pylist()
    hashes, n = lm.unpack_steps(words["word"], np.uint64), lm.unpack(words["n"], np.uint32)

    def answer(t):
        (x,) = (x for x in t.to_pylist() if x["chunk"] is not None)
        return x

    def bytes_each(parts):
        of = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        first = {p: answer(lm.count_words(pa.table({"chunk": [0], "p": [p], "word": [lm.pack_steps(hashes[k])], "n": [lm.pack(n[k])]}))) for p, k in lm.spans(of)}
        chunk = lm.Chunk(row, parts)
        chunk.learn_words(first, lm.Words(row["size"], 30_000, [9, 6, 5, 4, 3, 2]), row["learnt"])
        for order in (2, 3):
            chunk.grams(order, 10**9)
            got, total, size = {}, 0, len(chunk.h)
            for p, k in lm.spans(chunk.part):
                sent = chunk.message(k)
                total += sum(map(len, sent))
                got[p] = answer(lm.count_grams(pa.table({"chunk": [0], "p": [p]} | {c: [x] for c, x in zip(("h", "word", "n", "lower", "spread"), sent, strict=True)}), order == 3))
            with np.errstate(over="ignore"):  # the counts here are not discounted
                chunk.learn(got, lm.Grams([9, 6, 5, 4, 3, 2], {}), order == 3)
        return total / size

    few, many = bytes_each(4), bytes_each(64)
    assert many < 1.1 * few, (few, many)


def test_chunks_reach_python_one_by_one(spark, tmp_path):
    """A bucket with several chunks must not be in Python at once."""
    work = Workspace(spark, "few")
    had = spark.conf.get(BATCH)
    sizes = lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches)
    rows = spark.range(0, 6, 1, 1)
    assert [r.n for r in work.write(rows.mapInArrow(sizes, "n long"), "few", at_once=1).collect()] == [1] * 6
    assert [r.n for r in work.write(rows.mapInArrow(sizes, "n long"), "all").collect()] == [6] and spark.conf.get(BATCH) == had


def test_lm_beats_the_base_and_takes_odd_rows(spark, docs, odd):
    got = [r for r in lm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    rows = lm.score(odd).collect()
    assert len(rows) == 11 and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert lm.score(empty(spark, odd)).count() == 0


def test_chunks_without_ngrams_of_an_order(spark, monkeypatch):
    """Chunks of empty texts alone have no triples; above the third order they stopped the query."""
    monkeypatch.setattr(lm, "CHUNK", 40)
    rows = [(k, "a b c d e f g a b c d" if k < 12 else "") for k in range(1, 90)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 4).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 90)) and all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_good_turing_runs_on_the_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        number = {b"": 0}
        kinds = ([], [], [])
        for r in table(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text").collect():
            if lm.crc32(str(r.doc_id).encode()) % 10:
                own = np.array([*(number.setdefault(w, len(number)) for w in r.text.encode().lower().split()), 0])
                before = np.r_[0, own[:-1] + 1]
                for k, x in enumerate((own, before << 21 | own, (before[:-1] << 42) + (before[1:] << 21) + own[1:])):
                    kinds[k].append(x)
        assert len(number) < 1 << 21
        for x in kinds:
            n = [int((np.unique(np.concatenate(x), return_counts=True)[1] == r).sum()) for r in range(1, lm.KATZ + 2)]
            slope = np.polyfit(np.log(range(1, lm.KATZ + 2)), np.log(n), 1, w=np.sqrt(n))[0]
            smooth = [r**slope for r in range(1, lm.KATZ + 2)]
            common = (lm.KATZ + 1) * smooth[-1] / smooth[0]
            want = [((r + 1) * smooth[r] / (r * smooth[r - 1]) - common) / (1 - common) for r in range(1, lm.KATZ + 1)]
            got = lm.discounts(n)
            assert np.allclose(got[1:], want) and all(0 < x < 1 for x in want) and (np.diff(got) > 0).all()


def test_discounts_where_nothing_can_be_fitted():
    assert lm.good_turing([0] * 6) is None and lm.good_turing([5, 0, 0, 0, 0, 0]) is None and lm.good_turing([1, 2, 3, 4, 5, 6]) is None
    assert all(((0 < d[1:]) & (d[1:] < 1)).all() for d in map(lm.discounts, ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6], [9, 0, 2, 0, 0, 1])))


# 6, 7, 9 ------------------------------------------------------------------------------------------------------------
def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(9, toxicity.WORD + toxicity.CHAR))
    ids, lengths = rng.integers(0, 9, (toxicity.WINDOW, 5)), np.array([6, 5, 3, 1, 0])
    weight = rng.normal(size=5)
    loss = lambda: float(weight @ net.run(net.inputs(x), ids, lengths))
    kept = {}
    net.run(net.inputs(x), ids, lengths, kept)
    grads, dx = net.back(weight, ids, x, kept)
    for name, value, grad in [*((k, net.p[k], grads[k]) for k in net.p if k != "w0"), ("x", x, dx)]:
        at = tuple(rng.integers(0, s) for s in value.shape)
        old, eps = value[at], 1e-4
        value[at] = old + eps
        up = loss()
        value[at] = old - eps
        down = loss()
        value[at] = old
        assert math.isclose((up - down) / (2 * eps), float(grad[at]), rel_tol=2e-2, abs_tol=2e-4), name


def test_windows_cover_every_token():
    sizes = np.array([0, 1, 63, 64, 65, 112, 113, 1000])
    owner, start, length = toxicity.windows(sizes)
    for k, n in enumerate(sizes):
        own = [(s - sizes[:k].sum(), m) for o, s, m in zip(owner, start, length, strict=True) if o == k]
        assert own[0][0] == 0 and own[-1][0] + own[-1][1] == n and all(b[0] == a[0] + toxicity.STRIDE for a, b in zip(own, own[1:], strict=False))


def plain_vector(word):
    """A word's index vector, one number at a time."""
    out = np.zeros(quality.DIM)
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    shape = "".join(c for k, c in enumerate(kinds) if k == 0 or c != kinds[k - 1])
    for feature in ("w" + word.lower(), "s" + shape, "h" + word[:2], "t" + word[-2:]):
        h = xxhash.xxh3_64_intdigest(feature)
        for _ in range(quality.NONZERO):
            out[h % quality.DIM] += 1 if h >> 8 & 1 else -1
            h >>= 12
    return out / max(math.sqrt(out @ out), 1e-6)


def test_word_vectors_by_definition(monkeypatch):
    """Index vectors, context vectors and pooling, by loops over words; the same however batches fall."""
    texts = ["The cat saw the dog", "a dog saw A CAT-42 the cat", "", "x", "the cat the cat the cat " * 3, "Zz" * 100 + "9"]
    v = quality.Vectors(texts, least=2)
    counts = Counter(w for t in texts for w in t.split())
    index = {w: plain_vector(w) for w in counts}
    assert np.allclose(quality.index_vectors(sorted(counts)), [index[w] for w in sorted(counts)], atol=1e-6)
    context = {w: np.zeros(quality.DIM) for w in counts}
    for t in texts:
        ws = t.split()
        for i, w in enumerate(ws):
            for j in range(max(0, i - quality.REACH), min(len(ws), i + quality.REACH + 1)):
                if i != j:
                    context[w] += index[ws[j]]
    common = sum(context.values()) / sum(counts.values())
    vector = {}
    for w, n in counts.items():
        c = context[w] - n * common
        vector[w] = index[w] + c / max(math.sqrt(c @ c), 1e-6) if n >= 2 else index[w]
    assert set(v.at) == {w for w, n in counts.items() if n >= 2}
    asked = [*texts, "unseen words the unseen", "the " * 25_000]
    want = []
    for t in asked:
        ws = [vector[w] if w in vector else plain_vector(w) for w in t.split()]
        cos = [sum(a @ b / math.sqrt((a @ a) * (b @ b)) for a, b in zip(ws, ws[d:], strict=False)) for d in (1, 2)]
        want.append([*sum(ws, np.zeros(quality.DIM)), *sum((x * x for x in ws), np.zeros(quality.DIM)), *cos, math.log1p(len(ws)) * max(len(ws), 1)])
        want[-1] = np.array(want[-1]) / max(len(ws), 1)
    assert np.allclose(v.pool(asked), want, atol=2e-3)
    monkeypatch.setattr(quality, "REMEMBERED", 1)
    assert np.allclose([v.pool([t])[0] for t in asked], want, atol=2e-3)


def test_temperature_and_network():
    """The temperature is the one of the grid with the least loss on rows left out; probabilities are the network's, by loops."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5)).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=120) > 0).astype(np.float32)
    net = quality.Network(x, y, hidden=6, epochs=40)
    z = np.zeros(120)
    for k in range(4):
        left = np.arange(120) % 4 == k
        p = net.fit(net.scale(x)[~left], y[~left], np.ones(90, np.float32), 6, 40, 3e-3, 1e-3)
        z[left] = net.logit(net.scale(x)[left], p)
    losses = [(sum(math.log1p(math.exp(-(2 * b - 1) * a / t)) for a, b in zip(z, y, strict=True)), t) for t in np.geomspace(0.25, 8, 41)]
    assert math.isclose(net.temperature, min(losses)[1])
    w, b, o, o0 = net.p
    for row, p in zip(x[:10], net.probability(x[:10]), strict=True):
        s = [min(max((v - m) / d, -8), 8) * quality.GAIN for v, m, d in zip(row, net.mean, net.std, strict=True)]
        h = [max(sum(s[i] * w[i, j] for i in range(5)) + b[j], 0) for j in range(6)]
        assert math.isclose(p, 1 / (1 + math.exp(-(sum(h[j] * o[j] for j in range(6)) + float(o0)) / net.temperature)), rel_tol=1e-5)


def test_toxicity_by_loops():
    """Scores of a trained model, by loops: every window token by token, the highest, and the calibration; overlapping windows cover long texts."""
    rng = random.Random(12)
    say = lambda n, bad: " ".join("foul" if bad and rng.random() < 0.2 else rng.choice(["the", "fine", "day", "was", "long", "Über"]) for _ in range(n))
    m = toxicity.Model([(say(30, k % 2), k % 2) for k in range(60)], {0: 1.0, 1: 0.5}, epochs=2)
    net = {k: v.astype(float) for k, v in m.net.p.items()}
    sig = lambda x: 1 / (1 + math.exp(-x))

    def vector(word):
        raw = f"<{word}>".encode()
        grams = []
        for n in (3, 5):
            for i in range(len(raw) - n + 1):
                h = n
                for c in raw[i : i + n]:
                    h = (h ^ c) * 0x01000193 % (1 << 32)
                grams.append((h ^ h >> 15) % toxicity.BUCKETS)
        return np.concatenate([m.words[m.at.get(word, 0)], sum((m.chars[g].astype(float) for g in grams), np.zeros(toxicity.CHAR)) / max(len(grams), 1)])

    def logit(words):
        xs, h = [vector(w) for w in words], toxicity.HIDDEN
        states = np.zeros((max(len(xs), 1), 2 * h))
        for side, order, at in (("f", range(len(xs)), 0), ("b", range(len(xs) - 1, -1, -1), h)):
            s = np.zeros(h)
            for t in order:
                x, y = xs[t] @ net[f"wx{side}"] + net[f"b{side}"], s @ net[f"wh{side}"]
                r, z = np.array([sig(v) for v in x[:h] + y[:h]]), np.array([sig(v) for v in x[h : 2 * h] + y[h : 2 * h]])
                n = np.tanh(x[2 * h :] + r * y[2 * h :])
                s = (1 - z) * n + z * s
                states[t, at : at + h] = s
        e = np.exp([np.tanh(v @ net["wa"] + net["ba"]) @ net["va"] for v in states])
        return (e / e.sum()) @ states @ net["w"] + net["w0"]

    texts = [say(n, n % 2) for n in (0, 1, 5, 64, 65, 113, 300)] + ["never seen 1234 words"]
    for text, got in zip(texts, m.scores(texts), strict=True):
        words = toxicity.tokens(text)
        starts = range(0, max(len(words) - toxicity.WINDOW + toxicity.STRIDE, 1), toxicity.STRIDE)
        want = sig(m.slope * max(logit(words[a : a + toxicity.WINDOW]) for a in starts) + m.offset)
        assert math.isclose(got, want, rel_tol=1e-3, abs_tol=1e-4)


def test_fewest_texts_of_a_word_by_loops():
    rng = random.Random(13)
    y = np.array([k % 3 == 0 for k in range(90)], np.float32)
    texts = [[rng.choice("abcdefghijklmnop") + (rng.choice("xyz") if k else "q") for _ in range(rng.randrange(0, 90))] for k in y]
    texts = [w + ["bad"] if k and rng.random() < 0.6 else w for w, k in zip(texts, y, strict=True)]
    found = []
    for least in toxicity.LEAST:
        top = []
        for i, words in enumerate(texts):
            train = [j for j in range(90) if j % 4 != i % 4]
            n1, n0 = sum(y[j] for j in train), sum(1 - y[j] for j in train)
            value = {}
            for w in set(words):
                a, b = (sum(w in texts[j] for j in train if y[j] == x) for x in (1, 0))
                p = least**2 / 8
                value[w] = max(math.log((a + p) / (n1 + 2 * p)) - math.log((b + p) / (n0 + 2 * p)) - 0.5, 0) if a + b >= least else 0.0
            starts = range(0, max(len(words) - toxicity.WINDOW + toxicity.STRIDE, 1), toxicity.STRIDE)
            top.append(max(sum(value[w] for w in words[a : a + toxicity.WINDOW]) for a in starts))
        pairs = [(a, b) for a, x in zip(top, y, strict=True) if x for b, z in zip(top, y, strict=True) if not z]
        found.append((round(sum((a > b + 1e-9) + (abs(a - b) <= 1e-9) / 2 for a, b in pairs) / len(pairs), 9), -least))
    assert toxicity.fewest(texts, y) == -max(found)[1]


def test_classifiers_on_held_out_rows(spark):
    """On rows kept from training: toxicity and low quality by precision and recall, as most rows are neither; at the small size toxic rows stand above others."""
    read = lambda sf, name: table(spark, f"/root/testdata/{sf}", name).collect()
    labels = {r.doc_id: r for r in read("sf0.1", "labels")}
    for query, name, rare, bar in ((toxicity.op6_toxicity, "toxic", 1, 0.8), (quality.op9_quality, "quality", 0, 0.95)):
        got = [(r.predicted == rare, labels[r.doc_id][name] == rare) for r in query(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
        both = sum(a and b for a, b in got)
        assert both >= bar * sum(a for a, _ in got) and both >= bar * sum(b for _, b in got), (name, both, len(got))
    labels = {r.doc_id: r.toxic for r in read("sf0.01", "labels")}
    scores = ([], [])
    for r in toxicity.op6_toxicity(spark, "/root/testdata/sf0.01").collect():
        if r.held_out and r.doc_id in labels:
            scores[labels[r.doc_id]].append(r.score)
    assert np.mean([a < b for a in scores[0] for b in scores[1]]) > 0.75
    docs = {r.doc_id: r.lang for r in read("sf0.01", "documents")}
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in langid.op7_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]) >= 0.97


def test_classifiers_odd(spark, odd):
    for model, score in ((toxicity.Model([("a bad b", 1), ("good day", 0), ("bad", 1), ("day", 0)] * 5, {0: 1.0, 1: 1.0}), toxicity.score), (quality.Classifier([("a fine b", 1), ("$$$ ###", 0), ("fine", 1), ("###", 0)] * 5, {0: 1.0, 1: 1.0}), quality.score)):
        rows = score(odd, model).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1 and len({r.score for r in rows if r.doc_id == 1}) == 1
        assert score(empty(spark, odd), model).count() == 0
    kept = quality.keep_good(odd, quality.Classifier([], {}), 0.5)
    assert kept.columns == odd.columns and kept.count() == 11
    assert toxicity.keep_clean(odd, toxicity.Model([], {})).count() == 11
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (5, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(odd, quality.learn(odd, labels)).count() == 11
    assert toxicity.score(odd, toxicity.learn(odd, empty(spark, labels))).first().score == 0.0


def longest_match_phrases(text, reference):
    at = n = 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in reference:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


@pytest.mark.parametrize("dense", [63, 3, 1])
def test_cross_parsing_as_substring_search(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    rng = random.Random(6)
    samples = {x: "".join(rng.choice(a) for _ in range(300)) for x, a in (("p", "abc"), ("q", "abcd "), ("r", "klmnopqrstuvw"))}
    m = langid.Model(samples)
    texts = ["".join(rng.choice("abcdzkmw ") for _ in range(n)) for n in (0, 1, 5, 50, 900)]
    got = langid.phrases(m.parsers, [m.encode(t) for t in texts])
    assert got.tolist() == [[longest_match_phrases(t, samples[x]) for x in m.langs] for t in texts]


def test_languages_of_many_letters():
    """Two languages of some 1,400 characters each, half of them in common, beside three alphabets."""

    def language(letters, seed):
        rng = random.Random(seed)
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
        return lambda n: " ".join(words[int(3000 * rng.random() ** 3)] for _ in range(n))

    signs = [chr(x) for x in range(0x4E00, 0x4E00 + 2100)]
    say = {"a": language(signs[:1400], 1), "b": language(signs[700:], 2), "c": language("abcdefghijklmnopqrstuvwxyz", 3), "d": language([chr(x) for x in range(0x430, 0x450)], 4), "e": language([chr(x) for x in range(0x3B1, 0x3CA)], 5)}
    m = langid.Model({k: f(15000)[:40000] for k, f in say.items()})
    assert max(p.width for p in m.parsers) == langid.DENSE + 1 and sum(len(p.edges) > 0 for p in m.parsers) == 2
    for k, f in say.items():
        assert np.mean([x == k for x in m.predict([f(25) for _ in range(100)])[0]]) >= 0.97


def test_a_very_long_labelled_text_teaches_a_stretch(spark):
    df = spark.createDataFrame([("en", "x"), ("en", None), ("de", "kurz")], "lang string, text string").withColumn("text", F.when(F.col("text") == "x", F.repeat(F.lit("one two three four five "), 210_000)).otherwise(F.col("text")))
    m = langid.learn(df, chars=5000)
    assert m.langs == ["de", "en"] and m.bits[1] <= math.log2(5001) and m.predict(["two three four"])[0] == ["en"]


def test_copies_of_one_text_teach_once(spark):
    rows = [("en", "the very same words")] * 500 + [("en", "other words here"), ("de", "the very same words")]
    df = spark.createDataFrame(rows, "lang string, text string")
    once = langid.learn(df.distinct(), rows=10**6)
    m = langid.learn(df, rows=10**6)
    assert m.langs == ["de", "en"] and m.bits.tolist() == once.bits.tolist() and all((a.table == b.table).all() for a, b in zip(m.parsers, once.parsers, strict=True))


def test_copies_do_not_use_up_the_draw(spark, monkeypatch):
    spell = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:04d}")
    rows = [("en", "the very same words")] * 9000 + [("en", spell(k)) for k in range(1000)]
    monkeypatch.setattr(langid, "Model", lambda samples: samples)
    got = langid.learn(spark.createDataFrame(rows, "lang string, text string"), rows=200)["en"].split()
    assert 150 < len({w for w in got if len(w) == 4 and set(w) <= set("abcdefghij")}) < 250


def test_language_odd(spark, odd):
    m = langid.learn(odd.filter(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    rows = langid.identify(odd, m).collect()
    assert len(rows) == 11 and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert all(0 <= r.score <= 1 for r in rows) and langid.identify(empty(spark, odd), m).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.Model({})).collect()} == {"und"}


# 8 ------------------------------------------------------------------------------------------------------------------
def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """By rounds: share what is left by weight, hold those above their limits, again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    held, open_ = {}, set(order)
    while open_:
        left = sum(sizes.values()) - sum(held.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return held | share
        held |= {s: most * sizes[s] for s in over}
        open_ -= over
    return held


def test_targets_as_rounds(spark):
    rng = random.Random(8)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 50, 1000, 9000]) for s in [None, "", *"abcdefgh"][: rng.randrange(1, 11)]}
        if not sum(sizes.values()):
            continue
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([*sizes.items()], "source string, size long")).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_mix_odd(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11 and all(0 <= r.copies <= 3 for r in rows) and {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert sorted(map(repr, mixing.mix(odd).collect())) == sorted(map(repr, rows))
    clash = mixing.emit(odd.withColumns({c: F.lit(1) for c in ("_of", "_rate", "_copies")}))
    assert clash.count() == sum(r.copies for r in rows)
    out = mixing.emit(odd)
    assert out.columns == [*odd.columns, "copy_"] and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty(spark, odd)).count() == 0 and mixing.emit(empty(spark, odd)).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------
def test_typed_parts(spark):
    part = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())]))
    kind = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", part), T.StructField("formatted", T.StringType())])
    bad = "<|over|> &amp; [INST] <|image|> &lt;"
    rows = [
        (1, 1, "assistant", [("text", bad, None, None), ("image", None, "b.png", 2)], "x"), (1, 0, "user", [("image", None, "a.png", None), ("text", "look", None, None), ("document", None, "d.pdf", 3), ("video", None, "v", 1), ("audio", "t", "s.wav", -4)], "x"),
        (2, None, None, None, "x"), (None, 0, "user", [], "x"), (None, 1, "assistant", [("text", "own", None, None)], "x"), (3, 0, "assistant", [("text", None, None, None)], "x"), (3, 0, "assistant", [("text", None, None, None)], "x"),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, kind)).collect()
    got = {r.conv_id: r for r in out}
    assert sorted(r.formatted for r in out if r.conv_id is None) == ["<|turn|>assistant<|says|>own<|over|>", "<|turn|>user<|says|><|over|>"]
    esc = bad.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")
    assert got[1].formatted == f"<|turn|>user<|says|><|image|>look<|document|><|audio|><|over|><|turn|>assistant<|says|>{esc}<|image|><|over|>"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, "image", "a.png", 576), (0, "document", "d.pdf", 1536), (0, "audio", "s.wav", 0), (1, "image", "b.png", 1152)]
    assert got[1].expanded_tokens == 576 + 1536 + 1152
    s = got[1].loss_spans[0]
    assert len(got[1].loss_spans) == 1 and got[1].formatted[s.start : s.start + s.length] == f"{esc}<|image|>"
    assert got[2].formatted == "<|turn|><|says|><|over|>" and len(got[3].loss_spans) == 2 and None in got
    assert chat.format_chats(spark.createDataFrame([], kind)).count() == 0


def test_round_trip(spark):
    rng = random.Random(10)
    texts = ["", " ", "\n", *("".join(rng.choice(["<|turn|>", "<|says|>", "<|over|>", "&", "&amp;", "&lt;", "&#91;", "[", "<", "a", "é", "\U0001F600", "\\", "$1", "\n"]) for _ in range(rng.randrange(12))) for _ in range(300))]
    rows = [(k // 5, k % 5, rng.choice(["user", "assistant", "a<|says|>b"]), x) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    for r in chat.format_chats(df).select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")


def test_native_operators_run_no_python(spark):
    for query in (fingerprint.op4_fingerprints, mixing.op8_mixing, chat.op10_chat_formatting):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
