"""Each operator against a brute-force version, the library it stands for, an exact round trip or held-out accuracy, and on edge cases."""

from __future__ import annotations

import collections
import hashlib
import html
import random
import re
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwork.llm import bpe, chat, common, fingerprints, html_text, jaccard_join, licenses, mixing, quality, queries, suffix_dedup, transport
from tarnwork.llm.components import connected_components

from ..compare import connect, same
from ..conftest import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target string"


def docs(spark, texts, start=0):
    made = [(start + i, t, "en", ["a", None, "b"][i % 3], len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(made, DOCS)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(8)
    return ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(3000)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    same(queries.queries()[name](spark, data), queries.oracle_sql()[name], connect(data))


# --- 1 licenses -------------------------------------------------------------


def brute_licenses(text, templates, threshold=0.8):
    def seq(t):
        w = re.sub(r"[^\w]|_", " ", t.lower()).split()
        return list(zip(w, w[1:], strict=False))

    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    paragraphs = re.split(r"\n *\n[ \n]*", text)
    units = text.split("\n") + [p for p in paragraphs if "\n" in p] + ([text] if len(paragraphs) > 1 else [])
    grams, found = seq(text), []
    for name, template in templates:
        known = seq(template)
        sets = [set(seq(u)) for u in units] + [set(grams[i : i + len(known)]) for i, g in enumerate(grams) if g in set(known)]
        found += [(dice(u, set(known)), name) for u in sets if u and dice(u, set(known)) >= threshold]
    best = max((d for d, _ in found), default=None)
    return (min((n for d, n in found if d == best), default=None), best, {n for _, n in found})


def test_licenses_by_brute_force(spark, words):
    rng = random.Random(12)
    body = dict(licenses.TEMPLATES)
    some = lambda k: " ".join(rng.choices(words, k=k))
    wrapped = lambda t, k: "\n".join(" ".join(t.split()[i : i + k]) for i in range(0, len(t.split()), k))
    unit = ["Released under the MIT License!", "released  under the mit licence", "Licensed under CC BY-NC 4.0.", "x", "", "one two three four", licenses.TEMPLATES[21][1].replace(" to deal", "\nto deal")]
    texts = ["\n".join(["Some words here.", u, "and more words follow"]) for u in unit] + [None, "", unit[0], unit[6]]
    # inside a line, wrapped in the middle of a paragraph, a whole text with changed words, two licenses, none
    texts += [f"{some(40)} Licensed under the MIT License. {some(40)}", wrapped(f"{some(30)} {body['Zlib']} {some(30)}", 9), body["BSD-2-Clause"].replace("HOLDERS", "OWNERS") + some(500), wrapped(f"{some(9)} {body['ISC']} {some(99)} {body['MPL-2.0']}", 13), body["MIT"][:200], some(3000), "the software " * 3000]
    made = docs(spark, texts)
    got = {r["doc_id"]: (r["license"], r["dice"], {m["license"] for m in r["matches"]}) for r in licenses.scan(made).collect()}
    for i, t in enumerate(texts):
        assert got[i][:2] == pytest.approx(want[:2] if (want := brute_licenses(t or "", licenses.TEMPLATES)) else None) and got[i][2] == want[2], t
    assert got[11][0] == "MIT" and got[12][0] == "Zlib" and {"ISC", "MPL-2.0"} <= got[14][2] and got[16][0] is None
    assert licenses.scan(made.limit(0)).count() == 0


def test_license_templates_from_files(spark, tmp_path):
    (tmp_path / "My-1.0.txt").write_text("You may do with this text whatever you like to do.")
    templates = licenses.load_templates(spark, str(tmp_path))
    assert templates == [("My-1.0", "You may do with this text whatever you like to do.")]
    got = licenses.scan(docs(spark, ["a b c you may do with this text whatever you like to do d e"]), templates).first()
    assert (got["license"], got["dice"]) == ("My-1.0", 1.0)


# --- 2 Jaccard join ---------------------------------------------------------


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(texts)
    linked = [[j for j in range(n) if j != i and sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(n)]
    return [(i, root[i], len(linked[i])) for i in range(n)]


def near_copies(words, base, n, rng):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def corpus(words):
    rng = random.Random(5)
    texts = [None, "", " ", "a b c", "a  b\nc", "a b c d"]
    texts += [" ".join(rng.choices(words, k=60)) for _ in range(20)]
    texts += [texts[8]] * 3 + near_copies(words, rng.choices(words, k=120), 90, rng)
    shared = " ".join(rng.choices(words, k=70))
    texts += [" ".join([*rng.choices(words, k=30), shared, *rng.choices(words, k=30)]) for _ in range(80)]
    return texts


def test_jaccard_join_finds_every_link(spark, words):
    texts = corpus(words)
    got = jaccard_join.join(docs(spark, texts))
    assert rows(got, "doc_id", "class_id", "n_links") == sorted(brute_links(texts), key=repr)


def test_jaccard_join_in_small_blocks(spark, words, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 100)
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 16)
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    texts = corpus(words)
    got = rows(jaccard_join.join(docs(spark, texts)), "doc_id", "class_id", "n_links")
    want = sorted(brute_links(texts), key=repr)
    assert sum(a != b for a, b in zip(got, want, strict=True)) == 0


def test_jaccard_join_repeats_runs_until_the_recall(spark, words, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RUNS", 1)
    monkeypatch.setattr(jaccard_join, "MORE_RUNS", 1)
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "SAMPLED", 500)
    rng = random.Random(15)
    texts = [x for _ in range(60) for x in near_copies(words, rng.choices(words, k=90), 2, rng)]
    done = []
    edges = jaccard_join.candidate_edges
    monkeypatch.setattr(jaccard_join, "candidate_edges", lambda nodes, runs: done.append(runs) or edges(nodes, runs))
    got = rows(jaccard_join.join(docs(spark, texts)), "doc_id", "class_id", "n_links")
    assert got == sorted(brute_links(texts), key=repr) and len(done) > 1 and done[1] == range(1, 2)


def test_shared_counts_of_very_long_texts_are_whole():
    import numpy as np

    n = 1_900_001
    a = np.arange(n, dtype=np.uint64)
    counts = jaccard_join.shared_counts([a, a[1:]], 2)
    assert counts.dtype == np.float64 and counts[0, 1] * 9 == (n - 1) * 9


def test_jaccard_join_of_a_very_long_text(spark, words):
    rng = random.Random(2)
    long = rng.choices(words, k=200_000)
    texts = [" ".join(long), " ".join(long[: len(long) * 9 // 10]), " ".join(long[: len(long) // 2]), " ".join(long)]
    assert rows(jaccard_join.join(docs(spark, texts)), "doc_id", "class_id", "n_links") == [(0, 0, 2), (1, 0, 2), (2, 2, 0), (3, 0, 2)]


@pytest.mark.parametrize("n", [99_999, 100_000, 100_001, 250_003])
def test_run_hashes_of_long_texts(n):
    from tarnwork.llm.shingles import run_hashes

    some = [str(i * i % 9973) for i in range(n)]
    got = run_hashes(some, 5)
    assert len(got) == n - 4 and got[-1] == run_hashes(some[-5:], 5)[0] and got[99_990] == run_hashes(some[99_990:99_995], 5)[0]


def test_keep_one(spark, words):
    texts = corpus(words)
    kept = jaccard_join.keep_one(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns
    assert rows(kept, "doc_id") == sorted(((i,) for i, c, _ in brute_links(texts) if i == c), key=repr)
    twice = docs(spark, ["q w e r t y u"] * 2).withColumn("doc_id", F.lit(3).cast("long"))
    assert jaccard_join.keep_one(twice).count() == 1 and jaccard_join.join(docs(spark, []).limit(0)).count() == 0


def test_jaccard_join_with_null_ids(spark, words):
    rng = random.Random(11)
    w, p = rng.choices(words, k=72), rng.choices(words, k=60)
    a, between, b = (" ".join(w[i : i + 60]) for i in (0, 6, 12))
    made = [(1, a), (None, between), (None, between), (2, b), (None, " ".join(p)), (None, " ".join(p[1:])), (7, "x y z u v"), (None, "x y z u v"), (None, "lonely words"), (None, None)]
    want = [(1, 1, 2), (None, 1, 3), (None, 1, 3), (2, 1, 2), (None, None, 1), (None, None, 1), (7, 7, 1), (None, 7, 1), (None, None, 0), (None, None, 0)]
    table = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(jaccard_join.join(table), "doc_id", "class_id", "n_links") == sorted(want, key=repr)
    kept = collections.Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(table).collect())
    assert kept.total() == 5 and kept[1, a] == kept[7, "x y z u v"] == kept[None, "lonely words"] == kept[None, None] == 1


@pytest.mark.parametrize("repeat", [False, True])
def test_keep_one_decides_by_id_and_text(spark, words, repeat):
    rng = random.Random(9)
    a, b, c, d, e, f = (" ".join(rng.choices(words, k=60)) for _ in range(6))
    near = a + " more"
    made = [(1, a), (2, near), (2, b), (3, c), (3, d), (None, e), (None, f), (None, near), (4, None), (4, None), (None, ""), (None, ""), (None, "p q r s t u"), (None, "p q r s t u"), (5, "v w x y z a"), (None, "v w x y z a")]
    gone = [(2, near), (None, near), (None, "p q r s t u"), (None, "v w x y z a")]
    table = spark.createDataFrame([(i, t, "x") for i, t in made] + [(3, d, s) for s in "zab" if repeat], "doc_id long, text string, source string")
    kept = jaccard_join.keep_one(table.repartition(3))
    want = collections.Counter(made) - collections.Counter(gone)
    assert kept.columns == table.columns and collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert [r["source"] for r in kept.where(F.col("text") == d).collect()] == ["a" if repeat else "x"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1)] + [(i, i + 1) for i in range(100, 130)], "a long, b long")
    got = dict(rows(connected_components(edges)))
    assert got[3] == 1 and got[9] == 8 and got[130] == 100 and 5 not in got


# --- 3 BPE ------------------------------------------------------------------


def test_bpe_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path), bpe.Codec(bpe.Vocabulary(bpe.load_definition(path)), remembered=500)
    rng = random.Random(2)
    letters = "aab'sd  \n\t\r\x1c\x85\xa0 　é中0१٣²½!?$*<|endoftext|>\U0001f600'll\x00"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)] + ["a" * 3000, "!" * 777, "", "<|endoftext|>" * 3, " " * 500, "The quick brown fox's tail won't fit. " * 30]
    for i in range(0, len(texts), 250):
        part = texts[i : i + 250]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert codec.encode_batch(part) == want
        assert [codec.decode(w) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want] == part


def test_bpe_remembers_a_bounded_number_of_characters(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 5000)
    codec = bpe.Codec(bpe.vocabulary_of(bpe.load_definition(public_tokenizers.path("byte_bpe_50k.json"))))
    rng = random.Random(7)
    for _ in range(40):
        texts = ["".join(rng.choices("abcdefg", k=900)) for _ in range(2)]
        assert [codec.decode(ids) for ids in codec.encode_batch(texts)] == texts
        assert sum(map(len, codec.known)) <= 5000 + 1800 and set(texts) <= set(codec.known)


def test_bpe_on_tables(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "a <|endoftext|> b", "zz", "zz", "word " * 5000]
    table = docs(spark, texts)
    encoded = bpe.encode(table, path)
    assert dict(rows(bpe.decode(encoded, path))) == {i: t or "" for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in bpe.round_trip(table, path).collect()}
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(ids[i]) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(table.limit(0), path).count() == 0


# --- 4 HTML -----------------------------------------------------------------


def lcs_length(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    kept = [x for x, k in zip(a, html_text.common_lines(a, b), strict=True) if k]
    rest = iter(b)
    assert all(x in rest for x in kept) and len(kept) == lcs_length(a, b)


def test_common_lines_in_halves(monkeypatch):
    monkeypatch.setattr(html_text, "STATE_BITS", 40)
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices(range(6), k=rng.randint(0, 40)) for _ in range(2))
        kept = [x for x, k in zip(a, html_text.common_lines(a, b), strict=True) if k]
        rest = iter(b)
        assert all(x in rest for x in kept) and len(kept) == lcs_length(a, b)


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a 'x", '<a ="', "<a =' =\"", "<div>", "<p><b>", "</span>", "<script ", "<!-- ", "< ", "<ul><li>", "<i></b>", "<table><tr><td>", "&amp;<x", "<textarea>", "<div></p>", "a\n"])
def test_html_broken_pages_take_one_pass(piece):
    import time

    page = "<p>first</p>" + piece * (1_000_000 // len(piece)) + "<p>last</p>"
    began = time.process_time()
    lines = html_text.lines_of(page)
    assert time.process_time() - began < 6 and lines[0][0] == "first"


def test_html_parsing_of_broken_markup():
    texts = lambda page: [x[0] for x in html_text.lines_of(page)]
    assert texts('<p title="a>b">one</p><p class=x title=it\'s>two</p>') == ["one", "two"]
    assert texts("<a href=o'hara>it's</a> <b x='1' y=\"'>'\" \">z</b>") == ["it's z"] and texts("<p class = 'a>b' >c<p id=\"x>d") == ["c", "d"]
    assert texts("1 < 2 <3 </ x> four<br/>five</none><!doctype x><?php y ?>six") == ["1 < 2 <3 four fivesix"]
    assert texts("<p>a<script>if (a < b) '</p>'</SCRIPT >b<!-- <p>c --> d<style>x") == ["ab d"]
    assert texts("a<b title=\"never closed>c") == ["ac"] and texts("a<b") == ["a"] and texts("<svg/>x<math><mi>y</mi></math>") == ["xy"]


def test_html_structure(spark):
    page = """<html><head><title>x</title><script>var t="</p><article>";</script></head><body><header>Site</header><nav><ul><li>a<li>b</ul></nav><div class="cookie-notice">We use</div>
    <main><article class="post"><header><h1>Tit&lt;le&nbsp;1</h1></header><p>One &amp; two<br>three<p><b>Four</b> fi<i>ve</i><aside>side</aside><ul><li>x<li>y</ul><form>Search <input> now</form><div class=ad>buy</div>
    <section id="comments"><p>nice!</p></section><p hidden>no</p><!-- <p>z</p> --></article></main><footer>&copy; f</footer></body></html>"""
    pages = spark.createDataFrame([(1, "http://h/a", page), (2, "http://h/b", None), (3, None, "<p>alone"), (4, "odd", ""), (1, "http://h/a", page)], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html_text.extract(pages).collect()]
    assert sorted(got) == [(1, "Tit<le 1\n\nOne & two three\n\nFour five\n\nx\n\ny")] * 2 + [(2, ""), (3, "alone"), (4, "")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_differencing_without_an_article_element(spark):
    page = lambda *own: "<div>Menu of the site</div>" + "".join(f"<p>{p}</p>" for p in own) + "<div>All rights reserved</div>"
    made = [(i, f"http://h/{'x' * (i % 2)}/{i}", page(f"first {i}", "said by many", f"second {i}") if i != 5 else page("only 5")) for i in range(40)] + [(99, "http://other/1", page("lonely"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[3] == "first 3\n\nsecond 3" and got[5] == "only 5" and got[99] == "Menu of the site\n\nlonely\n\nAll rights reserved"
    assert all("Menu" not in t for i, t in got.items() if i != 99)


def test_html_articles_and_what_is_around_them(spark):
    lead = lambda i: f"<main><h2>Section of the site</h2><p>lead {i}</p><article><p>one {i}</p><p>said twice</p></article><article><p>two {i}</p></article><article class=comment>no</article></main><p>out</p>"
    pages = spark.createDataFrame([(i, f"http://h/a/{i}", lead(i), "x") for i in range(6)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: f"lead {i}\n\none {i}\n\nsaid twice\n\ntwo {i}" for i in range(6)}


WHOLE = [
    ("<h1>Title</h1><article><p>Body</article>", ["Title", "Body"]),
    ("<p>Standfirst</p><main><p>A</p></main><p>B</p>", ["Standfirst", "A", "B"]),
    ("<div id=content>A</div><div class=body>B</div>", ["A", "B"]),
    ("<form id=aspnetForm><input type=hidden><nav>menu</nav><div><p>Text of the page</p></div><footer>f</footer></form>", ["Text of the page"]),
    ("<form><div class=sidebar>links</div><main><p>A</p><form>Your mail <input></form></main></form>", ["A"]),
    ("<article><p class='social-history'>a</p><div class='related work'>b</div><section class='market share'>c</section><div class='alert alpine'>d</div><p class=related>e</p></article>", list("abcde")),
    ("<article><p>a</p><div class=ad>buy</div><div class='share-buttons clearfix'>tweet</div><div id=newsletter-signup>mail</div><section class=advert2>x</section></article>", ["a"]),
    ("<div class='page-wrapper with-sidebar sidebar'><div class=sidebar>s</div><article><p>Text</p></article></div>", ["Text"]),
    ("<div class='page-wrapper with-sidebar sidebar'><p>Text without an article</p></div>", ["Text without an article"]),
    ("<p>a</p><script src=/x/>var s=1;</script><p>b</p><script src='y' />c<script/>d<div class=x/>e", ["a", "b", "cd", "e"]),
    ("<main><header><h1>T</h1></header><p>a</p></main><header>Site</header>", ["T", "a"]),
    ("<p>a</p><section class=comments><p>a long, long comment about it all, much longer than the page, and so on</p></section><div class=site-header>S</div>", ["a"]),
    ("<article><p>a</p></article><section class=comments><article><p>a comment</p></article></section>", ["a"]),
]


@pytest.mark.parametrize("page,text", WHOLE)
def test_html_drops_nothing_else(page, text):
    assert [x[0] for x in html_text.lines_of(page) if x[1]] == text


def test_html_pages_alone_keep_what_they_say(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}/", p) for i, (p, _) in enumerate(WHOLE) if "script" not in p], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: "\n\n".join(t) for i, (p, t) in enumerate(WHOLE) if "script" not in p}


def test_html_nearest_path(spark):
    page = lambda *p: "".join(f"<p>{x}</p>" for x in p)
    # 2 shares more of its path with 1 than with 3, and only 1 has its menu
    made = [(1, "http://h/a/b/c", page("menu of b", "x")), (2, "http://h/a/b/d", page("menu of b", "menu of a", "y")), (3, "http://h/a/c" + "/long" * 90, page("menu of a", "z"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[2] == "menu of a\n\ny"


def plain_lines(page):
    """Lines of the pages table by another parser: (text, whether it may be text)."""
    import html.parser

    out, parts, outside = [], [], []

    class Reader(html.parser.HTMLParser):
        def cut(self):
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and not {"title", "script", "style"} & set(outside):
                out.append((text, not outside))

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                parts.append(" ")
            elif tag != "b" and tag != "a":
                self.cut()
            if tag in ("nav", "footer", "title", "script", "style") or ("class", "ad") in attrs:
                outside.append(tag)

        def handle_endtag(self, tag):
            if tag not in ("b", "a"):
                self.cut()
            if outside and outside[-1] == tag:
                outside.pop()

        def handle_data(self, data):
            parts.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.cut()
    return out


def plain_left(lines, other):
    """What may be text of lines and is in no longest common subsequence with other; ends that agree first, then the last place from the end."""
    texts, at, end = [x[0] for x in lines], 0, 0
    while at < min(len(texts), len(other)) and texts[at] == other[at]:
        at += 1
    while end < min(len(texts), len(other)) - at and texts[-1 - end] == other[-1 - end]:
        end += 1
    x, y = texts[at : len(texts) - end], other[at : len(other) - end]
    length = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            length[i + 1][j + 1] = length[i][j] + 1 if x[i] == y[j] else max(length[i][j + 1], length[i + 1][j])
    shared, i, j = set(range(at)) | set(range(len(texts) - end, len(texts))), len(x), len(y)
    while i and length[i][j]:
        if length[i - 1][j] == length[i][j]:
            i -= 1
            continue
        shared.add(at + i - 1)
        j = next(k for k in range(j + 1) if length[i][k] == length[i][j]) - 1
        i -= 1
    assert len(shared) == at + end + length[-1][-1]
    may = [t for t, ok in lines if ok]
    return [t for k, (t, ok) in enumerate(lines) if ok and k not in shared] or may


def test_html_differencing_by_brute_force(spark, data):
    """The pages table without article elements, more pages on fewer hosts, every line by differencing."""
    made = [(r["page_id"], re.sub(r"//[^/]*", f"//h{r['page_id'] % 3}", r["url"]), re.sub("</?article>", "", r["html"])) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    made += [(i + 1000, u.replace("?", "/x?"), re.sub("<p>", "<p>Same start. </p><p>", h, count=1)) for i, u, h in made]
    made += [(i + 5000, u + "y", re.sub(r"(<p>.{20})", r"<p>Again.</p>\1", h)) for i, u, h in made[:50]]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    split = lambda u: re.match(r"[a-z]+://([^/?#]*)([^?#]*)", u).groups()
    path = lambda u: re.sub(r"(/|\.html?)$", "", split(u)[1])
    for host in {split(u)[0] for _, u, _ in made}:
        own = sorted((path(u), f"{i:020d}", i, h) for i, u, h in made if split(u)[0] == host)
        for k, (p, _, i, h) in enumerate(own):

            def far(j):
                a, b = p.split("/"), own[j][0].split("/")
                same = next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
                return (-same, abs(len(a) - len(b)), j)

            near = min((j for j in (k - 1, k + 1) if 0 <= j < len(own)), key=far)
            assert got[i] == "\n\n".join(plain_left(plain_lines(h), [x[0] for x in plain_lines(own[near][3])]))


def test_html_on_the_pages_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.query(spark, data).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


# --- 5 fingerprints ---------------------------------------------------------


def brute_fingerprint(text, samples):
    import math

    import xxhash

    signed = lambda n: n - 2**64 if n >= 2**63 else n
    counts = collections.Counter(w for w in re.split("[ \t-\r]+", text) if w)
    out = []
    for k in range(samples):
        best = None
        for w, c in counts.items():
            term = xxhash.xxh64(w.encode(), seed=42).intdigest()
            h = xxhash.xxh64(struct.pack("<i", k), seed=xxhash.xxh64(struct.pack("<Q", term), seed=42).intdigest()).intdigest()
            odd = lambda at: (h >> at & 0xFFF) + 0.5  # noqa: B023, E731
            gamma = lambda at: 2 * math.log(4096.0) - math.log(odd(at) * odd(at + 12))  # noqa: B023, E731
            r, log_c, b = gamma(0), math.log(gamma(24)), (h >> 48) * 2.0**-16
            t = math.floor(math.log(c) / r + b)
            level = int((log_c - r * (t - b + 1.0) + 96.0) * 2.0**25)
            pair = (signed(h) ^ t * 1_000_003) & (2**31 - 1)
            best = min(best or (level, pair), (level, pair))
        out.append(best[1] if best else fingerprints.NO_TERM)
    return out


def test_fingerprints_by_brute_force(spark, words):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(words[:200], k=rng.randint(0, 80))) for _ in range(40)] + [None, "", " \n ", "é ü é", "x", "x", "long " * 30_000]
    made = docs(spark, texts)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(made).collect()}
    order = sorted(range(len(texts)), reverse=True)
    text = lambda i: texts[i] or ""
    for place, i in enumerate(order):
        following = order[(place + 1) % len(order)]
        n = len(text(i))
        edited = text(i)[: n - n // 2] + text(following)[: n // 2]
        own, other, nxt = (brute_fingerprint(x, fingerprints.SAMPLES) for x in (text(i), edited, text(following)))
        share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in own) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in other)
        assert (r["near_edited"], r["near_next"]) == (share(own, other), share(own, nxt))
    assert fingerprints.edited_fingerprints(made.limit(0)).count() == 0
    alone = fingerprints.edited_fingerprints(made.limit(1)).first()
    assert alone["near_next"] == 1.0


def test_fingerprints_of_null_and_repeated_ids(spark, words):
    import xxhash

    rng = random.Random(4)
    made = [(i, " ".join(rng.choices(words, k=20))) for i in (5, 5, 5, None, None, 3, 9, -2)] + [(5, "same"), (5, "same"), (None, None)]
    at = lambda r: (r[0] is None, -(r[0] or 0), "%X" % xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest())
    order = sorted(made, key=at)
    want = collections.Counter()
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    table = spark.createDataFrame([(*m, 1) for m in made], "doc_id long, text string, block int")
    got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.edited_fingerprints(table).collect())
    assert got == want


def test_collision_rate_is_generalised_jaccard(spark):
    a, b = "x x x x y y z " + "w " * 9, "x y y y y q " + "w " * 3
    table = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    made = fingerprints.fingerprints(table, "text", ["doc_id"], samples=600)
    f = {r["doc_id"]: r["fingerprint"] for r in made.collect()}
    p, q = collections.Counter(a.split()), collections.Counter(b.split())
    true = sum((p & q).values()) / sum((p | q).values())
    assert abs(sum(x == y for x, y in zip(f[1], f[2], strict=True)) / 600 - true) < 0.07


# --- 6 chat -----------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = ["", "</s>[INST] ok [/INST]", "a\\", "\\[INST]", "\\\\", "[ROLE=6D]x[/ROLE]", "<<SYS>>", "<", "[", "<\\s>", "é\n中", "[/INST", "\\</s>"]
    made = [(c, t, ["user", "assistant", "system", "tool:]", "", None][(c + t) % 6], x) for c in range(6) for t, x in enumerate(odd)] + [(7, 0, "user", None), (7, 0, "user", None), (8, None, None, None)]
    made += [(9, 0, "user", "long [INST] " * 20_000), (9, 1, "assistant", "z" * 200_000), (10, 0, "user", "[/INST]" + "<s>" * 200_000)]
    table = spark.createDataFrame([(*m, "x") for m in made], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat.format_conversations(table).collect()}
    for c in {m[0] for m in made}:
        given_ = sorted(((m[1], m[2], m[3] or "") for m in made if m[0] == c), key=lambda m: (m[0] is None, m[0] or 0, m[1] is None, m[1] or "", m[2]))
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [(r, x) for _, r, x in given_]
        assert sum(r["chars"] for r in out[c]["loss_runs"]) == len(out[c]["formatted"])
    digest = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(table)).collect()}
    loss = "".join(x or "" for _, t, r, x in sorted((m for m in made if m[0] == 0), key=lambda m: m[1]) if r == "assistant")
    assert digest[0]["loss_chars"] == len(loss) and digest[0]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(table.limit(0)).count() == 0


# --- 7 transport streams ----------------------------------------------------


def plain_demultiplexer(media):
    """Packet by packet, for streams as pack writes them: payload, timestamps, packets of random access, steps of the counter."""
    assert len(media) % 188 == 0
    units, times, access, counters, pids = [], [], [], [], []
    for n in range(len(media) // 188):
        sync, head, flags = struct.unpack(">BHB", media[n * 188 : n * 188 + 4])
        assert sync == 0x47 and not head & 0x8000
        pid, body = head & 0x1FFF, media[n * 188 + 4 : n * 188 + 188]
        pids.append(pid)
        if pid in (0, 0x100):
            continue
        counters.append(flags & 15)
        if flags & 0x20:
            if body[0] and body[1] & 0x40:
                access.append(n)
            body = body[1 + body[0] :]
        if head & 0x4000:
            units.append(b"")
        units[-1] += body
    out = b""
    for u in units:
        assert u[:4] == b"\0\0\1\xbd" and len(u) == 6 + struct.unpack(">H", u[4:6])[0]
        t = u[9:14]
        times.append((t[0] >> 1 & 7) << 30 | (t[1] << 8 | t[2]) >> 1 << 15 | (t[3] << 8 | t[4]) >> 1)
        out += u[9 + u[8] :]
    return out, times, access, [(b - a) % 16 for a, b in zip(counters, counters[1:], strict=False)], pids


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_transport_round_trip(payload):
    data = transport.pad(payload)
    assert len(data) % 192 == 0 and len(data) > 0 and data.startswith(payload)
    (e,) = transport.unpack(transport.pack(data)).streams
    assert e.payload == data and e.continuity_errors == e.broken_units == 0 and e.program == 1


@pytest.mark.parametrize("n", [0, 1, 12_287, 12_288, 12_289, 300_000])
def test_transport_by_another_parser(n):
    data = transport.pad(random.Random(n).randbytes(n))
    media = transport.pack(data)
    out, times, access, steps, pids = plain_demultiplexer(media)
    assert out == data and set(steps) <= {1} and pids[:2] == [0, 0x100]
    (e,) = transport.unpack(media).streams
    assert (e.payload, e.timestamps, e.random_access) == (out, times, access) and times == [i * transport.UNIT_TICKS for i in range(-(-len(data) // transport.UNIT_BYTES))]


def ts_packet(pid, counter, data, start=False, field=None, payload=True):
    """One transport packet, filled up by its adaptation field."""
    room = 184 - len(data)
    if field is None and room:
        field = b"" if room == 1 else b"\0"
    if field is not None:
        field = bytes([room - 1]) + field.ljust(room - 1, b"\xff") if room else b""
    head = struct.pack(">BHB", 0x47, (0x4000 if start else 0) | pid, (0x20 if field else 0) | (0x10 if payload else 0) | counter)
    made = head + (field or b"") + data
    assert len(made) == 188
    return made


def ts_sections(pid, sections):
    """Sections one after another, over as many packets as they take."""
    data, out = b"\0" + b"".join(sections), []
    while data:
        out.append(struct.pack(">BHB", 0x47, (0x4000 if not out else 0) | pid, 0x10 | len(out)) + data[:184].ljust(184, b"\xff"))
        data = data[184:]
    return b"".join(out)


def pes(payload, pts=None, dts=None, length=True):
    stamp = lambda mark, t: bytes([mark << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])
    times = (b"" if pts is None else stamp(3 if dts is not None else 2, pts)) + (b"" if dts is None else stamp(1, dts))
    rest = bytes([0x80, (0 if pts is None else 0x80) | (0 if dts is None else 0x40), len(times)]) + times + payload
    return b"\0\0\1\xe0" + struct.pack(">H", len(rest) if length else 0) + rest


def test_transport_streams_of_others():
    program = lambda n, pid: struct.pack(">HH", n, 0xE000 | pid)
    # 60 programs: the table takes two packets; a network entry; only two of them have maps
    pat = transport._section(0x00, 1, program(0, 16) + program(1, 0x200) + program(2, 0x201) + b"".join(program(n, 0x300) for n in range(3, 60)))
    entry = lambda kind, pid, info=b"": bytes([kind]) + struct.pack(">HH", 0xE000 | pid, 0xF000 | len(info)) + info
    pmt = lambda n, *entries: transport._section(0x02, n, struct.pack(">HH", 0xE000 | 0x101, 0xF000) + b"".join(entries))
    first = pes(b"a" * 300, 90_000, 87_000)
    second, third = pes(b"b" * 150, None), pes(b"c" * 500, 2**33 - 1, length=False)
    video = [
        ts_packet(0x111, 14, first[:100], True, b"\x40"), ts_packet(0x111, 14, b"", field=b"\0", payload=False), ts_packet(0x111, 15, first[100:284]), ts_packet(0x111, 15, first[100:284]), ts_packet(0x111, 0, first[284:]),
        ts_packet(0x111, 7, second, True, b"\x80"), ts_packet(0x111, 8, third[:184], True), ts_packet(0x111, 9, third[184:368]), ts_packet(0x111, 10, third[368:]),
    ]
    lost = pes(b"d" * 400, 5)
    audio = [ts_packet(0x112, 3, lost[:184], True), ts_packet(0x112, 5, lost[368:]), ts_packet(0x112, 6, pes(b"e" * 9, 6), True)]
    null = ts_packet(0x1FFF, 0, b"n" * 184)
    mixed = [x for pair in zip(video, audio + [null] * 6, strict=True) for x in pair]
    media = b"junk" + ts_sections(0, [pat]) + ts_sections(0x200, [pmt(1, entry(0x1B, 0x111, b"\x0a\x04eng\0"), entry(0x0F, 0x112))]) + b"".join(mixed) + ts_sections(0x201, [pmt(2, entry(6, 0x113))]) + b"half a packet"
    s = transport.unpack(media)
    assert [(e.program, e.pid, e.stream_type) for e in s.streams] == [(1, 0x111, 0x1B), (1, 0x112, 0x0F), (2, 0x113, 6)] and s.lost_packets == 0
    v, a, none = s.streams
    assert v.payload == b"a" * 300 + b"b" * 150 + b"c" * 500 and v.timestamps == [90_000, -1, 2**33 - 1] and v.decode_timestamps == [87_000, -1, -1]
    assert (v.continuity_errors, v.repeated_packets, v.broken_units, len(v.random_access)) == (0, 1, 0, 1)
    assert (a.payload, a.timestamps, a.continuity_errors, a.broken_units) == (b"e" * 9, [6], 1, 1)
    assert none.payload == b"" and none.timestamps == []


def test_transport_damage():
    media = bytearray(transport.pack(transport.pad(random.Random(1).randbytes(5000))))
    media[188 * 4 + 3] ^= 1
    assert transport.unpack(bytes(media)).streams[0].continuity_errors == 2
    media[188 * 8 + 1] |= 0x80
    hit = transport.unpack(bytes(media))
    assert hit.lost_packets == 1 and hit.streams[0].broken_units == 1 and hit.streams[0].payload == b""
    for broken in (b"", b"\x00" * 188, bytes(media[188 * 2 :]), bytes(media[:188])):
        with pytest.raises(ValueError):
            transport.unpack(broken)


def test_transport_on_tables(spark):
    texts = [None, "", "é" * 96, "a", "a", "b" * 100_000]
    table = transport.write_media(docs(spark, texts))
    got = {r["doc_id"]: r for r in transport.describe_media(table).collect()}
    for i, t in enumerate(texts):
        data = transport.pad((t or "").encode())
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len((t or "").encode()), len(data))
        assert got[i]["payload_sha256"] == hashlib.sha256(data).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(data[-16:])
        assert got[i]["timestamps"] == [k * transport.UNIT_TICKS for k in range(len(got[i]["random_access"]))] and got[i]["error"] is None
    assert got[3]["media_sha256"] == got[4]["media_sha256"] and {bytes(r["payload"]) for r in transport.read_media(table).collect()} == {transport.pad((t or "").encode()) for t in texts}
    assert transport.describe_media(table.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"no stream")), (3, 0, bytearray(transport.pack(b"ok")))], "doc_id long, n_bytes long, media binary")
    read = {r["doc_id"]: r for r in transport.read_media(odd).collect()}
    assert read[1]["error"] == read[2]["error"] == "no packets" and bytes(read[3]["payload"]) == b"ok" and read[3]["error"] is None
    assert {r["doc_id"]: r["error"] for r in transport.describe_media(odd).collect()} == {1: "no packets", 2: "no packets", 3: None}


# --- 8 mixing ---------------------------------------------------------------


def test_mixing_shares_and_copies(spark):
    made = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10)] * 50 + [("b", 10)] * 500 + [(None, 7)] * 300 + [("c", 0)] * 5)] + [(999, None, "d")]
    table = spark.createDataFrame([(*m, 9) for m in made], "doc_id long, text string, source string, target long")
    report = mixing.mix_report(table)
    sizes = collections.Counter()
    for _, t, s in made:
        sizes[s] += len((t or "").split())
    order, weights = ["a", "b", "c", "d", None], [5, 2, 1, 5, 2]
    want, left = {}, float(sum(sizes.values()))
    free = set(order)
    while True:
        level = left / sum(w for s, w in zip(order, weights, strict=True) if s in free)
        over = {s for s, w in zip(order, weights, strict=True) if s in free and w * level > 3 * sizes[s]}
        if not over:
            want |= {s: w * level for s, w in zip(order, weights, strict=True) if s in free}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    source = {m[0]: m[2] for m in made}
    taken = collections.Counter()
    for r in report.collect():
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]] and r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.15 * max(want[s], 1) + 1e-9 for s in order)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == {r["doc_id"]: r["copies"] for r in report.collect() if r["copies"]}
    assert rows(report) == rows(mixing.mix_report(table.repartition(5))) and mixing.mix_report(table.limit(0)).count() == 0


def test_mixing_of_odd_rows(spark):
    made = [(None, "a b c", "s"), (None, "d e f g", "s"), (1, "h", "s"), (1, "h", "s"), (2, None, None), (3, "", "t"), (4, "i j " * 40_000, "u")]
    report = mixing.mix_report(spark.createDataFrame(made, "doc_id long, text string, source string"))
    got = sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in report.collect())
    assert got == sorted([("None", 3, 9), ("None", 4, 9), ("1", 1, 9), ("1", 1, 9), ("2", 0, 0), ("3", 0, 0), ("4", 80_000, 80_000)])
    assert all(r["taken"] <= 3 * r["size"] for r in report.collect())
    zero = mixing.mix_report(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string"))
    assert [r["target"] for r in zero.collect()] == [0.0, 0.0]


@pytest.mark.parametrize("small", [False, True])
def test_mixing_comes_near_its_target_where_rows_repeat(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    made = [(None, "same " * 50, "a")] * 3000 + [(None, f"text {i} " * 25, "b") for i in range(3000)] + [(7, "of one id " * 17, "c")] * 3000 + [(i, "x " * 50, "d") for i in range(3000)] + [(i % 2, "y " * 50, None) for i in range(3000)]
    table = spark.createDataFrame(made, "doc_id long, text string, source string")
    report = mixing.mix_report(table)
    # sources of one weight have one target and are held together
    by = report.groupBy("target").agg(F.sum("taken").alias("taken"), (F.sum("size") / F.first("source_size")).alias("sources")).collect()
    assert all(abs(r["taken"] / (r["target"] * r["sources"]) - 1) < 0.05 for r in by)
    assert report.count() == len(made) and mixing.mix(table).count() == report.agg(F.sum("copies")).first()[0]


def test_mixing_takes_each_document_at_its_rate_on_average(spark):
    """Over seeds, documents of every size class have floor(rate) copies plus the fraction."""
    rng = random.Random(4)
    table = spark.createDataFrame([(i, "w " * rng.choice([3, 20, 150, 700, 2500]), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string").cache()
    means = collections.defaultdict(list)
    for seed in range(4):
        for r in mixing.mix_report(table, seed=seed).collect():
            means["abc"[r["doc_id"] % 3], r["size"]].append((r["copies"], r["target"] / r["source_size"]))
    for got in means.values():
        rate = got[0][1]
        assert abs(sum(c for c, _ in got) / len(got) - rate) < 4 * (0.25 / len(got)) ** 0.5 + 0.02
        assert {c for c, _ in got} <= {int(rate), int(rate) + 1}


def test_mixing_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    made = [(i, "w " * (i % 7), f"s{i % 40}" if i % 3 else "hot") for i in range(600)] + [(-1, "x y", None)]
    table = spark.createDataFrame(made, "doc_id long, text string, source string")
    report = rows(mixing.mix_report(table))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10_000)
    assert report == rows(mixing.mix_report(table)) and len(report) == 601


# --- 9 quality --------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    scored = quality.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    got = scored.select("quality", "predicted").toPandas()
    assert (got["quality"] == got["predicted"]).mean() >= 0.9
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in scored.select("doc_id").collect())


def test_quality_edge_cases(spark, words):
    table = docs(spark, [None, "", "a b", "x " * 50_000, "!!! ???", "a b"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["__tw_score"] for r in quality.score(table, none).collect()} == {1.0}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)] + [(2, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(table, labels)
    assert got.columns[:-1] == table.columns and all(0 <= r["__tw_score"] <= 1 for r in got.collect()) and quality.keep_good(table.limit(0), labels).count() == 0
    x = quality.features(["", "a", "!", None])
    assert x.shape == (4, quality.N_FEATURES) and x[:, 0].tolist() == [1, 0, 0, 1]
    zeros = labels.withColumn("quality", F.lit(0))
    assert {r["__tw_score"] for r in quality.score(table, zeros).collect()} == {0.0}
    again = table.union(table).union(table.withColumn("doc_id", F.lit(None).cast("long")))
    assert quality.score(again, labels).count() == 18


def brute_features(text):
    x = dict.fromkeys(range(20), 0.0)
    words, lines = re.split("[ \t-\r]+", text.strip(" \t\n\v\f\r")), [s for s in text.split("\n") if s]
    pairs, triples = list(zip(words, words[1:], strict=False)), list(zip(words, words[1:], words[2:], strict=False))
    letters = sum(c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text)
    x[1] = sum("A" <= c <= "Z" for c in text) / max(letters, 1)
    x[2] = sum("0" <= c <= "9" for c in text) / len(text)
    x[8] = sum(a == b for a, b in pairs) / len(words)
    x[9], x[10] = 1 - len(set(pairs)) / max(len(pairs), 1), 1 - len(set(triples)) / max(len(triples), 1)
    x[13] = sum(w[-1] == "." for w in words) / len(words)
    x[14] = 1 - len(set(lines)) / len(lines)
    x[16] = len(set(words)) / len(words) ** 0.9
    x[7] = max(len(w.encode()) for w in words) / 50
    return x


def test_quality_features_by_brute_force(words):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([*words[:40], "A.", "É", "X1", "\n", "ABC"], k=rng.randint(1, 60))).strip() or "x" for _ in range(50)]
    got = quality.features(texts)
    for t, x in zip(texts, got, strict=True):
        for i, v in brute_features(t).items():
            if i in (1, 2, 7, 8, 9, 10, 13, 14, 16):
                assert x[i] == pytest.approx(v, abs=1e-5), (i, t)
        assert x[quality.N_STATISTICS :].sum() == pytest.approx(2, abs=1e-4)
    # texts do not depend on their batch, nor counts on the pieces of a text
    assert (quality.features(texts[7:9]) == got[7:9]).all()


def test_quality_features_of_a_very_long_text(words, monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choices(words, k=2000))
    whole = quality.features([text])
    monkeypatch.setattr(quality, "CHUNK", 1000)
    pieces = quality.features([text])
    assert abs(whole - pieces)[0, [1, 2, 5, 6, 7, 11, 12, 13]].max() < 1e-6
    assert abs(whole - pieces)[0, quality.N_STATISTICS : quality.N_STATISTICS + quality.WORD_BUCKETS].max() < 1e-6


def test_quality_risk_and_its_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, (30, 6)), rng.normal(0, 1, (40, 6))
    layers = [rng.normal(0, 0.5, (6, 4)), rng.normal(0, 0.5, 4), rng.normal(0, 1, 4), np.zeros(1)]
    loss = lambda z: 1 / (1 + np.exp(z))
    g = lambda x: np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3][0]
    for prior in (0.3, 0.6):
        rest = loss(-g(u)).mean() - prior * loss(-g(p)).mean()
        risk, step = quality.risk_and_step(layers, p, u, prior)
        assert risk == pytest.approx(prior * loss(g(p)).mean() + max(0, rest))
        target = (lambda: prior * loss(g(p)).mean() + loss(-g(u)).mean() - prior * loss(-g(p)).mean()) if rest >= 0 else (lambda: prior * loss(-g(p)).mean() - loss(-g(u)).mean())  # noqa: B023, E731
        for w, d in zip(layers, step, strict=True):
            flat, slope = w.reshape(-1), d.reshape(-1)
            for i in range(len(flat)):
                flat[i] += 1e-5
                high = target()
                flat[i] -= 2e-5
                low = target()
                flat[i] += 1e-5
                assert slope[i] == pytest.approx((high - low) / 2e-5, abs=1e-6)


def test_quality_prior_from_positives_and_unlabelled():
    import numpy as np

    rng = np.random.default_rng(1)
    made = lambda shift, n: np.abs(rng.normal(shift, 0.3, (n, quality.N_FEATURES))).astype(np.float32)
    for share in (0.2, 0.5, 0.8):
        n = int(3000 * share)
        u = np.vstack((made(2.0, n), made(1.0, 3000 - n)))
        assert abs(quality.estimated_prior(made(2.0, 2000), rng.permutation(u)) - share) < 0.1


# --- 10 suffix arrays -------------------------------------------------------


def brute_repeats(texts, n=suffix_dedup.MIN_WORDS):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        marked = [False] * len(w)
        for a in range(len(w) - n + 1):
            key = tuple(w[a : a + n])
            if key in seen:
                marked[a : a + n] = [True] * n
            seen.add(key)
        spans, a = [], 0
        while a < len(w):
            b = a
            while b < len(w) and marked[b]:
                b += 1
            if b > a:
                spans.append((a, b))
            a = b + 1
        out[i] = spans
    return out


def passages(words):
    rng = random.Random(6)
    shared = [rng.choices(words, k=k) for k in (49, 50, 51, 70, 200)]
    texts = [None, "", "a b"]
    for i in range(60):
        w = rng.choices(words, k=rng.randint(0, 90))
        for p in rng.sample(shared, k=i % 3):
            at = rng.randint(0, len(w))
            w[at:at] = p[rng.randint(0, 2) :]
        texts.append(" ".join(w))
    return [*texts, texts[20], texts[20], "so it goes " * 60, "so it goes " * 90, "u " * 300, " ".join(shared[4][:60] + shared[4][:60])]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_repeats_by_brute_force(spark, words, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = passages(words)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix_dedup.repeats(docs(spark, texts)).collect()}
    assert got == brute_repeats(texts)


def test_suffix_cut_keeps_the_rest(spark, words):
    texts = passages(words)
    table = docs(spark, texts)
    cleaned = suffix_dedup.clean(table)
    want = brute_repeats(texts)
    assert cleaned.columns == table.columns
    for r in cleaned.collect():
        w = (texts[r["doc_id"]] or "").split()
        left = [x for i, x in enumerate(w) if not any(a <= i < b for a, b in want[r["doc_id"]])]
        assert (r["text"] or "").split() == left and r["n_chars"] == len(r["text"] or "")
    long = [str(i) for i in range(120_000)]
    again = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix_dedup.repeats(docs(spark, [" ".join(long), " ".join(["x", *long[110_000:]])])).collect()}
    assert again == {0: [], 1: [(1, 10_001)]}
    nulls = docs(spark, texts[:30]).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    spans = suffix_dedup.repeats(nulls)
    assert spans.count() == 30 and suffix_dedup.clean(nulls).count() == 30
    twice = table.union(table.limit(30))
    assert suffix_dedup.clean(twice).count() == twice.count() and suffix_dedup.repeats(table.limit(0)).count() == 0
    assert suffix_dedup.cut("a  b\nc d", [(1, 3)]) == "a  d"
