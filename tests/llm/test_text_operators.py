"""Operators that work row by row: extraction, BPE, licences, urls, packing."""

import hashlib
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattiq.llm import bpe, html, licences, packing, urls

PATH, JSON, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
LONG = "don't  stop \n\n\n 1234567 übergrößen… " * 40
DOCS = "doc_id long, text string, key string, label int, ids string, host string"
ROWS = [(1, "a b", "k", 1, "x", None), (2, None, None, None, None, None), (3, "", "k", 0, "", "h"), (4, LONG, "k", 1, "x", "h"), (4, LONG, "k", 1, "x", "h"), (4, LONG + "!", "k", 1, "x", "h"), (None, "c d", None, None, None, None), (5, " " * 3000 + "x", "", 1, "", ""), (6, "7" * 2999, "", 1, "", "")]


def test_extraction_trains_a_tree_that_fits_its_table():
    assert all((html.decide(html.tree(), x) >= 0.5) == bool(y) for x, y in html.labelled())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four</article><footer>(c)</footer>", "A & B\none two three\nfour"),
        ("", ""),
        ("<p>plain words only here", "plain words only here"),
        ("<article><script>var t='</p>'</script><p>x &lt;y&gt; &eacute;&#8217;</p><!-- <p>no</p> --></article>", "x <y> é’"),
        ("<article><p>kept</p><div class='ad'>buy this now</div></article><section id=comments><p>" + "word " * 50 + "</p></section>", "kept"),
        ("<main><p>un<b>bro</b>ken</p><form><p>write to us</p></form></main><aside>" + "side " * 60 + "</aside>", "unbroken"),
        ("<p>Welcome to our site</p><div id=content><p>kept text</p><span class=text>more</span></div><p>All rights reserved by somebody</p>", "kept text\nmore"),
        ("<nav><a><span class=text>Home</span></a></nav><form id=aspnet><main><p>kept</p></main></form><div class='post-comments'><div class=body><p>" + "word " * 40 + "</p></div></div>", "kept"),
        ("<article><p>cut off</p><p class=\"x", "cut off"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


WORDS = "one two three four five six seven eight nine ten "
NEUTRAL = f"<div>{WORDS * 2}</div><div><a>Home</a></div><div><a>News</a> <a>Contact us</a></div><div>The title of a page</div><div>first {WORDS * 5}</div><div>second {WORDS * 4}</div><div><a>More</a> <a>Older</a></div><div>\u00a9 Somebody 2024</div>"


@pytest.mark.parametrize("tag", ["div", "p"])
def test_neutral_markup_is_told_by_lengths_and_links(tag):
    lines = html.main_text(NEUTRAL.replace("div", tag)).split("\n")
    assert [x.split()[0] for x in lines] == ["The", "first", "second"]


def test_neighbours_decide():
    """A tree grown without the neighbours' numbers gives other results."""
    rows = html.labelled()
    of_neighbours = [i for i, n in enumerate(html.NAMES) if n.startswith(("before", "after", "second"))]
    blind = html.grow([(tuple(0.0 if i in of_neighbours else v for i, v in enumerate(x)), y) for x, y in rows])
    wrong = sum((html.decide(blind, tuple(0.0 if i in of_neighbours else v for i, v in enumerate(x))) >= 0.5) != bool(y) for x, y in rows)
    assert wrong > 10


def test_no_depth_limit():
    deep = "<article><p>kept text</p>" + "<div>" * 450 + "<aside>words beside</aside>" + "</div>" * 450 + "<p>more of it</p></article>"
    assert html.main_text(deep) == "kept text\nmore of it"


@pytest.mark.parametrize("page", [lambda n: "<a " * n + "<b \"" * n, lambda n: "<svg>" * n, lambda n: "<u><div>" + "<b>" * n + "</u>" * n, lambda n: "<article>" * n, lambda n: "<div>" * n + "</b>" * n, lambda n: "<!" * n, lambda n: "<li><span>" * n])
def test_markup_without_end_takes_linear_time(page):
    began = time.perf_counter()
    html.main_text(page(20000))
    assert time.perf_counter() - began < 8


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>some words of text</p>", "y"), (1, "u", "", "z"), (2, None, "<article><p>𝔘 é</p></article>", "z")], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "some words of text", 18), (1, "", 0), (1, "", 0), (2, "𝔘 é", 3)]
    assert html.extract(pages.limit(0)).count() == 0


def ids_of(text):
    return bpe.codec(PATH, PATTERN)[0].encode_ordinary(text or "")


@pytest.mark.parametrize("chunk", [64, 1000, 32768])
def test_chunked_encoding_is_that_of_the_whole(spark, chunk):
    docs = spark.createDataFrame(ROWS, DOCS)
    coded = bpe.encode(docs, PATH, PATTERN, chunk_chars=chunk, overlap=32)
    got = sorted((r.doc_id or 0, r.ids, r.bytes) for r in bpe.decode(coded, PATH, PATTERN).collect())
    assert got == sorted((i or 0, bytearray(np.array(ids_of(t), "<u4").tobytes()), bytearray((t or "").encode())) for i, t, *_ in ROWS)
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab 1\n't.é sLl", max_size=200), st.integers(8, 40), st.integers(4, 24))
def test_stitched_pieces_encode_alone(text, chunk, overlap):
    pattern = regex.compile(PATTERN)
    chunks = []
    for start in range(0, len(text), chunk):
        body = text[start : start + chunk + overlap]
        found = bpe.boundaries(pattern, body, start, start, start + len(body) - bpe.GUARD)
        chunks.append((start, body, [b for b in found if b < start + overlap] if start else [], [b for b in found if b >= start + chunk] if start + chunk < len(text) else []))
    pieces = bpe.stitched(chunks, pattern, chunk) if chunks else []
    assert "".join(pieces) == text
    assert [i for p in pieces for i in ids_of(p)] == ids_of(text)


def test_special_strings_and_json_vocabulary():
    encoding, tokens = bpe.codec(JSON, PATTERN)
    own = Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    for text in ("<|endoftext|> Hello,  wörld\n\n 12345 ''s", LONG):
        ids = bpe.encode_text(encoding, text).tolist()
        assert ids == own.encode(text, add_special_tokens=False).ids
        assert b"".join(tokens[i] for i in ids).decode() == text
    assert bpe.encode_text(encoding, "a\ud800b").tolist() == own.encode("a\ufffdb", add_special_tokens=False).ids


def test_licences(spark):
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT License!\nno", "l"), (2, None, None), (3, "", ""), (1, "x\nReleased under the MIT License!\nno", "l"), (None, "RELEASED under the mit-license", "m"), (4, "word " * 20000, ""), (5, "license", ""), (6, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "")], "doc_id long, text string, licence string")
    got = {(r.doc_id, r.licence, r.n_matches, r.licences): round(r.dice, 3) for r in licences.summary(licences.scan(docs)).collect()}
    assert got[(1, "MIT", 1, "MIT")] == 1.0
    assert got[(None, "MIT", 1, "MIT")] == 1.0
    assert got[(6, "Apache-2.0", 2, "Apache-2.0,CC-BY-NC-4.0")] == 1.0
    assert {k for k, v in got.items() if v == 0} == {(i, None, 0, "") for i in (2, 3, 4, 5)}
    assert licences.scan(docs).count() == 8 and licences.scan(docs.limit(0)).count() == 0


def test_licence_threshold_is_that_of_brute_force(spark):
    names = licences.known(licences.TEMPLATES)
    lines = ["Released under the new MIT License", "This work is licensed under the GNU General Public License", "Licensed under the License", "under the Apache License, Version 2.0 or later"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for row in licences.scan(docs, threshold=0.6).collect():
        own = regex.sub(licences.NOT_WORD, " ", lines[row.doc_id].lower()).split()
        own = {f"{a} {b}" for a, b in zip(own, own[1:])}
        best = max(2 * len(own & set(b)) / (len(own) + len(b)) for _, b in names)
        assert [round(m.dice, 9) for m in row.matches] == ([round(best, 9)] if best >= 0.6 else [])


def test_wrapped_and_embedded_licences(spark):
    wrapped = {name: textwrap.fill(wording, 80) for name, wording in licences.TEMPLATES if len(wording) > 200}
    texts = [
        *(f"Copyright 2020 Foo.\n\n{text}\n\nother words" for text in wrapped.values()),
        "Copyright 2020 Foo. Released under the MIT License.",
        "some words of a paragraph " * 5 + "Released under the MIT License. " + "and some more of them " * 5,
        "Released under the\nMIT License.\nx\nReleased under the MIT License.\nLicensed under CC BY 4.0. Released under the MIT License.",
        "under the license of the mit " * 2000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(m.line, m.licence, m.dice) for m in r.matches] for r in licences.scan(docs).collect()}
    n = len(wrapped)
    assert [got[i] for i in range(n)] == [[(3, name, 1.0)] for name in wrapped]
    assert got[n] == got[n + 1] == [(1, "MIT", 1.0)]
    assert got[n + 2] == [(1, "MIT", 1.0), (4, "MIT", 1.0), (5, "CC-BY-4.0", 1.0), (5, "MIT", 1.0)]
    assert got[n + 3] == []


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("example.com", "/en/", "allow"), (None, "/", "block")]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = regex.split("[/?#]", rest)[0]
    path = regex.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, "block" if (h, p) == ("example.com", "/en/") else v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = ["http://example.com/en/1", "https://WWW.Example.com/en/?x=/fr/", "http://a.b.net/es/#t", "http://net/fr/", "http://com", "http://com/", "http://xcom/", "http://example.com:80/en/", None, "", "no scheme.com/", "http://", "http://É.com/x", "http://notexample.com/en/", "http://a..com/", "http://example.com./en/", "x://y://z.com/en/", "http://www.example.com\n/en/", "http://user@example.com/en/", "http://a.net/es"] + ["http://hot.example.com/en/" + "p" * 5000] * 30


@pytest.mark.parametrize("ranges", [1, 64])
def test_urls(spark, ranges, monkeypatch):
    rules = RULES if ranges == 1 else RULES + [(f"h{i}.org", f"/{i % 3}", "block") for i in range(200)]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)] + [(None, URLS[0], "k")], "page_id long, url string, key string")
    rows = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id is not None) == [(i, *expected(u)) for i, u in enumerate(URLS)]
    assert len(rows) == len(URLS) + 1
    assert urls.judge(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urls.judge(pages, none, "block").collect()] == [(1, "a.com", "/", None, "block")]


def one_by_one(lengths, capacity):
    """Best-fit decreasing without classes or a tree."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_runs_are_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    used = {}
    for length, rank, each, first, offset in (runs := packing.plan(counts, 40)):
        following = [r for r in runs if r[0] == length and r[1] > rank]
        for j in range(min((r[1] for r in following), default=counts[length]) - rank):
            used.setdefault(first + j // each, []).append((offset + j % each * length, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(40 - sum(n for _, n in parts) for parts in used.values()) == one_by_one(lengths, 40)


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = packing.pack(packing.pieces(docs, JSON, PATTERN, capacity=50), 50).collect()
    own = Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    want = []
    for i, text, *_ in ROWS:
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 50 + 1
        for k, a in enumerate([0, *range(first, len(ids), 50)]):
            part = ids[a : first if k == 0 else a + 50]
            want.append((i or 0, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 50
    assert sorted(50 - v for v in at.values()) == one_by_one([w[3] for w in want], 50)
    assert packing.pack(packing.pieces(docs.limit(0), JSON, PATTERN)).count() == 0


def test_packing_encodes_added_tokens_as_the_library_does(spark):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b <|endoftext|", " <|ENDOFTEXT|> ", "plain  text ", "w\u00f6rd  <|endoftext|>  " * 40]
    own = Tokenizer.from_file(JSON)
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON, PATTERN).collect()
    ids = [own.encode(text, add_special_tokens=False).ids + [0] for text in texts]
    assert ids[0] == [87, 220, 50256, 331, 0]
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got) == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]


def test_digests(spark):
    from lattiq.llm.bpe import sha256_hex

    row = spark.createDataFrame([(1, "é")], "doc_id long, text string").select(sha256_hex("text").alias("h")).first()
    assert row.h == hashlib.sha256("é".encode()).hexdigest()
