"""Main text of web pages.

A page is cut into flat text blocks. Each has a word count and a link density, and so have the two blocks before and after
it; a small tree decides by these whether the block is main text. Where a page says what its parts are (a menu, an article, an
element whose class or id speaks of comments ...), that is a further sign. The tree is trained on the labelled pages below, with
and without such signs, and with blocks of many lengths.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.bpe import _arrow
from lattiq.llm.common import ready, record
from lattiq.llm.tree import Node, decide, grow

VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is not text of the page; their content is not looked at for markup.
SKIPPED = frozenset("script style noscript template svg math iframe object textarea title canvas audio video xmp noembed noframes select datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag closes, up to the element that bounds the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
LEFT_OPEN = frozenset("nav footer header form".split())
#: Words in class, id or role, by what they say of an element.
ASIDE = frozenset("ad ads adsbygoogle adv advert advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion sidebar aside rail complementary widget widgets related recommended recommendations recirc popular trending share sharing social follow newsletter subscribe subscription signup login signin register search cookie cookies consent gdpr privacy notice notices alert warning disclaimer popup modal overlay dialog toast paywall menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager toolbar topbar masthead skip footer foot colophon contentinfo copyright legal tags tagcloud donate".split())
COMMENTS = frozenset("comment comments commentlist replies reply respond disqus discussion feedback reactions".split())
TOP = frozenset("header head masthead banner".split())
MAIN = frozenset("article articles articlebody content main post entry story body text maincontent prose".split())
#: Of equally good splits the tree takes the first of these.
NAMES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "second_before_words", "second_before_links", "second_after_words", "second_after_links", "heading", "paragraph", "item", "notice", "menu", "top", "bottom", "beside", "form", "comments", "aside", "main", "depth", "nearest", "outside")
#: What notices say, in some of the languages they come in; longer blocks are none.
NOTICE_WORDS = 40
NOTICE = re.compile(r"\u00a9|\(c\)|copyright|all rights reserved|alle rechte vorbehalten|tous droits r\u00e9serv\u00e9s|todos los derechos reservados|\bcookies?\b", re.I)

#: A comment, a tag (slash, name, attributes), or what has to be passed over: declarations, tags with an open quote, a tag cut off by the page's end.
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Place:
    """What the elements around a text say: a count for each sign, and the sign of the innermost that has one."""

    __slots__ = ("tag", "menu", "top", "bottom", "beside", "form", "comments", "aside", "main", "nearest", "linked", "heading", "paragraph", "item", "hidden")

    def __init__(self, tag: str, outer: Place | None, attributes: str):
        for name in self.__slots__[1:]:
            setattr(self, name, getattr(outer, name) if outer else 0)
        self.tag = tag
        words, hidden = set(), False
        if attributes and tag not in ("html", "body"):
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role"):
                    words.update(w.lower() for w in WORD.findall(value))
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
                    hidden = True
        says_main, says_aside, says_comments, says_top = words & MAIN if tag in BLOCK else frozenset(), words & ASIDE, words & COMMENTS, words & TOP
        for name, on in (("menu", tag in ("nav", "menu") or "navigation" in words), ("top", tag == "header" or says_top and not says_main), ("bottom", tag == "footer" or "footer" in words), ("beside", tag == "aside"), ("form", tag in ("form", "fieldset", "dialog", "button", "label", "search")), ("comments", says_comments), ("aside", says_aside and not (says_main and says_aside <= TOP)), ("main", tag in ("article", "main") or says_main), ("item", tag in ("li", "dd", "dt"))):
            if on:
                setattr(self, name, getattr(self, name) + 1)
        if tag in ("nav", "menu", "footer", "aside", "form", "dialog") or says_aside or says_comments:
            self.nearest = -1
        elif tag in ("article", "main") or says_main:
            self.nearest = 1
        self.hidden = self.hidden or hidden
        self.linked = self.linked or tag == "a"
        self.heading = self.heading or tag in HEADING
        self.paragraph = tag == "p" or self.paragraph and tag not in BLOCK


def blocks(html: str) -> list[tuple[str, int, Place]]:
    """(text, words inside links, place) of the text blocks of a page, in order."""
    out: list[tuple[str, int, Place]] = []
    stack = [Place("", None, "")]
    words: list[str] = []  # of the block being read: pieces of text, and how many words of them are linked
    linked, at, n = 0, 0, len(html)
    place = stack[0]

    def close() -> None:
        nonlocal words, linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((text, min(linked, text.count(" ") + 1), place))
            words, linked = [], 0

    opened = Counter()  # elements on the stack by tag
    inside = [Counter()]  # by block on the stack: elements opened in it that are no blocks
    endless: set[str] = set()  # skipped elements that have no end from here on

    def drop(depth: int) -> None:
        """Ends the elements of the stack from ``depth`` on; each is looked at once in its life."""
        for ended in reversed(stack[depth:]):
            opened[ended.tag] -= 1
            if ended.tag in BLOCK:
                inside.pop()
            else:
                inside[-1][ended.tag] -= 1
        del stack[depth:]

    def innermost(tags: frozenset[str] | set[str]) -> int:
        return next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in tags)

    while at < n:
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        at = m.end() if m else n
        if text and not stack[-1].hidden:
            text = unescape(text) if "&" in text else text
            if not words:
                place = stack[-1]
            words.append(text)
            if stack[-1].linked:
                linked += len(text.split())
        if not m or not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                close()
            # An end tag of a block ends all that is open in it, any other only reaches back to the block it stands in.
            if opened[tag] if tag in BLOCK else inside[-1][tag]:
                drop(innermost({tag}))
            continue
        if tag in SKIPPED:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            if end:
                at = (html.find(">", end.start()) + 1) or n
            elif tag not in ("svg", "math", "select", "object"):
                at = n
            else:
                endless.add(tag)
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in BLOCK:
            close()
            if tag in ("article", "main") and any(map(opened.__getitem__, LEFT_OPEN)):  # never inside these: they were left open
                drop(next(i for i in range(1, len(stack)) if stack[i].tag in LEFT_OPEN))
            if stack[-1].tag == "p" or any(s.tag == "p" for s in stack[-3:]):
                drop(innermost({"p"}))
            if tag in CLOSES and any(map(opened.__getitem__, CLOSES[tag][0])):
                closed, bound = CLOSES[tag]
                if (depth := innermost(closed | bound)) and stack[depth].tag in closed:
                    drop(next(i for i in range(depth, -1, -1) if stack[i - 1].tag not in closed))
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(Place(tag, stack[-1], m[3]))
            opened[tag] += 1
            if tag in BLOCK:
                inside.append(Counter())
            else:
                inside[-1][tag] += 1
    close()
    return out


def features(found: list[tuple[str, int, Place]]) -> list[tuple[float, ...]]:
    size = [(min(text.count(" ") + 1, 60), linked / (text.count(" ") + 1)) for text, linked, _ in found]
    size = [(0, 0.0), (0, 0.0), *size, (0, 0.0), (0, 0.0)]
    marked = any(p.main and p.nearest > 0 for _, _, p in found)  # the page says where its main text is
    out = []
    for i, (text, _, p) in enumerate(found):
        main = min(p.main, 1)
        numbers = (*size[i + 2], *size[i + 1], *size[i + 3], *size[i], *size[i + 4])
        signs = (min(p.menu, 1), min(p.top, 1), min(p.bottom, 1), min(p.beside, 1), min(p.form, 1), min(p.comments, 1), min(p.aside, 1), main, p.main, p.nearest, float(marked and not main))
        out.append((*numbers, float(bool(p.heading)), float(bool(p.paragraph)), float(bool(p.item)), float(numbers[0] <= NOTICE_WORDS and bool(NOTICE.search(text))), *signs))
    return out


#: Labelled pages: {k12} stands for a main-text block of twelve words, {n5} for one of five that is not main text, {m5}
#: and {c5} for such blocks that also say what notices say. Pages whose markup says nothing: only lengths, links and neighbours tell.
NEUTRAL = (
    '<div>{c18}</div><div><a>{n1}</a></div><div><a>{n2}</a></div><div><a>{n1}</a></div><div>{k7}</div><div>{k60}</div><div>{k45}</div><div>{k30}</div><div>{c8}</div>',
    '<div>{n16}</div><div><a>{n1}</a> <a>{n1}</a> <a>{n2}</a></div><div>{k8}</div><div>{k50}</div><div>{k38}</div><div><a>{n2}</a> <a>{n1}</a></div><div>{c7}</div>',
    '<p>{c20}</p><p><a>{n1}</a> <a>{n2}</a></p><h1>{k6}</h1><p>{k40}</p><p>{k12}</p><p>{k55}</p><p>{c9}</p>',
    '<div><a>{n1}</a> <a>{n1}</a> <a>{n2}</a></div><h1>{k6}</h1><p>{k50}</p><p>{k9}</p><p>{k35}</p><div><a>{n4}</a></div><div><a>{n5}</a></div><div>{n7}</div>',
    '<div><a>{n2}</a></div><div>{k6}</div><div>{k48}</div><div>{k60}</div><div><a>{n5}</a></div><div>{n14}</div><div><a>{n6}</a></div><div>{n13}</div><div><a>{n4}</a></div><div>{n12}</div>',
    '<div>{n3}</div><div><a>{n1}</a></div><div><a>{n1}</a></div><h2>{k7}</h2><div>{k44}</div><div>{k36}</div><div>{n3}</div><div><a>{n5}</a></div><div><a>{n6}</a></div><div>{c10}</div>',
    '<table><tr><td><a>{n1}</a></td><td><a>{n2}</a></td></tr><tr><td>{k55}</td></tr><tr><td>{k40}</td></tr><tr><td>{c6}</td></tr></table>',
    '<div>{k60}</div><div>{k50}</div><div>{k40}</div><div><a>{n1}</a> <a>{n1}</a></div><div>{c12}</div>',
    '<span>{n2}</span><div><a>{n3}</a></div><div>{k9}</div><div>{k30}</div><div>{k22}</div><div>{k60}</div><div><a>{n2}</a></div>',
    '<p><a>{n1}</a></p><p><a>{n2}</a></p><p>{k30}</p><p>{k6}</p><p>{k44}</p><p>{k3}</p><p>{k28}</p><p>{c8}</p><p><a>{n1}</a></p>',
    '<h1>{k5}</h1><p>{k25}</p><ul><li>{k8}</li><li>{k11}</li><li>{k6}</li></ul><p>{k33}</p><ul><li><a>{n3}</a></li><li><a>{n2}</a></li></ul>',
    '<div><a>{n1}</a></div><div>{n9}</div><div><a>{n1}</a></div><h1>{k7}</h1><p>{k60}</p><p>{k42}</p><div>{n6}</div><div><a>{n2}</a></div>',
    '<p>{k24}</p><p>{k31}</p><p>{k18}</p><p>{c7}</p>',
    '<p>{n18}</p><p><a>{n1}</a></p><p><a>{n2}</a> <a>{n1}</a></p><p>{k5}</p><p>{k50}</p><p>{k38}</p><p><a>{n2}</a> <a>{n1}</a></p><p>{c4}</p>',
    '<p>{n14}</p><p><a>{n1}</a> <a>{n2}</a> <a>{n1}</a></p><p>{k7}</p><p>{k60}</p><p>{k44}</p><p>{k21}</p><p><a>{n3}</a></p><p>{c6}</p>',
    '<div>{c22}</div><p>{k24}</p><p>{k31}</p><p>{k18}</p>',
)
#: Pages whose markup says what their parts are, some of it wrongly or in part.
LABELLED = (
    '<nav><ul><li><a>{n1}</a></li><li><a>{n1}</a></li><li><a>{n2}</a></li></ul></nav><div class="ad">{n9}</div><article><h1>{k8}</h1><p>{k40}</p><p>{k6}</p><p>{k1}</p><p>{k30}</p></article><footer>{n12}</footer>',
    '<nav><a>{n1}</a></nav><div class="ad">{n30}</div><article><h1>{k1}</h1><p>{k2}</p></article><footer>{n40}</footer>',
    '<header><h1>{n3}</h1><p>{n8}</p></header><main><h1>{k6}</h1><p>{k50}</p><ul><li>{k5}</li><li>{k12}</li></ul><blockquote>{k20}</blockquote><p>{k15}</p></main><aside><h2>{n2}</h2><p>{n30}</p></aside><footer><p>{n20}</p></footer>',
    '<div id="header"><a>{n2}</a></div><div class="menu"><a>{n1}</a></div><div id="content"><h1>{k7}</h1><p>{k35}</p><p>{k4}</p></div><div id="sidebar"><h3>{n2}</h3><p>{n25}</p><ul><li><a>{n4}</a></li></ul></div><div id="footer">{n9}</div>',
    '<article><header><h1>{k9}</h1></header><p>{k45}</p><div class="ad">{n12}</div><p>{k25}</p><aside>{n20}</aside><h2>{k4}</h2><p>{k33}</p><div class="share"><a>{n1}</a><a>{n1}</a></div></article><section id="comments"><h2>{n2}</h2><div class="comment"><p>{n35}</p></div><div class="comment"><p>{n6}</p></div></section>',
    '<main><article><h1>{k5}</h1><p>{k60}</p><form><label>{n2}</label><p>{n10}</p><button>{n1}</button></form><div class="comments"><article><p>{n40}</p></article><p>{n3}</p></div></article></main>',
    '<div class="cookie-notice"><p>{n25}</p></div><div role="banner">{n4}</div><div role="navigation"><a>{n1}</a></div><div role="main"><h1>{k6}</h1><p>{k28}</p><table><tr><td>{k2}</td><td>{k3}</td></tr></table></div><div role="contentinfo">{n15}</div>',
    '<p><a>{n1}</a> <a>{n1}</a></p><h1>{k6}</h1><p>{k55}</p><p>{k22}</p><p>{k9}</p><p><a>{n3}</a></p>',
    '<h1>{k4}</h1><p>{k18}</p><p>{k30}</p><p>{k3}</p>',
    '<div>{k25}</div><div>{k40}</div>',
    '<p>{k3}</p>',
    '<div><a>{n2}</a></div><div><a>{n1}</a></div><div>{k50}</div><div>{k30}</div><div><a>{n2}</a></div><div><a>{n3}</a></div>',
    '<ul><li><a>{n1}</a></li><li><a>{n2}</a></li><li><a>{n1}</a></li></ul><h2>{k5}</h2><p>{k32}</p><p>{k20}</p><ul><li><a>{n6}</a></li><li><a>{n7}</a></li></ul>',
    '<div class="post"><h2>{k7}</h2><p>{k26}</p><p><a>{k3}</a></p><p>{k14}</p></div><div class="related"><h3>{n2}</h3><p>{n12}</p><a>{n8}</a></div><div class="newsletter"><p>{n14}</p></div>',
    '<article><h1>{k6}</h1><p>{k20}</p><ul><li><a>{k4}</a></li><li><a>{k3}</a></li></ul><p>{k17}</p><nav><a>{n2}</a><a>{n2}</a></nav><footer>{n8}</footer></article>',
    '<div class="notice">{n18}</div><article><div class="promo"><h2>{n3}</h2><p>{n22}</p></div><section class="body"><h2>{k3}</h2><p>{k38}</p><figure><figcaption>{k8}</figcaption></figure></section></article><div class="sponsored"><article><h2>{n5}</h2><p>{n20}</p></article></div>',
    '<aside><article><h2>{n4}</h2><p>{n16}</p></article></aside><main><p>{k44}</p></main><header><p>{n10}</p></header><dialog>{n12}</dialog>',
    '<div>{n6}</div><p>{n25}</p><article><h1>{k5}</h1><p>{k40}</p><p>{k7}</p></article><div>{n8}</div><p>{n30}</p>',
    '<nav><a><div class="text">{n1}</div></a></nav><main><p>{k21}</p><p><a>{k2}</a></p></main><footer><div class="content">{n12}</div></footer><aside><div class="text">{n20}</div></aside>',
    '<div class="sidebar"><div class="content"><p>{n18}</p></div></div><div class="cookie"><div class="text">{n12}</div></div><div class="entry"><p>{k33}</p></div><div class="comments"><div class="body">{n30}</div></div><form><div class="main">{n9}</div></form>',
    '<div><a>{n2}</a></div><div>{n2}</div><div><a>{n3}</a></div><p>{k45}</p><p>{k2}</p><p>{k30}</p><div><a>{n2}</a></div><div>{n3}</div><div><a>{n2}</a></div>',
    '<p>{k28}</p><p>{k4}</p><p>{k36}</p><div><a>{n1}</a></div><div>{n1}</div><div><a>{n1}</a></div><div>{n4}</div><div><a>{n5}</a></div>',
    '<nav><a>{n2}</a></nav><article><h1>{k3}</h1><p>{k1}</p><p><a>{k2}</a></p><p>{k2}</p><p><a>{k3}</a></p><p>{k40}</p></article>',
    '<nav><a>{n2}</a></nav><main><p>{k1}</p><p>{k4}</p></main><nav><a>{n1}</a></nav>',
    '<nav><a>{n2}</a></nav><article><p>{k2}</p></article><nav><a>{n1}</a></nav>',
    '<nav><a>{n2}</a></nav><h1>{k2}</h1><p>{k40}</p><p>{k3}</p>',
    '<nav><a>{n2}</a></nav><p>{k3}</p><p>{k40}</p>',
    '<nav><a>{n2}</a></nav><article><h1>{k5}</h1><p>{k30}</p><p>{m4}</p></article><footer>{c12}</footer>',
    '<nav><a>{n2}</a></nav><article><p>{m5}</p><p>{k30}</p><p>{m14}</p><p>{k8}</p></article><footer>{c6}</footer>',
    '<div class="cookies">{c15}</div><main><h1>{m6}</h1><p>{m24}</p></main><div id="footer">{c9}</div>',
    '<main><header><h1>{k5}</h1><p>{k12}</p></header><p>{k31}</p><div class="disclaimer">{n20}</div></main>',
)


def labelled(copies: int = 12, seed: int = 1) -> list[tuple[tuple[float, ...], int]]:
    """The rows that the tree learns from: the pages as they are, and copies with other lengths. Where markup tells, a block
    can have any length; where it doesn't, lengths stay within a third of what they were."""
    draw, rows = random.Random(seed), []

    def filled(page: str, other: bool, told: bool) -> str:
        def block(m: re.Match) -> str:
            n = int(m[2])
            if other:
                n = round(2 ** draw.uniform(0, 6)) if told else max(1, round(n * draw.uniform(0.67, 1.5)))
            return " ".join(["k" if m[1] in "km" else "n"] * n) + (" \u00a9" if m[1] in "cm" else "")

        return re.sub(r"\{([kmnc])(\d+)\}", block, page)

    for page in (*LABELLED, *NEUTRAL):
        told = page in LABELLED and any(sign in page for sign in ("<nav", "<main", "<article", "class=", "id=", "role="))
        for copy in range(1 + copies):
            found = blocks(filled(page, copy > 0, told))
            rows += [(x, int(text[0] == "k")) for x, (text, _, _) in zip(features(found), found)]
    return rows


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(labelled())


def main_text(html: str, node: Node | None = None) -> str:
    found, node = blocks(html), node or tree()
    return "\n".join(text for x, (text, _, _) in zip(features(found), found) if decide(node, x) >= 0.5)


def extract_rows(rows: Iterator[pa.RecordBatch], node: Node, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [main_text(h or "", node) for h in batch.column("html").to_pylist()]
        yield record(schema, *(batch.column(n) for n in schema.names[:-2]), found, [len(t) for t in found])


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """(id, url, text, n_chars) of every page: the blocks that are main text, one a line, and its number of code points.

    Null or empty html and pages without main text give an empty text; repeated rows repeat; null ids and urls stay null."""
    ready(pages.sparkSession)
    id_type, url_type = (pages.schema[c].dataType for c in (id_column, "url"))
    schema = pa.schema([(id_column, _arrow(id_type)), ("url", _arrow(url_type)), ("text", pa.string()), ("n_chars", pa.int64())])
    rows = pages.select(id_column, "url", F.col("html").alias("html"))
    return rows.mapInArrow(partial(extract_rows, node=tree(), schema=schema), f"{id_column} {id_type.simpleString()}, url {url_type.simpleString()}, text string, n_chars long")
