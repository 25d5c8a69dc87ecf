"""The block classifier: what decides, malformed pages, and the query by brute force."""

import os
import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from veilspan.llm import extraction

TREE = extraction.grow(extraction.table())
DIR = "/root/testdata/sf0.01"
LONG = "a long paragraph of prose that goes on and says one thing after another " * 6


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article style='overflow:hidden'><p>kept</p></article>", "kept"),
        ("<article title='hidden gems'><p>kept</p></article>", "kept"),
        ("<article aria-hidden='false'><p>kept</p></article>", "kept"),
        ("<body class='single has-sidebar'><article><p>kept</p></article>", "kept"),
        ("<article class='post comments-open'><p>kept</p></article>", "kept"),
        ("<div class='social-study'><p>We asked twelve people of one town what they read and where they read it.</p></div>", "We asked twelve people of one town what they read and where they read it."),
        ("<article><p>one two <a href=x>three<p>plain text after a link that nobody closed</p></article>", "one two three\n\nplain text after a link that nobody closed"),
        ("<div><p><a href=x>unclosed<p>" + "plain words " * 20 + "</div>", "plain words " * 19 + "plain words"),
        ("<div class=top-ad-slot>Buy two</div><div class=ad>Buy one</div><main>Body</main>", "Body"),
        ("<main><p>Body words here</p><ul><li><a href=x>Share it</a><li><a href=x>Tweet it</a></ul></main>", "Body words here"),
        ("<main><p>Body words here</p><p><a href=x>One source</a></p><p>More words</p></main>", "Body words here\n\nOne source\n\nMore words"),
    ],
)
def test_text_decides_with_the_markup(page, text):
    assert extraction.extract(page, TREE) == text


def test_no_name_decides_alone():
    for name in (-1, 0, 1):
        seen = {extraction.kept(TREE, (0, name, *extraction.KINDS[b], *extraction.KINDS[p], *extraction.KINDS[n])) for b in extraction.KINDS for p in extraction.KINDS for n in extraction.KINDS if b != "none"}
        assert seen == {True, False}
    page = f"<div class=sidebar><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>Short</p></div>"
    assert extraction.extract(page, TREE) == LONG.strip()  # the middle one; its neighbours have a short side


def test_links_that_wrap_blocks_are_links():
    found = extraction.blocks("<a href=x><div>in a link</div></a><p>not <a href=y>half linked</a></p>")
    assert [(b[0], round(b[4], 2)) for b in found] == [("in a link", 1.0), ("not half linked", 0.67)]


def test_names_have_heads():
    words = lambda c: extraction._words({"class": c})
    assert words("ad-slot topAd social-study right-sidebar has-sidebar comments_list") == {"ad", "study", "sidebar", "comments"}


class Reader(HTMLParser):
    """The text blocks inside article, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.found, self.now = False, [], ""

    def end(self):
        if self.inside and self.now.split():
            self.found.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "li", "ul", "nav", "div", "footer"):
            self.end()
        self.now += " " * (tag == "br")
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "li", "ul", "nav", "div", "footer"):
            self.end()
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.now += data


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_query_by_brute_force(spark):
    rows = extraction.op10_extraction(spark, DIR)
    assert rows.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    pages = spark.read.parquet(f"{DIR}/pages.parquet").collect()
    want = Counter()
    for page in pages:
        reader = Reader()
        reader.feed(page["html"] or "")
        reader.close()
        text = "\n\n".join(reader.found)
        want[page["page_id"], page["url"], text, len(text)] += 1
    assert Counter(map(tuple, rows.collect())) == want
    # the text decides on two blocks of three; the rest are in tags that say what they are
    by_text = every = 0
    for page in pages:
        found = extraction.blocks(page["html"] or "")
        for x in extraction.features(found):
            tree, seen = TREE, set()
            while isinstance(tree, tuple):
                seen.add(tree[0])
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            by_text += not seen.isdisjoint(extraction.TEXT)
            every += 1
    assert by_text > 0.6 * every


def test_long_pages_and_repeated_rows(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefg", k=5)) for _ in range(500)]
    paragraphs = [" ".join(rnd.choices(words, k=40)) for _ in range(5000)]
    page = "<nav><a href=/>x</a></nav><article>" + "".join(f"<p>{p}" for p in paragraphs) + "</article>"
    broken = "<div " * 20_000 + "<a " * 20_000 + "&" * 20_000
    df = spark.createDataFrame([(1, page, "c"), (1, page, "c"), (2, broken, "c")], "page_id long, html string, text string")
    rows = extraction.main_text(df).collect()
    assert [r["text"] for r in rows[:2]] == ["\n\n".join(paragraphs)] * 2 and len(rows) == 3
