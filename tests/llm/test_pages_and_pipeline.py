"""Hostile and odd pages, an independent reader of pages, and the pipeline's edge tables."""

import random
import time
from html.parser import HTMLParser

import pytest

from domscope.llm.html_text import Page
from domscope.llm.op4 import op4_html_text
from tests.llm.test_set_operators import PAGES
from tests.llm.test_text_operators import DOCS, write

BODY = ("Body text of the page. " * 20).strip()


@pytest.mark.parametrize(
    "page",
    ["<a" * 500_000, "<a '" * 250_000, "<!" * 500_000, "</" * 500_000, "<!--" * 250_000, "<a b='" * 150_000 + ">", '<a b="' + "x" * 10**6, '<b y=">" ' * 120_000, "<" + "a" * 10**6, "<a " + "= " * 500_000, "<a =\"'" * 150_000, "<p " + "a" * 500_000 + " " * 500_000, "<a b= " * 160_000],
    ids=lambda p: f"{p[:8]!r}",
)
def test_hostile_pages_take_linear_time(page):
    start = time.time()
    Page(page).text(None)
    assert time.time() - start < 3  # 1 MB each


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1>Title</h1><p>Intro.</p><div class=body><p>{BODY}</p></div></article>", f"Title\nIntro.\n{BODY}"),
        (f"<div id=content><h1>Title</h1><p>Intro.</p><div class=body><p>{BODY}</p></div></div>", f"Title\nIntro.\n{BODY}"),
        (f"<div><div class=teasers><a href=x>{BODY}</a></div><div class=body><p>{BODY}</p></div></div>", BODY),
        ("<article><p title=don't>Hello you.</p><p>It's fine.</p></article>", "Hello you.\nIt's fine."),
        ('<article><p title="a > b">x</p></article>', "x"),
        (f"<form id=aspnetForm method=post><div><p>{BODY}</p></div><input><select><option>no</select></form>", BODY),
        (f"<article><p>{BODY}</p><form><p>Your name</p></form></article>", BODY),
        ("<form class=search><label>Find</label></form><p>text</p>", "text"),
        (f"<div class='notice-of-motion'><p>{BODY}</p></div>", BODY),
        (f"<div class='search-engine-history'><p>{BODY}</p></div>", BODY),
        ("<div class='cookie-notice'>We use cookies</div><div id=main-sidebar>more</div><div class=cookie-law-info>Law</div><p>text</p>", "text"),
        ("a < b and c > d", "a < b and c > d"),
        ("x <b", "x"),
    ],
)
def test_layouts(page, text):
    assert Page(page).text(None) == text


class Reader(HTMLParser):
    """The text of article elements by Python's own parser: blocks, without what is left out of the pages made here."""

    BREAKS, OUT = {"p", "h1", "h2", "div", "article", "li", "ul", "section", "blockquote"}, {"nav", "aside", "footer", "script", "style"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.within = self.out = 0
        self.blocks = [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.within += tag == "article"
        if tag in self.OUT or dict(attrs).get("class") in ("ad", "comments"):
            self.out += 1
        elif self.out and tag == "div":
            self.out += 1
        if tag in self.BREAKS:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.OUT or (self.out and tag == "div"):
            self.out -= 1
        if tag in self.BREAKS:
            self.blocks.append("")
        self.within -= tag == "article"

    def handle_data(self, data):
        if self.within and not self.out:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(t for b in self.blocks if (t := " ".join(b.split())))


def test_whole_table_equals_another_parser(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = op4_html_text(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.text, r.n_chars) == (Reader(pages[r.page_id] or "").text(), len(r.text))


def test_made_layouts_equal_another_parser(spark, tmp_path):
    r = random.Random(4)
    word = lambda: r.choice(["naïve", "a&amp;b", "don't", "x &lt; y", "lorem", "ipsum", "dolor"])
    prose = lambda n: " ".join(word() for _ in range(n))
    inner = ["<p>{0}</p>", "<div class='body-{1}'><p>{0}</p><p>{0}</p></div>", "<blockquote>{0}<br>{0}</blockquote>", "<ul><li>{0}</li><li>{0}</li></ul>", "<section><h2>{0}</h2><p title=it's>{0}</p></section>"]
    pages = []
    for k in range(120):
        parts = "".join(r.choice(inner).format(prose(r.randint(20, 60)), k % 7) + r.choice(["", f"<div class=ad>{prose(5)}</div>", f"<aside>{prose(9)}</aside>"]) for _ in range(r.randint(1, 6)))
        title = f"<h1>{prose(4)}</h1>" + r.choice(["", f"<p>{prose(8)}</p>"])
        pages.append((k, f"https://h{k % 3}.com/{k}", f"<html><body><nav><ul><li><a href=x>{prose(3)}</a></ul></nav><article>{title}{parts}<div class=comments><div>{prose(30)}</div></div></article><footer>{prose(6)}</footer></body></html>"))
    rows = op4_html_text(spark, write(spark, tmp_path, pages=(pages, PAGES))).collect()
    want = {k: Reader(html).text() for k, _, html in pages}
    assert {x.page_id: x.text for x in rows} == want


# Pipeline ----------------------------------------------------------------------------------------------------

LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    empty = write(spark, tmp_path / "a", documents=([], DOCS), labels=([], LABELS), benchmark=([], ITEMS))
    assert corpus_pipeline.run(spark, empty).count() == 0
    some = write(spark, tmp_path / "b", documents=([(1, "one text", "en", "s", 8), (2, None, None, None, None)], DOCS), labels=([], LABELS), benchmark=([], ITEMS))
    assert {(r.doc_id, r.n_tokens > 0, r.round_trip) for r in corpus_pipeline.run(spark, some).collect()} == {(1, True, True), (2, False, True)}


def test_pipeline_of_repeated_rows_long_texts_and_further_columns(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    prose = lambda n: " ".join(r.choice([f"w{k}" for k in range(300)]) for _ in range(n))
    texts = {k: prose(40) for k in range(30)} | {40: prose(200_000)}
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    rows += [rows[3], rows[3], (5, prose(45), "en", "s", 9), (None, prose(50), None, None, None)]
    names = ["__text", "__toxicity", "__row", "__lines", "__removed", "score", "spans", "items", "ids", "text_", "root", "v"]
    d = write(spark, tmp_path, documents=([(*x, *range(len(names))) for x in rows], f"{DOCS}, {', '.join(f'{n} int' for n in names)}"), labels=([], LABELS), benchmark=([(1, prose(30))], ITEMS))
    df = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, d)
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert name == "byte_bpe" or df.columns == spark.read.parquet(f"{d}/documents.parquet").columns
        if name == "toxicity":
            kept = df.count()
            assert df.where("`__toxicity` <> 1 OR `__text` <> 0").count() == 0
    ids = sorted((x.doc_id for x in df.collect()), key=str)
    assert len(ids) == kept - 2 and ids.count(3) == 1 and ids.count(5) == 2 and None in ids and 40 in ids and all(x.round_trip for x in df.collect())
