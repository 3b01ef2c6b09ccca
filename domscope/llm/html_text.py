"""Main text of web pages by consensus host paths.

First each page's containers are scored: the text of a container's own blocks outside links, half of that
of the containers within it, and half as much again for article and main. The page votes for the generalised
tag-class path of its best container, with its score as the weight of the vote, capped so that no page counts
for more than a hundred short ones. A title or an introduction beside the best container belongs to it: then the container around both has the
vote. Spark sums the votes by host and path, and the path with most votes wins
the host. Then every page is read again: the text of the containers on the winning path, without what is
never article text - menus, site headers, footers, sidebars, notices, adverts, forms (but one around the whole page), scripts, styles,
reader comments, hidden parts. A page without that path, or without text there, uses its own best container.

Null and empty pages have an empty text. Pages without a host share one host, the empty name. Very long and very deeply
nested pages take time and memory in proportion to their length: a container knows its parent and a digest of its path, and
only a winner's path is spelt out. If paths of a host tie in votes, the greatest one in text order wins. Each row is a page
of its own, also if rows repeat, and then votes for its host again. An empty table gives an empty result. Columns to keep that are
named like a result (text, path) are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, lean, written

#: Winning paths are broadcast if they and their hosts take no more bytes than this; beyond, they are joined by a salted shuffle.
MOST_BYTES = 16_000_000
SALTS = 32
#: Characters outside links from which on a form may be the page's frame.
WHOLE_FORM = 200
_OPEN = re.compile(r"<(?:!--|[!?/]|[a-zA-Z])")
#: A tag, whose quotes count only behind an equals sign, as they do in browsers; and one that ends at the next >. Neither gives characters back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]++)))?""")
_READ = frozenset("class id role style hidden aria-hidden".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "template", "title", "svg", "iframe", "xmp")}
_CONTAINERS = frozenset("body div article section main table tbody tr td ul ol dl center header figure details blockquote fieldset form".split())
_NEVER = frozenset("nav footer aside button select head dialog menu object canvas audio video map".split())
_BLOCKS = _CONTAINERS | _NEVER | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption summary caption th thead tfoot hr legend option html hgroup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of classes, ids and roles that mark what isn't article text.
_MARKS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs
    pagination pager footer sidebar aside complementary contentinfo banner cookie cookies consent gdpr notice notices alert newsletter subscribe
    signup popup modal overlay toast comment comments commentlist disqus respond replies reply discussion share sharing social related recommended
    widget masthead toolbar search login form skip hidden""".split()
)
#: Those of them that name a subject, too, unless they are the last word of a name that isn't neutral.
_VAGUE = frozenset("alert banner comment discussion form hidden login menu notice notices promotion recommended related replies reply respond search share sharing skip social subscribe".split())
#: Words that say nothing about the content beside one of the above.
_NEUTRAL = frozenset(
    """area article articles bar block blog body bottom box btn button buttons col column container content desktop entry first footer group head header
    icon icons inline inner item items large last left link links list main media message messages mobile new news outer page panel post posts primary
    reader readers reading right row secondary section site slot small stories story text thread threads title tool tools top unit user users wrap
    wrapper zone""".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(text: str) -> dict[str, str]:
    """Those attributes of a tag that are looked at; values of others aren't mistaken for them."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        name = m[1].lower()
        if name in _READ:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return found


def _unwanted(tag: str, own: dict[str, str], within_main: bool) -> bool:
    """Whether the element is never article text. Outside the main part a container goes if any word of its names marks it, a vague
    one only as the last word; within it, and for headings and paragraphs, all words of a name have to be marks or neutral. A form's
    name may say that it is one."""
    if tag in _NEVER or (tag == "header" and not within_main):
        return True
    if not own or tag in ("body", "html", "main", "article"):
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    careful = within_main or tag not in _CONTAINERS
    for name in (*own.get("class", "").split(), own.get("id", ""), own.get("role", "")):
        words = [w.lower() for w in _WORD.findall(name)]
        marks = _MARKS.intersection(words) - ({"form"} if tag == "form" else set())
        if not marks or words[0] in ("no", "has", "with"):
            continue
        if careful:
            if not set(words) - _MARKS - _NEUTRAL:
                return True
        elif marks - _VAGUE or next((w for w in reversed(words) if w not in _NEUTRAL), "") in marks:
            return True
    return False


def _below(parent: bytes, step: str) -> bytes:
    """The digest of a path that is one step longer."""
    return blake2b(step.encode("utf-8", "surrogatepass"), key=parent, digest_size=16).digest()


def path_digest(path: str) -> bytes:
    digest = b""
    for step in path.split(">"):
        digest = _below(digest, step)
    return digest


class Page:
    """Blocks of text, each with its container, and the containers' parents, steps, and digests of paths."""

    def __init__(self, html: str):
        self.steps: list[str] = ["html"]
        self.parents: list[int] = [-1]
        self.digests: list[bytes] = [_below(b"", "html")]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self._read(html)

    def path(self, container: int) -> str:
        """The generalised tag-class path of a container."""
        steps = []
        while container >= 0:
            steps.append(self.steps[container])
            container = self.parents[container]
        return ">".join(reversed(steps))

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, container around it, whether its text is left out
        opened: Counter[str] = Counter()
        here, out, mains, links = 0, 0, 0, 0
        parts: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((here, text, linked))
                parts, linked = [], 0

        def close(depth: int) -> None:
            nonlocal here, out, mains
            while len(stack) > depth:
                tag, here, left_out = stack.pop()
                opened[tag] -= 1
                out -= left_out
                mains -= tag in ("main", "article")

        at, end, careful = 0, html.rfind(">"), True
        while (o := _OPEN.search(html, at)) and (o.start() <= end or o[0] == "<!--"):
            if not out and o.start() > at:
                text = html[at : o.start()]
                text = unescape(text) if "&" in text else text
                parts.append(text)
                linked += len(text) if links else 0
            at = o.start()
            if o[0] == "<!--":
                close_at = html.find("-->", at + 2)
                at = close_at + 3 if close_at >= 0 else len(html)
                continue
            m = _TAG.match(html, at) if careful else None
            if m is None and (tag_follows := _PLAIN.match(html, at)):
                # No > outside quotes up to the end of the page: from here on quotes don't count.
                m, careful = tag_follows, False
            if m is None:
                at = html.index(">", at) + 1 if o[0] in ("<!", "<?", "</") else at + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    links = 0
                    continue
                if tag in _BLOCKS:
                    flush()
                for depth in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[depth][0] == tag:
                        flush()
                        close(depth)
                        break
                    if stack[depth][0] in ("body", "td", "article") and tag not in ("body", "html", "table", "tr", "main", "article", "section", "div"):
                        break
                continue
            if tag in _RAW:
                raw = _RAW[tag].search(html, at)
                at = raw.end() if raw else len(html)
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag == "a":
                links = 1
                continue
            attributes = m[3]
            own = _attributes(attributes)
            block = tag in _BLOCKS
            if block:
                flush()
                while stack and stack[-1][0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") and (stack[-1][0] != "li" or tag == "li"):
                    close(len(stack) - 1)  # these end where the next block begins
            if tag in _VOID or attributes.endswith("/"):
                continue
            left_out = _unwanted(tag, own, mains > 0)
            if tag in _CONTAINERS and not left_out and not out:
                flush()
                names = sorted({re.sub(r"\d+", "#", c.lower().replace(">", "")) for c in own.get("class", "").split()})
                step = ".".join([tag, *names])
                self.steps.append(step)
                self.parents.append(here)
                self.digests.append(_below(self.digests[here], step))
                stack.append((tag, here, False))
                opened[tag] += 1
                here = len(self.steps) - 1
                mains += tag in ("main", "article")
            elif left_out or out or tag in _CONTAINERS:
                if left_out and not out:
                    flush()
                if block or left_out:
                    stack.append((tag, here, left_out))
                    opened[tag] += 1
                    out += left_out
                    mains += tag in ("main", "article")
        if not out and at < len(html):
            tail = _OPEN.search(html, at)  # a tag that never ends
            parts.append(unescape(html[at : tail.start() if tail else len(html)]))
        flush()
        self._without_forms()

    def _without_forms(self) -> None:
        """Forms go with their blocks, but for one that holds most of the page's text: some sites put the whole page in a form."""
        form = [-1] * len(self.steps)
        for c, step in enumerate(self.steps):
            form[c] = form[self.parents[c]] if c and form[self.parents[c]] >= 0 else c if step.partition(".")[0] == "form" else -1
        sizes: Counter[int] = Counter()
        for c, text, linked in self.blocks:
            sizes[form[c]] += len(text) - linked
        whole = {f for f, n in sizes.items() if f < 0 or n >= WHOLE_FORM and 2 * n > sizes.total()}
        self.blocks = [b for b in self.blocks if form[b[0]] in whole]

    def best(self) -> tuple[int, float]:
        """The container with the highest score, and that; the first of several."""
        own = [0.0] * len(self.steps)
        for c, text, linked in self.blocks:
            n = max(0, len(text) - linked)
            own[c] += n * n / max(1, len(text))
        score = own[:]
        for c in range(len(own) - 1, 0, -1):
            score[self.parents[c]] += own[c] / 2
        for c, step in enumerate(self.steps):
            if step.partition(".")[0] in ("article", "main"):
                score[c] *= 1.5
        k = max(range(len(score)), key=lambda c: (score[c], -c))
        return self._around(k), score[k]

    def _around(self, k: int) -> int:
        """The outermost container, below body, that adds text of its own to that of k - a title, an introduction - and adds more text than
        links; or else the article or main part around, if it adds more text than links."""
        texts, links, own = ([0] * len(self.steps) for _ in range(3))
        for c, text, linked in self.blocks:
            texts[c] += len(text)
            links[c] += linked
            own[c] += len(text) - linked
        for c in range(len(self.steps) - 1, 0, -1):
            texts[self.parents[c]] += texts[c]
            links[self.parents[c]] += links[c]
        best, c = k, self.parents[k]
        while c > 0 and (tag := self.steps[c].partition(".")[0]) != "body":
            more = texts[c] - texts[best]
            if more and (own[c] > 0 or tag in ("article", "main")) and 2 * (links[c] - links[best]) < more:
                best = c
            if tag in ("article", "main"):
                break
            c = self.parents[c]
        return best

    def text(self, path: str | None) -> str:
        """The blocks of the containers on the path, and of all within these, or else of the best container."""
        inside = [False] * len(self.steps)
        wanted = None if path is None else path_digest(path)
        for c, digest in enumerate(self.digests):
            inside[c] = digest == wanted or (c > 0 and inside[self.parents[c]])
        found = [text for c, text, _ in self.blocks if inside[c]]
        if not found:
            k, _ = self.best()
            for c in range(len(self.steps)):
                inside[c] = c == k or (c > 0 and inside[self.parents[c]])
            found = [text for c, text, _ in self.blocks if inside[c]]
        return "\n".join(found)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def vote(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the winner of each host that has a page with text."""
    names = ["host", "path", "weight"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(html.as_py())
                k, score = page.best()
                if score:
                    key = host, page.path(k)
                    votes[key] = votes.get(key, 0) + min(100, 1 + int(score) // 100)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], names)

    cast = pages.where(F.col(html_col).isNotNull()).select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(lean(run), "host string, path string, weight long")
    sums = cast.groupBy("host", "path").agg(F.sum("weight").alias("votes"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (page_id and url by default), text string and path string, the winning path of
    the page's host. One row per row; other columns are left out, so no name clashes."""
    keep = [c for c in (["page_id", "url"] if keep is None else keep) if c not in ("text", "path")]
    winners = written(vote(pages, url_col, html_col), "host-paths")
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col(url_col)).alias("__host"), F.coalesce(html_col, F.lit("")).alias("__html"))
    if winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()[0] <= MOST_BYTES:
        joined = rows.join(F.broadcast(winners.withColumnRenamed("host", "__host")), "__host", "left")
    else:
        spread = winners.withColumnRenamed("host", "__host").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64("__html"), F.lit(SALTS)).cast("int")).join(spread, ["__host", "__salt"], "left")
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("path", T.StringType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            paths = batch.column(len(keep) + 1)
            texts = [Page(html.as_py()).text(path) for html, path in zip(batch.column(len(keep)), paths.to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), paths], [f.name for f in schema])

    return joined.select(*[F.col(f"`{c}`") for c in keep], "__html", "path").mapInArrow(lean(run), schema)
