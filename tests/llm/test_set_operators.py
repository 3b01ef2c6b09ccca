"""Archives, page text, rollups, search, line runs, near copies, pipeline: edge rows and plain-Python versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from domscope.llm import html_text, near_copies, topk, warc
from domscope.llm.common import scratch_path
from domscope.llm.components import components
from domscope.llm.line_dedup import dedup_lines, line_table, suffix_ranks
from domscope.llm.op2 import op2_warc_index
from domscope.llm.op4 import op4_html_text
from domscope.llm.op6 import op6_near_copies
from domscope.llm.op7 import op7_topk
from domscope.llm.token_rollup import TokenRollup
from domscope.llm.words import words_of
from tests.llm.test_text_operators import DOCS, write

PAGES = "page_id long, url string, html string"


# Archives ----------------------------------------------------------------------------------------------------


def test_loser_tree_merges():
    random.seed(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((random.randint(0, 9), r) for _ in range(random.randint(0, 12))) for r in range(k)]
        got = list(warc.LoserTree([iter([(e[0], e) for e in run]) for run in runs]))
        assert [e for _, e in got] == sorted((e for run in runs for e in run), key=lambda e: (e[0], e[1]))


def test_archives(spark, tmp_path):
    pages = [(5, "http://WWW.b.com:80/x/?b=1&a=2#f", "same"), (9, "http://a.com/", "same"), (7, None, "same"), (1, "http://c.com/é \n", None), (2, "http://c.com/é \n", ""), (3, "nonsense", "ü" * 70000), (None, "x", "y"), (5, "http://b.com/x?a=2&b=1", "same")]
    d = write(spark, tmp_path, pages=([(i, u, h, ) for i, u, h in pages], PAGES))
    rows = op2_warc_index(spark, d).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == brute_captures(pages)
    index = warc.merge_runs(warc.read_runs(warc.write_archives(spark.read.parquet(f"{d}/pages.parquet"), 5)))
    entries = [(r.url_key, r.ts, -1 if r.id is None else r.id) for r in index.collect()]
    assert entries == sorted(entries) and len(entries) == len(pages)
    assert {r.record_type for r in index.where("payload_bytes < 5").collect()} == {"response"}
    assert warc.url_key("http://WWW.b.com:80/x/?b=1&a=2#f") == warc.url_key("https://b.com/x?a=2&b=1") == "com,b)/x?a=2&b=1"
    assert op2_warc_index(spark, write(spark, tmp_path / "e", pages=([], PAGES))).count() == 0


def brute_captures(pages):
    """Of each payload's rows that with the largest id is the response, in all that concerns the result."""
    want, groups = [], {}
    for i, _, h in pages:
        groups.setdefault((h or "").encode(), []).append(i)
    for p, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        want += [(i, len(p), warc.digest32(p), "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(p), warc.digest32(p), "response", None)]
    return sorted(want, key=str)


def test_archives_of_repeated_ids(spark, tmp_path):
    for n, pages in enumerate([
        [(5, "https://a.com/", "AA"), (5, "https://a.com/", "BBB"), (9, "https://b.com/", "AA"), (8, "https://c.com/", "BBB")],
        [(1, "https://a.com/", "common"), (1, "https://a.com/", "alone"), (2, "https://b.com/", "common"), (3, "https://c.com/", "other"), (1, "https://a.com/", "other")],
        [(4, "https://a.com/", "x"), (4, "https://a.com/", "x"), (4, "https://z.com/", "x"), (None, None, None), (None, None, None), (None, "https://y.com/", ""), (None, "https://y.com/", "n"), (7, "https://a.com/", "long " * 200_000)],
    ]):
        d = write(spark, tmp_path / str(n), pages=([(*p, "c") for p in pages], PAGES + ", digest string"))
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op2_warc_index(spark, d).collect()), key=str)
        assert got == brute_captures(pages)


def test_many_runs_merge_in_levels(spark, tmp_path):
    random.seed(4)
    pages = [(k, f"http://h{random.randint(0, 3)}.com/{random.randint(0, 40)}", f"text {k % 90}") for k in range(400)]
    d = write(spark, tmp_path, pages=(pages, PAGES))
    old = warc.RUN_ENTRIES, warc.FAN, warc.ROW_GROUP, warc.RANGE_ENTRIES
    warc.RUN_ENTRIES, warc.FAN, warc.ROW_GROUP, warc.RANGE_ENTRIES = 7, 3, 4, 50
    try:
        archives = warc.write_archives(spark.read.parquet(f"{d}/pages.parquet"))
        assert warc.read_runs(archives).count() > 50
        entries = [(r.url_key, r.ts, r.id) for r in warc.merge_runs(warc.read_runs(archives)).collect()]
    finally:
        warc.RUN_ENTRIES, warc.FAN, warc.ROW_GROUP, warc.RANGE_ENTRIES = old
    assert entries == sorted(entries) and sorted(i for *_, i in entries) == list(range(400))


def test_ranges_get_only_their_slices(spark, tmp_path):
    """What is sent to the ranges grows with the entries, not with runs times ranges, and holds no first entries."""
    random.seed(5)
    old = warc.RUN_ENTRIES, warc.FAN, warc.ROW_GROUP, warc.RANGE_ENTRIES
    warc.RUN_ENTRIES, warc.FAN, warc.ROW_GROUP, warc.RANGE_ENTRIES = 16, 4, 4, 20
    try:
        rows = {}
        for n in (300, 1200):
            pages = [(k, f"http://h{random.randint(0, 9)}.com/{random.randint(0, 400)}", f"text {k}") for k in range(n)]
            runs = warc.read_runs(warc.write_archives(spark.read.parquet(f"{write(spark, tmp_path / str(n), pages=(pages, PAGES))}/pages.parquet")))
            cuts = warc._ranges(runs, n // 20)
            slices = warc._slices(runs, cuts)
            assert "marks" not in slices.columns
            groups = runs.selectExpr("sum(size(marks) - 1)").first()[0]
            rows[n] = slices.count()
            assert rows[n] <= groups + sum(warc_crossings(runs, cuts))
            got = [(r.url_key, r.ts, r.id) for r in warc.merge_runs(runs).collect()]
            assert got == sorted(got) and sorted(i for *_, i in got) == list(range(n))
    finally:
        warc.RUN_ENTRIES, warc.FAN, warc.ROW_GROUP, warc.RANGE_ENTRIES = old


def warc_crossings(runs, cuts):
    """For each row group the cuts within it."""
    for r in runs.collect():
        keys = [tuple(m) for m in r.marks]
        yield from (sum(a < c <= z for c in cuts) for a, z in zip(keys, keys[1:]))


# Page text ---------------------------------------------------------------------------------------------------


def test_page_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
      <nav><a href="/">home</a></nav><div class="cookie-notice"><p>We use cookies</p></div><div class="content post-12"><h1>A &amp; B</h1><p>First   line<br>goes&nbsp;on <b>and</b> on, for quite
      some text<p>Second &lt;p&gt; one &eacute;<!-- no <p> --><script>if (a<b) "</p>"</script></p><div class="ad-box"><p>Buy</p></div><ul><li>x<li>y</ul><form><p>mail</p></form>
      <aside>more</aside><p hidden>no</p></div><section id="comments"><p>nice post, nice post, nice post</p></section><footer>&copy;</footer></body></html>"""
    assert html_text.Page(page).text(None) == "A & B\nFirst line goes on and on, for quite some text\nSecond <p> one é\nx\ny"
    for broken in ("", "<", "<p", "<div class='x", "</p></div>", "&am", "<![CDATA[", "<script>", "<!--", "<p>" * 3000, "<div>" * 3000, "a<b>c", "\x00", "<a href=\"x'>y"):
        html_text.Page(broken).text(None)
    assert html_text.Page("plain &amp; simple").text("html>body>article") == "plain & simple"


def test_hosts_agree_on_a_path(spark, tmp_path):
    side = "<div class='links{0}'><p>{1}</p></div>"
    body = "<div class='main'><p>{0}</p></div>"
    rows = [(k, f"http://H.com/{k}", "<body>" + side.format(k, "s" * 90) + body.format("text " * 30) + "</body>") for k in range(8)]
    rows += [(8, "http://h.com/8", "<body>" + side.format(8, "s" * 400) + body.format("short") + "</body>"), (9, None, None), (10, "x", ""), (11, "http://i.com", "<p>only"), (3, "http://h.com/3", "")]
    got = {}
    for r in op4_html_text(spark, write(spark, tmp_path, pages=(rows, PAGES))).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert got[8] == [("short", 5)] and got[9] == [("", 0)] and got[10] == [("", 0)] and got[11] == [("only", 4)] and len(got[3]) == 2
    assert op4_html_text(spark, write(spark, tmp_path / "e", pages=([], PAGES))).count() == 0


def test_attributes_are_read_as_such():
    body = '<article><p title="the hidden gems">a</p><p data-hidden="x">b</p><p data-id="share-12">c</p><p class="share-price">d</p><h1 class="search-results">e</h1>{}</article>'
    more = '<div class="comment-free-edition">f</div><div class="reader-comments">g</div><div class=share-buttons>h</div><p class=\'ad\'>i</p><p hidden>j</p><p data-x="a > b" aria-hidden="true">k</p>'
    assert html_text.Page(body.format(more)).text(None) == "a\nb\nc\nd\ne\nf"


def test_deep_pages_stay_small():
    import time
    import tracemalloc

    tracemalloc.start()
    start = time.time()
    for deep in ('<div class="row">' * 100_000 + "x", "<nav>" + "<div>" * 50_000 + "</div>" * 50_000 + "</nav>x", "<div>" * 50_000 + "x" + "</b></span></li>" * 50_000):
        assert html_text.Page(deep).text(None) == "x"
    assert time.time() - start < 60 and tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_page_text_of_a_whole_table_equals_plain_python(spark):
    d = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url, r.html or "") for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    votes, want = {}, []
    host = lambda url: ((url or "").split("//", 1) + [""])[1].split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].partition(":")[0].lower()
    for _, url, html in pages:
        page = html_text.Page(html)
        k, score = page.best()
        if score:
            of = votes.setdefault(host(url), {})
            of[page.path(k)] = of.get(page.path(k), 0) + min(100, 1 + int(score) // 100)
    for i, url, html in pages:
        of = votes.get(host(url), {})
        text = html_text.Page(html).text(max(of, key=lambda p: (of[p], p)) if of else None)
        want.append((i, url, text, len(text)))
    assert sorted(tuple(r) for r in op4_html_text(spark, d).collect()) == sorted(want)


# Rollups -----------------------------------------------------------------------------------------------------


def test_rollup(spark):
    schema = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    r = TokenRollup(spark, scratch_path(spark, "test"))
    total = lambda: {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert total() == {}
    assert r.apply("1", df(("insert", "a", "en", "t", 5, None), ("insert", "a", "en", "t", None, None), ("insert", None, None, "t", 2, None)))
    assert not r.apply("1", df(("insert", "a", "en", "t", 5, None)))
    r.apply("2", df(("revise", "a", "en", "t", 9, 5), ("delete", None, None, "t", 2, None)))
    assert total() == {("a", "en", "t"): (2, 9)}
    r.compact()
    assert total() == {("a", "en", "t"): (2, 9)} and not r.apply("2", df()) and r.committed("1")
    r.apply("3", df(("delete", "a", "en", "t", 9, None)))
    r.compact()
    assert total() == {("a", "en", "t"): (1, 0)} and r.committed("1") and r.committed("3")
    with pytest.raises(Exception):
        r.apply("4", df(("upsert", "a", "en", "t", 9, None)))
    assert not r.committed("4") and r.apply("4", df())


def test_rollup_of_real_tokens(spark):
    from domscope.llm.op10 import vocabulary
    from domscope.llm.token_rollup import bpe_changes
    from tests.llm.test_text_operators import tiktoken_encoding

    enc = tiktoken_encoding()
    docs = [("a", "en", "Hello there, world!", 4), ("a", "en", None, 1), ("b", "de", "Grüße " * 5000, 2), ("a", "en", "", None), (None, "en", "naïve 日本", 3)]
    df = spark.createDataFrame(docs, "source string, lang string, text string, old_tokens long")
    r = TokenRollup(spark, scratch_path(spark, "test"))
    assert r.apply("load", bpe_changes(df, "insert", "bpe", *vocabulary()))
    count = lambda s: sum(len(enc.encode_ordinary(t or "")) for x, _, t, _ in docs if x == s)
    want = {"a": (3, count("a")), "b": (1, count("b")), None: (1, count(None))}
    assert {x.source: (x.n_docs, x.n_tokens) for x in r.totals().collect()} == want
    assert r.apply("again", bpe_changes(df, "revise", "bpe", *vocabulary())) and not r._moved("batches/" + r._name("again"), "batches/" + r._name("load"))
    assert {x.source: (x.n_docs, x.n_tokens) for x in r.totals().collect()} == {s: (n, 2 * t - sum(o or 0 for x, _, _, o in docs if x == s)) for s, (n, t) in want.items()}


# Search ------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, tmp_path):
    random.seed(2)
    vec = lambda: [random.choice([-0.5, 0.0, 0.25, random.random()]) for _ in range(6)]
    rows = [(k, vec(), 0) for k in range(0, 400)]
    rows[7], rows[8], rows[9], rows[100] = (7, None, 0), (8, [0.1, None], 0), (9, [float("nan")] * 6, 0), (100, [float("inf")] * 6, 0)
    rows += [(k, rows[50][1], 0) for k in range(400, 420)] + [(None, vec(), 0), (3, rows[3][1], 0), (421, [], 0), (450, [0.9, 0.9], 0)]
    d = write(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = brute_top(ok)
    old = topk.BLOCK, topk.BLOCKS_A_SHARD, topk.LOT, topk.GROUP
    topk.BLOCK, topk.BLOCKS_A_SHARD, topk.LOT, topk.GROUP = 8, 2, 3, 4
    try:
        assert sorted(tuple(r) for r in op7_topk(spark, d).collect()) == want
    finally:
        topk.BLOCK, topk.BLOCKS_A_SHARD, topk.LOT, topk.GROUP = old
    assert op7_topk(spark, write(spark, tmp_path / "e", embeddings=([], "vec_id long, embedding array<float>, label int"))).count() == 0
    one = write(spark, tmp_path / "o", embeddings=([(0, [1.0], 0)], "vec_id long, embedding array<float>, label int"))
    assert op7_topk(spark, one).count() == 0


def brute_top(rows):
    """Of (id, cells): every query row against every other row, ties to the smaller id."""
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(rows) if c != q)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(want)


def test_no_vector_is_lost(spark, tmp_path):
    rows = [(0, [9e6, 0.0], 1), (1, [9e6, 0.0], 1), (2, [-2e6, 1.0], 1), (3, [1.0, 1.0], 1), (50, [1e7, 2.0], 1), (50, [5.0, 5.0], 1), (51, [0.5, 7.0], 1), (51, [0.5, 7.0], 1), (51, [8.0, -7.0], 1), (100, [-1e6, 0.25], 1)]
    d = write(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<double>, score int"))
    got = sorted(tuple(r) for r in op7_topk(spark, d).collect())
    assert got == brute_top([(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows]) and any(s > 2**53 for *_, s in got)


def test_what_does_not_fit_fails_loudly(spark, tmp_path):
    d = write(spark, tmp_path, embeddings=([(0, [1.0], 0), (1, [1e17], 0), (2, [2.0], 0)], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(Exception, match="does not fit 64 bits"):
        op7_topk(spark, d).collect()
    d = write(spark, tmp_path / "s", embeddings=([(0, [1e15], 0), (1, [1e15], 0)], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(Exception, match="a score does not fit 64 bits"):
        op7_topk(spark, d).collect()


def test_blocks_are_pruned(spark):
    rng = np.random.default_rng(0)
    cells = np.concatenate([np.full((512, 8), k) for k in range(10)]) + rng.integers(0, 2, (5120, 8))
    _, scored, of = topk.search(np.ones((1, 8), np.int64), np.array([-1]), np.array([topk._LEAST]), cells, np.arange(5120), 5, 512)
    assert scored < 4 and of == 10
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 8000)] + 0.05 * rng.normal(size=(8000, 16))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v / np.linalg.norm(v, axis=1)[:, None])], "vec_id long, embedding array<double>")
    old, topk.BLOCKS_A_SHARD = topk.BLOCKS_A_SHARD, 1
    try:
        _, seen = topk.search_all(df, F.col("vec_id") % 50 == 0, 5, 256, "vec_id", "embedding")
        r = seen.first()
        assert r.blocks >= 160 * 31 and r.scored < 0.2 * r.blocks
    finally:
        topk.BLOCKS_A_SHARD = old


# Line runs ---------------------------------------------------------------------------------------------------


def brute_runs(docs, least):
    """Later copies of every run of lines with the weight, from the definition."""
    lines = [(i, k, t.split("\n")) for k, (i, t) in enumerate(docs) if t is not None]
    order = sorted(lines, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))
    weight = lambda x: max(1, len(x.split()))
    seen, gone = {}, {k: set() for _, k, _ in lines}
    for _, k, ls in order:
        for s in range(len(ls)):
            for e in range(s + 1, len(ls) + 1):
                run = tuple(ls[s:e])
                if sum(map(weight, run)) >= least:
                    if run in seen:
                        gone[k].update(range(s, e))
                    else:
                        seen[run] = (k, s)
    return {k: "\n".join(x for n, x in enumerate(ls) if n not in gone[k]) for _, k, ls in lines}, gone


def test_line_dedup_equals_brute_force(spark):
    random.seed(11)
    pool = ["a b c", "d", "", "e f", "g h i j k", "l m"]
    docs = [(k, "\n".join(random.choice(pool) for _ in range(random.randint(1, 9)))) for k in range(40)]
    docs += [(k + 40, docs[k][1]) for k in range(6)] + [(100, None), (101, ""), (102, "\n\n\n\n\n\n\n\n\n"), (None, docs[0][1]), (103, "x y z\n" * 40), (104, "one line of its own words")]
    want, gone = brute_runs(docs, 7)
    df = spark.createDataFrame([(i, t, k, "own", "r") for k, (i, t) in enumerate(docs)], "doc_id long, text string, k int, n_removed string, __row string")
    rows = {r.k: r for r in dedup_lines(df, 7).collect()}
    assert len(rows) == len(docs)
    for k, (_, t) in enumerate(docs):
        assert rows[k].text == (want[k] if t is not None else None), k
        assert (rows[k].n_lines, rows[k].n_removed) == ((len(t.split("\n")), len(gone[k])) if t is not None else (0, 0))
    assert dedup_lines(df.limit(0)).count() == 0
    plan = dedup_lines(df, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ranks_are_a_suffix_array(spark):
    text = "b\na\nn\na\nn\na\nx\na\nn\na\nn\na"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("row", F.lit(0).cast("long"))
    lines = line_table(docs, "doc_id", "text").select("row", "id", F.posexplode("lines").alias("pos", "line")).select("row", "id", "pos", "line.*")
    order = {x: k for k, x in enumerate(sorted({r.pos: (r.a, r.b) for r in lines.collect()}.values()))}
    ids = [order[r.a, r.b] for r in sorted(lines.collect(), key=lambda r: r.pos)]
    _, levels = suffix_ranks(lines)
    for k, level in enumerate(levels):
        got = sorted((r["rank"], r.pos) for r in level.collect())
        keys = [tuple(ids[p : p + 2**k]) for _, p in got]
        assert keys == sorted(keys) and all((a[0] == b[0]) == (x == y) for a, b, x, y in zip(got, got[1:], keys, keys[1:]))
    assert len(levels) == 3  # the longest repeated run has five lines


# Near copies -------------------------------------------------------------------------------------------------


def brute_classes(docs):
    sets = {}
    for k, (_, t) in enumerate(docs):
        w = next(words_of(__import__("pyarrow").array([t], "string")))
        n = min(5, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    linked = {k: [j for j in sets if j != k and sets[k] and sets[j] and 10 * len(sets[k] & sets[j]) >= 8 * len(sets[k] | sets[j])] for k in sets}
    label = {}
    for k in sorted(sets, key=lambda k: docs[k][0]):
        if k not in label:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = docs[k][0]
                    todo += linked[x]
    return sorted((docs[k][0], label[k], len(linked[k])) for k in sets)


def test_near_copies_equal_brute_force(spark, tmp_path):
    random.seed(6)
    base = [[f"w{random.randrange(5000)}" for _ in range(random.randint(6, 120))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for _ in range(150):
        b = list(random.choice(base[:8]))
        for _ in range(random.randint(0, 6)):
            b[random.randrange(len(b))] = f"v{random.randrange(50)}"
        texts.append(" ".join(b))
    texts += texts[:10] + [None, "", "...", "a b", "A, b!", "a b c", "z " * 3000, "Z " * 3001]
    docs = list(enumerate(texts))
    d = write(spark, tmp_path, documents=([(i, t, "en", "s", 0) for i, t in docs], DOCS))
    want = brute_classes(docs)
    for block in (near_copies.BLOCK, 16):
        old, near_copies.BLOCK = near_copies.BLOCK, block
        try:
            assert sorted(tuple(r) for r in op6_near_copies(spark, d).collect()) == want
        finally:
            near_copies.BLOCK = old
    df = spark.createDataFrame([(1, "p q r s t u", "x"), (1, "p q r s t u", "y"), (None, "p q r s t u", "z"), (None, None, "n")], "doc_id long, text string, __row string")
    assert near_copies.keep_one(df).count() == 2
    assert op6_near_copies(spark, write(spark, tmp_path / "e", documents=([], DOCS))).count() == 0
    b, r = near_copies.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 64


def test_components(spark):
    random.seed(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 2), (2, 2), (7, 5), (5, 3)] + [(500, k) for k in range(501, 600)]
    random.shuffle(edges)
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 1: 1, 2: 1, 7: 3, 5: 3, 3: 3, **{k: 500 for k in range(500, 600)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(9)
    common = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(random.choices(common, k=n))
    bench = prose(30)
    docs = [prose(random.randint(30, 90)) for _ in range(300)]
    labels = []
    for k in range(200):
        if k % 4 == 0:
            docs[k] += " scum idiot vile"
        labels.append((k, 1, int(k % 4 == 0)))
    docs[250] = prose(70)
    passage = prose(60)
    docs += [f"{prose(12)}\n{passage}\n{prose(12)}", f"{prose(12)}\n{passage}\n{prose(12)}"]  # 300, 301
    near = prose(80).split()
    docs += [" ".join(near), " ".join(near[:-1] + ["end"])]  # 302, 303
    docs += [f"{prose(20)} {bench} {prose(20)}", docs[250], "", None]  # 304 - 307
    d = write(spark, tmp_path, documents=([(k, t, "en", "s", len(t or "")) for k, t in enumerate(docs)], DOCS), labels=(labels, "doc_id long, quality int, toxic int"), benchmark=([(1, bench)], "item_id long, text string"))
    seen = {}
    df = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, d)
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.asDict() for r in df.collect()}
        assert name == "byte_bpe" or df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {k for k in range(0, 200, 4)}
    assert toxic & set(seen["toxicity"]) == set() and set(seen["toxicity"]) == set(range(308)) - toxic
    lines = seen["line_dedup"]
    assert 305 not in lines and passage not in lines[301]["text"] and passage in lines[300]["text"] and lines[301]["n_chars"] == len(lines[301]["text"]) and {306, 307} <= set(lines)
    assert 303 not in seen["near_copies"] and 302 in seen["near_copies"] and set(lines) - set(seen["near_copies"]) == {303}
    clean = seen["benchmark_decontamination"]
    assert bench not in clean[304]["text"] and set(clean) == set(seen["near_copies"])
    last = seen["byte_bpe"]
    assert set(last) == set(clean) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last.values())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == sorted(last)
