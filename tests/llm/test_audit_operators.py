"""Licence notices, divergence of sources, Merkle manifests: edge rows and plain-Python versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from domscope.llm import divergence, merkle
from domscope.llm.license_scan import NOTICES, Notice, Scanner, pieces, scan
from domscope.llm.op11 import op11_licenses
from domscope.llm.op12 import op12_divergence
from domscope.llm.op13 import op13_merkle
from tests.conftest import DATA
from tests.llm.test_text_operators import DOCS, write

CLASH = "__text string, __row long, tree string, node string, kept string, notices string, n_words long, term string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
lowered = lambda text: re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def clashing(spark, tmp_path, docs):
    """A folder whose documents have further columns that are named like those the operators use."""
    d = write(spark, tmp_path, documents=([(*r, *["x", 1, "x", "x", "x", "x", 1, "x"]) for r in docs], f"{DOCS}, {CLASH}"))
    return d


# Licence notices ---------------------------------------------------------------------------------------------


def least_edits(notice, text):
    """The fewest edits with which the notice stands anywhere in a text of words; its fixed words and the spaces around them can't change."""
    whole, literal, at = f" {notice.phrase} ", set(), 1
    for w in notice.phrase.split(" "):
        if w in notice.fixed:
            literal |= set(range(at - 1, at + len(w) + 1))
        at += len(w) + 1
    text = f" {text} "
    before = [0] * (len(text) + 1)
    for i, c in enumerate(whole):
        now = [99] * (len(text) + 1)
        within = i in literal and i + 1 in literal
        for j in range(len(text) + 1):
            best = before[j - 1] if j and text[j - 1] == c else 99
            if i not in literal:
                best = min(best, before[j] + 1, before[j - 1] + 1 if j else 99)
            if j and not within and i + 1 < len(whole):
                best = min(best, now[j - 1] + 1)
            now[j] = best
        before = now
    return min(before)


def test_notices_equal_edit_distances():
    random.seed(3)
    scanner = Scanner(NOTICES)
    for _ in range(400):
        notice = random.choice(NOTICES)
        s = list(f"xx {notice.phrase} yy")
        for _ in range(random.randint(0, notice.edits + 2)):
            i = random.randrange(len(s))
            s[i : i + random.randint(0, 1)] = random.choice(["", "e", "n", " ", "2", "ü"])
        text = " ".join("".join(s).split())
        got = {}
        for k, _, _, edits in scanner.places(text.encode().split()):
            got[k] = min(edits, got.get(k, 99))
        want = {k: e for k, n in enumerate(NOTICES) if (e := least_edits(n, text)) <= n.edits}
        assert got == want, text


def test_pieces_make_up_the_phrase():
    for n in NOTICES:
        cut = pieces(n.phrase, n.edits)
        assert "".join(p for _, p in cut) == f" {n.phrase} " and len(cut) == n.edits + 1 and all(p for _, p in cut)


def plain_base(text):
    words = WORD.findall(lowered(text))
    found = [(n.label, i) for n in NOTICES if n.base for i in range(len(words)) if words[i : i + len(n.phrase.split())] == n.phrase.split()]
    at = [i for _, i in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in found}))


def test_base_places_of_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op11_licenses(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_edges_of_notices(spark, tmp_path):
    mit, many = "Released under the MIT License.", "cc by nc " * 30000
    texts = [None, "", mit, "Released undr the MIT Licence", "thunder the mit licence", "under the mat license", many, f"{mit} {mit}", "APACHE LICENSE,\nVersion 2.0", "Apache Licence Version 3", "Cc-By-Nd", "İ under the MİT license", "GNU General Publik License, version 3", mit]
    d = clashing(spark, tmp_path, [(k, t, None, None, None) for k, t in enumerate(texts)] + [(2, mit, "en", "s", 1), (None, mit, None, None, None)])
    rows = op11_licenses(spark, d).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r for r in rows}
    for k, t in enumerate(texts):
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels) == plain_base(t)
    assert [got[k].labels for k in range(len(texts))] == ["", "", "mit", "mit", "mit", "", "cc-by-nc", "mit", "apache-2", "", "", "", "gpl-3", "mit"]
    assert got[3].score == 1 - 2 / 21 and got[6].n_base == 30000
    assert op11_licenses(spark, write(spark, tmp_path / "e", documents=([], DOCS))).count() == 0
    spans = scan(spark.createDataFrame([("a b under the mit licence z", 7)], "text string, n_words int"), keep=["text", "n_words"]).first()
    assert spans.n_words == 7 and [(n.label, n.base, n.begin, n.end, n.edits) for n in spans.notices] == [("mit", False, 2, 6, 1)]
    with pytest.raises(ValueError):
        Scanner([Notice("x", "y" * 200_000)])


# Divergence --------------------------------------------------------------------------------------------------


def plain_divergences(docs, min_docs, top):
    counts, having, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in docs:
        lang, source, terms = lang or "", source or "", TERM.findall(lowered(text))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        having[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in having[lang].items() if n >= min_docs]
        counts[lang, None] = sum((counts[lang, s] for s in sources), Counter())
        share = lambda s, t: 1 + 10**9 * (counts[lang, s][t] + 2) // (sum(counts[lang, s][x] for x in kept) + 2 * len(kept))
        shares = {s: {t: share(s, t) for t in kept} for s in [*sources, None]}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            parts = {"pair": [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]}
            parts["term"] = [(t, f(shares[s][t], shares[None][t])) for t in kept if counts[lang, s][t] and shares[s][t] > shares[None][t]]
            for part, values in parts.items():
                values.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(values[: top if part == "term" else None])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergences_equal_plain_sums(spark, tmp_path, monkeypatch, small):
    """With small slices, pieces and tables of counts, every path is taken."""
    random.seed(6)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "éüx"] + ["Ärger", "don't", "x9y", "\x00zero", "ABC"]
    docs = [(k, " ".join(random.choices(words, k=random.randint(0, 60))), random.choice(["en", "de", None]), random.choice(["s1", "s2", "s3", "ü", None]), None) for k in range(150)]
    docs += [(900, None, "fr", "only", None), (901, "", "nil", "a", None), (902, " 123 ", "nil", "b", None), (903, "rare " * 40000, "en", "s1", 5), docs[0], docs[0], (None, "ab ab", "en", "s2", 1)]
    d = clashing(spark, tmp_path, docs)
    frame = spark.read.parquet(f"{d}/documents.parquet")
    if small:  # tasks get these values with the functions' module only where it is the same process, so the functions are called here
        monkeypatch.setattr(divergence, "SLICE", 300)
        monkeypatch.setattr(divergence, "PIECE", 20)
        monkeypatch.setattr(divergence, "HELD", 50)
        batches = [b for b in frame.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).toArrow().to_batches()]
        got = Counter()
        for b in divergence._count(iter(batches)):
            for r in b.to_pylist():
                got[r["lang"], r["source"], r["term"]] += r["n"]
        want = Counter()
        for _, text, lang, source, _ in docs:
            for t in TERM.findall(lowered(text)):
                want[lang or "", source or "", t] += 1
        assert +got == want and {k[:2] for k in got} == {(x[2] or "", x[3] or "") for x in docs}
        return
    for min_docs, top in ((10, 10), (1, 3), (1000, 10)):
        got = sorted(tuple(r) for r in divergence.divergences(frame, min_docs, top).collect())
        assert got == plain_divergences(docs, min_docs, top)
    assert op12_divergence(spark, write(spark, tmp_path / "e", documents=([], DOCS))).count() == 0


# Merkle manifests --------------------------------------------------------------------------------------------


def plain_merkle(docs):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: digest("".join(map(field, (r[0], r[3], r[2], n, r[1]))))

    def build(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, k in zip(proofs, at):
                p.append((nodes[k ^ 1] if k ^ 1 < len(nodes) else "", k % 2))
            nodes, at = [digest("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)], [k // 2 for k in at]
        return nodes[0], proofs

    trees = defaultdict(list)
    for r in docs:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {t: build([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in order}
    root, tops = build([built[t][0] for t in order]) if order else (None, [])
    out = []
    for t, top in zip(order, tops):
        subroot, proofs = built[t]
        for (_, _, own, r), proof in zip(sorted(trees[t], key=lambda x: x[:3]), proofs):
            node = leaf(r, r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 else r[4] + 1)
            for beside, right in proof + top:
                node = digest(beside + node if right else node + beside)
            out.append((r[0], own, subroot, root, digest("".join(b for b, _ in proof + top)), node, node == root))
    return sorted(out, key=str)


def test_manifests_equal_plain_trees(spark, tmp_path, monkeypatch):
    random.seed(9)
    docs = [(k * 3, random.choice([None, "", "é\n1:a", "text " * k]), lang, random.choice([None, "s1", "ü"]), random.choice([None, k])) for lang, n in ((None, 5), ("", 1), ("en", 70), ("Ä", 17), ("de", 16), ("z", 2)) for k in range(n)]
    docs += [docs[0], docs[40], docs[40], (None, "x", "en", None, 1), (None, "y", "en", None, 2), (500, "long " * 300_000, "en", "s", 7)]
    d = clashing(spark, tmp_path, docs)
    want = plain_merkle(docs)
    for step in (10, 1, 2):
        monkeypatch.setattr(merkle, "STEP", step)
        rows = op13_merkle(spark, d).collect()
        assert sorted((tuple(r) for r in rows), key=str) == want
    assert {r.verified for r in rows} == {True, False}
    one = [(7, "x", None, None, 1)]
    assert [tuple(r) for r in op13_merkle(spark, write(spark, tmp_path / "o", documents=(one, DOCS))).collect()] == plain_merkle(one)
    assert op13_merkle(spark, write(spark, tmp_path / "e", documents=([], DOCS))).count() == 0


def test_proofs_fold_to_the_root(spark):
    held = merkle.manifest(spark.read.parquet(f"{DATA}/orders.parquet"), merkle.leaf_of(F.col("o_orderkey"), F.col("o_totalprice")), "o_orderstatus", "o_orderkey")
    good = held.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root"))
    assert good.count() == held.count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert held.where(merkle.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).isEmpty()
