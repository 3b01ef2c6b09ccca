from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from domscope import schemas
from domscope.operators import attribution, catalog, client, detection, entities, housekeeping, lookalike, situation
from domscope.plans import relational
from domscope.streaming import schedule

PROFILE = "organization_id int, name string, alias array<string>, previous_domains array<string>, keywords array<string>, common_tlds array<string>, version string"


def brute_scores(domain, profile):
    """The score by its definition, in plain Python."""
    import re

    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))} if s else set()
    org, name, alias, iocs, keywords, tlds, _ = profile
    tokens = {t for t in re.split(r"[-_.\d]+", domain) if t}
    ioc = max([len(grams(domain) & grams(i)) / len(grams(domain) | grams(i)) for i in iocs] or [0])
    words = {t for x in [name, *alias] for t in re.split(r"[-_.\d\s]+", x.lower()) if t}
    parts = domain.split(".")
    login, security, service = ({"login", "account"} & tokens, {"verify", "secure"} & tokens, {"mail", "web"} & tokens)
    pattern = 0.9 if login and security and service else 0.6 if login and security else 0
    return 0.45 * ioc + 0.2 * (len(tokens & set(keywords)) / len(keywords) if keywords else 0) + 0.1 * (parts[-1] in tlds) + 0.15 * pattern + 0.1 * (parts[-2] in words)


@pytest.mark.parametrize("most", [200, 3, 0])
def test_attribution_equals_all_pairs(spark, most):
    import random

    random.seed(4)
    word = lambda: random.choice(["mail", "login", "verify", "bank", "army", "gov", "zeta", "shop", "secure", "web"])
    name = lambda: f"{word()}-{word()}.{word()}.{random.choice(['com', 'org', 'top', 'co'])}"
    profs = [(k, f"Team {word()}", [word()], [name() for _ in range(random.randint(0, 4))], [word() for _ in range(random.randint(0, 2))], random.sample(["com", "org", "top", "info"], random.randint(0, 2)), "v") for k in range(25)]
    profs = [(o, n, a, i, sorted({*k}), t, v) for o, n, a, i, k, t, v in profs]
    domains = sorted({name() for _ in range(40)} | {"nothing.xyz", "qqq.qq"})
    found = attribution.candidates(spark.createDataFrame([(d,) for d in domains], "domain string"), spark.createDataFrame(profs, PROFILE), most=most)
    got = {}
    for r in found.collect():
        got.setdefault(r.domain, []).append((r.rank, r.organization_id, round(r.score, 9)))
    for d in domains:
        best = sorted(((-round(brute_scores(d, p), 12), p[0]) for p in profs))[:5]
        assert sorted(got[d]) == [(k + 1, o, round(-s, 9)) for k, (s, o) in enumerate(best)], d


def test_alert_document(spark):
    profs = spark.createDataFrame([(1, "Zeta", ["zz"], ["mail-login.zeta.com"], ["mail"], ["com"], "v1"), (2, "Other", [], [], [], [], "v2")], PROFILE)
    high = spark.createDataFrame([("Mail-Login.zeta.com", 1), ("mail-login.ZETA.com", 2), (" ", 3), ("un.known", 4)], "domain string, position int")
    best = attribution.best_matches(attribution.candidates(high, profs))
    scores = spark.createDataFrame([("MAIL-login.zeta.com", 0.2, 1), ("mail-login.zeta.com", 0.91, 2)], "domain string, score double, position int")
    items = attribution.alert_items(high, best, scores)
    rows = {r.domain: r for r in items.collect()}
    assert rows["Mail-Login.zeta.com"].risk_score == 0.91 and rows["Mail-Login.zeta.com"].risk_level == "high" and len(rows) == 2
    assert rows["un.known"].risk_level == "low" and rows["un.known"].matched_organizations == []
    import json

    alert = spark.createDataFrame([("a", 9)], "alert_id string, detected_count int")
    text = attribution.alert_document(alert, items).first().document
    assert text.startswith('{\n  "schema_version" : "v1",\n') and "未" not in text.split("evidence_lines")[0]
    d = json.loads(text)
    assert d["schema_version"] == "v1" and d["summary"] == {"detected_count": 9, "high_risk_count": 2} and [x["domain"] for x in d["high_risk_domains"]] == ["Mail-Login.zeta.com", "un.known"]
    groups = attribution.by_organization(best)
    assert [(r.organization, r.n, r.known) for r in groups.collect()] == [("Zeta", 1, True), ("未知", 1, False)]
    assert attribution.notice_text(groups).first().text.startswith("本批次高风险域名数量：2\n已形成组织关联的域名数量：1")
    assert attribution.version_of(best.where("organization_id IS NOT NULL").select("organization_id"), profs).first().version == "v1"
    stored = spark.createDataFrame([], schemas.schema("alert_domain_matches"))
    domains = spark.createDataFrame([(7, "un.known")], "id int, domain_name string")
    once = attribution.persist_matches(stored, best, domains, "a", F.lit(datetime(2024, 1, 1)))
    assert once.count() == 2 and attribution.persist_matches(once, best, domains, "a", F.lit(datetime(2024, 1, 1))).count() == 2


def test_profiles(spark):
    orgs = spark.createDataFrame([(1, " A ", "x|y", date(2024, 1, 5)), (2, "", None, None), (None, "N", None, None)], "id int, name string, alias string, update_time date")
    doms = spark.createDataFrame([(1, "Login-Portal.example.com "), (1, None), (3, "q.com")], "organization_id int, domain_name string")
    p = attribution.profiles(orgs, doms).collect()
    assert len(p) == 1 and (p[0].name, p[0].alias, p[0].keywords, p[0].common_tlds, p[0].version) == ("A", ["x", "y"], ["example", "login", "portal"], ["com"], "apt_org:20240105")


def test_look_alikes(spark):
    official = spark.createDataFrame([("Old", "Example.com", 1), ("New", "example.com", 2), ("Far", "completely-other.org", 3)], "company string, domain string, position int")
    seen = spark.createDataFrame([("examp1e.com",), ("EXAMPLE.com ",), ("example.com",), ("zzzzzzzzzzzzzzzzzzzzzzzzzz.net",)], "domain string")
    matches, stats = lookalike.look_alikes(seen, official, threshold=0.4)
    rows = {r.domain: r for r in matches.collect()}
    assert set(rows) == {"examp1e.com", "example.com"} and rows["example.com"].company == "New" and rows["example.com"].similarity == "1.0000"
    s = stats.first()
    assert (s.total, s.phishing, s.benign) == (4, 2, 2)
    exact = lookalike.look_alikes(seen, official, threshold=1.0)[0]
    assert exact.count() == 0  # a similarity must exceed the threshold


def test_best_target_is_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lookalike, "LOT", 7)
    monkeypatch.setattr(lookalike, "CANDIDATES", 5)
    monkeypatch.setattr(lookalike, "ROWS", 3)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(60)]
    rows[30:45] = [(k, rows[30][1]) for k in range(30, 45)]
    rows[7], rows[8], rows[9] = (7, None), (8, [0.1, None]), (9, [float("nan")] * 6)
    rows[50] = (50, [0.0] * 6)
    e = spark.createDataFrame(rows, "id long, v array<double>")
    ok = {i: np.array(v) for i, v in rows if i not in (7, 8, 9)}
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in ok.items()}
    want = {i: min(((-round(float(unit[i] @ unit[t]), 9) + 0.0, t) for t in unit if t != i)) for i in unit}
    got = {r.id: r for r in lookalike.best_target(e, e.withColumn("o", F.col("id")), {"v": 1.0}, "id", "id", "o", itself=False).collect()}
    assert set(got) == set(range(60)) and all(got[i].target is None for i in (7, 8, 9))
    assert {i: got[i].target for i in want} == {i: t for i, (_, t) in want.items()}
    assert all(abs(got[i].similarity + s) < 1e-8 for i, (s, _) in want.items())


def test_lots_out_of_reach_are_left_out(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lookalike, "LOT", 10)
    rng = np.random.default_rng(2)
    spots = rng.normal(size=(20, 8))
    rows = [(k, (spots[k % 20] * 9 + rng.normal(size=8) * 0.3).tolist()) for k in range(400)]
    e = spark.createDataFrame(rows, "id long, v array<double>").withColumn("o", F.col("id"))
    sent = []
    elsewhere = lookalike._elsewhere
    monkeypatch.setattr(lookalike, "_elsewhere", lambda *a: sent.append(elsewhere(*a)) or sent[-1])
    got = {r.id: r.target for r in lookalike.best_target(e, e, {"v": 1.0}, "id", "id", "o", itself=False).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    scores = unit @ unit.T - 2 * np.eye(400)
    assert got == {k: int(scores[k].argmax()) for k in range(400)}
    assert sent[0].agg(F.sum(F.size("names"))).first()[0] < 400 * 40 * 0.2


def test_look_alikes_of_all_names(spark):
    official = spark.createDataFrame([("A", "example.com", 1), ("B", "examp1e.com", 2), ("C", "completely-other.org", 3)], "company string, domain string, position int")
    matches, stats = lookalike.look_alikes(official.select("domain"), official, threshold=0.3, itself=False)
    assert {(r.domain, r.target, r.company) for r in matches.collect()} == {("example.com", "examp1e.com", "B"), ("examp1e.com", "example.com", "A")}
    assert (stats.first().total, stats.first().phishing) == (3, 2)


def test_detection(spark):
    rows = spark.createDataFrame([(f"{'a-b' if k % 2 else 'ab'}{k}.com", k % 2, k) for k in range(60)], "domain string, label int, id int")
    fit, held = detection.stratified_split(rows, "label", "id")
    assert (fit.count(), held.count()) == (48, 12) and fit.join(held, "id").count() == 0
    out = detection.predict(detection.train(detection.with_features(fit), trees=5), detection.with_features(held), threshold=0.5)
    assert detection.metrics(out, "label", "predicted").first().accuracy == 1.0
    svm = detection.predict(detection.train(detection.with_features(fit), kind="svm"), detection.with_features(held))
    assert {r.probability for r in svm.collect()} <= {0.0, 1.0}
    alerts = spark.createDataFrame([("a.com", 1, 0.5, 1), ("B.com", 1, 0.9, 2), ("b.com", 1, 0.8, 3), ("c.com", 0, 0.9, 4)], "domain string, predicted int, probability double, position int")
    assert [r.domain for r in detection.alert_rows(alerts, 50).collect()] == ["B.com"]
    s = detection.statistics(alerts.limit(0), F.col("predicted") == 1).first()
    assert (s.total, s.malicious, s.rate, s.rate_text) == (0, 0, 0.0, "0.00%")
    m = detection.metrics(alerts.limit(0), "predicted", "predicted").first()
    assert (m.accuracy, m.f1) == (0.0, 0.0)


def test_relational(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, " ")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (3, "z"), (4, "w"), (4, "w")], "k int, v string")
    up = lambda blank: {r.k: r.v for r in relational.update_from(a, b.distinct(), F.expr("t.k = s.k"), only_blank=blank, v="v").collect()}
    assert up(False) == {1: "y", 2: None, 3: "z"} and up(True) == {1: "x", 2: None, 3: "z"}
    assert sorted(r.k for r in relational.insert_missing(a, b, ["k"]).collect()) == [1, 2, 3, 4]
    empty = a.limit(0)
    assert relational.with_fallback(empty, b).count() == 4 and relational.with_fallback(a, b).count() == 3
    assert [r.k for r in relational.page(a, [F.col("k")], 2, 2).collect()] == [3]
    with pytest.raises(ValueError):
        relational.page(a, [F.col("k")], 0, 2)
    assert [r.k for r in relational.missing_from(a, "k", (spark.createDataFrame([(1,), (None,)], "q int"), "q")).orderBy("k").collect()] == [2, 3]
    t = spark.createDataFrame([(1, None, 5), (1, 3, 1), (1, 3, 2)], "k int, w int, id int")
    assert relational.latest_by_key(t, ["k"], "w", "id").first().id == 2


def test_listings(spark):
    orgs = spark.createDataFrame([(1, "Lazarus-Group", ["Hidden Cobra"]), (2, "Other", ["lazarus group", "kimsuky x"]), (3, "Deep Panda Team", [])], "id int, name string, alias array<string>")
    ev = spark.createDataFrame([(1, 3, "x"), (2, None, "LAZARUS group"), (3, None, "hidden_cobra"), (4, 99, "panda"), (5, None, "nobody"), (6, None, None)], "eid int, org int, org_name string")
    got = {r.eid: r.resolved_id for r in client.resolve_organization(ev, "eid", "org", "org_name", orgs).collect()}
    assert got == {1: 3, 2: 1, 3: 1, 4: 3, 5: None, 6: None}
    days = spark.createDataFrame([(date(2024, 3, 10),), (date(2024, 3, 20),)], "d date")
    span = client.timeline_range(days, "d").first()
    assert (span.first, span["last"]) == (date(2024, 2, 1), date(2024, 4, 30)) and span.days == 89
    assert client.timeline_months(client.timeline_range(days, "d")).count() == 3
    assert client.timeline_range(days.limit(0), "d").first()["first"] is None
    models = spark.createDataFrame([(1, "malicious"), (2, None), (3, "x")], "id int, model_category string")
    pick = lambda c: sorted(r.id for r in models.where(client.market_filter(c)).collect())
    assert (pick("other"), pick("malicious"), pick(None)) == ([2, 3], [1], [1, 2, 3])
    assert situation.count_by(spark.createDataFrame([("a",), ("",), (None,), ("a",)], "r string"), "r").collect()[0]["count"] == 2


def test_catalog_and_housekeeping(spark):
    models = spark.createDataFrame([(1, "m", True, "ann", "ready"), (2, "n", False, "7", "ready")], "id long, name string, is_public boolean, created_by string, status string")
    links = spark.createDataFrame([(1, 5, 1, "official", None, True), (2, 5, 2, "custom", None, False)], schemas.schema("user_models"))
    assert [r.model_id for r in catalog.models_of(links, models, 5).collect()] == [1]
    assert catalog.acquire(links, models, 6, 1, F.lit(datetime(2024, 1, 1))).count() == 3 and catalog.acquire(links, models, 6, 2, F.lit(datetime(2024, 1, 1))).count() == 2
    assert catalog.publish(models, 2, "7").where("is_public").count() == 2
    m, rest = catalog.soft_delete(models, links, 1)
    assert m.where("status = 'deleted'").count() == 1 and rest.count() == 1
    matches = spark.createDataFrame([(1, "a", "x.com", "low", None), (2, "a", "y.com", "high", 0.9), (3, "b", "z.com", "low", 0.1)], "id long, alert_id string, domain_name string, confidence string, actor_score double").withColumns({"status": F.lit("pending"), "created_at": F.lit(1), "organization_name": F.lit("O")})
    assert [r.id for r in housekeeping.match_search(matches).collect()] == [2, 3, 1]
    assert [r.id for r in housekeeping.match_search(matches, domain=" X", confidence="low").collect()] == [1]
    assert housekeeping.mark_match(matches, 2, " Confirmed ").where("status = 'confirmed'").count() == 1
    with pytest.raises(ValueError):
        housekeeping.mark_match(matches, 2, "no")
    alerts = spark.createDataFrame([("a", 1), ("b", 2)], "alert_id string, user_id int")
    assert housekeeping.owned_matches(matches, alerts, 2).count() == 1
    gone = housekeeping.drop_alerts(alerts, F.col("alert_id") == "a", matches, matches, matches)
    assert (gone["alerts"].count(), gone["alert_domain_matches"].count()) == (1, 1)
    assert schemas.outside_enum(spark.createDataFrame([("done",), ("failed",), (None,)], "status string"), "tasks").count() == 1
    assert schemas.conform(models, "models").columns == schemas.schema("models").names


def test_domain_detail(spark):
    d = spark.createDataFrame([(1, "a.com", 4)], "id int, domain_name string, organization_id int")
    w = spark.createDataFrame([(1, 1, "old", 1), (2, 1, "new", 2), (3, 9, "x", 3)], "id int, domain_id int, registrar string, query_time int")
    dns = spark.createDataFrame([(1, 1, "MX", "a"), (2, 1, "A", "a")], "id int, domain_id int, record_type string, record_name string")
    c = spark.createDataFrame([(1, 1, 5)], "id int, domain_id int, created_at int")
    o = spark.createDataFrame([(4, "Org")], "id int, name string")
    got = entities.domain_detail(d, " A.com ", o, w, dns, c)
    assert (got["domain"].first().organization, got["whois"].first().registrar, [r.record_type for r in got["dns"].collect()], got["certificate"].count()) == ("Org", "new", ["A", "MX"], 1)
    assert all(f.count() == 0 for f in entities.domain_detail(d, "no.com", o, w, dns, c).values())


def test_schedules(spark):
    t = spark.createDataFrame([(1, "7", 3, datetime(2024, 1, 1), '{"subscription_id": "s1", "dateRange": ["2024-01-01", "2024-01-02"], "result_file_key": "k"}', "completed"), (2, "7", 3, datetime(2024, 1, 2), '{"subscription_id": "s2", "dateRange": ["2024-01-03", "2024-01-04"]}', "completed"), (3, "8", 3, datetime(2024, 1, 2), None, "pending")], "id int, created_by string, model_id int, created_at timestamp, extra string, status string")
    marks = {(r.created_by, r.subscription_id): str(r["last"]) for r in schedule.high_water(t).collect()}
    assert marks == {("7", "s2"): "2024-01-04", ("8", None): "None"}
    assert {r.subscription_id: str(r["last"]) for r in schedule.own_high_water(t).collect()} == {"s1": "2024-01-02", "s2": "2024-01-04"}
    assert sorted(r.id for r in schedule.unfinished(t).collect()) == [2, 3]
    s = spark.createDataFrame([(1, True, datetime(2024, 1, 1, 9)), (2, True, datetime(2024, 1, 5)), (3, False, datetime(2024, 1, 1)), (4, True, datetime(2023, 12, 1))], "id int, is_active boolean, next_run_at timestamp_ntz")
    now = F.lit(datetime(2024, 1, 1, 9)).cast("timestamp_ntz")
    assert sorted(r.id for r in schedule.due(s, now).collect()) == [1, 4] and [r.id for r in schedule.missed(s, now).collect()] == [1]


def test_split_is_exact(spark):
    import math

    rows = [(k, "abc"[0 if k % 10 < 7 else 1 if k % 10 < 9 else 2]) for k in range(103)] + [(500, None), (501, None), (7, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "id long, label string")
    fit, held = detection.stratified_split(df, "label", "id", 0.7)
    n = {x: sum(r[1] == x for r in rows) for x in (None, "a", "b", "c")}
    whole = len(rows) - math.ceil(len(rows) * 0.3)
    exact = {x: k * whole / len(rows) for x, k in n.items()}
    take = {x: int(e) for x, e in exact.items()}
    for x in sorted(n, key=lambda x: (-(exact[x] - take[x]), x is not None, x or ""))[: whole - sum(take.values())]:
        take[x] += 1
    got = {r.label: r["count"] for r in fit.groupBy("label").count().collect()}
    assert got == take and sorted(map(str, fit.unionByName(held).collect())) == sorted(map(str, df.collect()))
    again = detection.stratified_split(df.repartition(3), "label", "id", 0.7)[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, fit.collect()))
    empty = detection.stratified_split(df.limit(0), "label", "id")
    assert empty[0].count() == empty[1].count() == 0


def test_numbers_are_dense(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS g", "CAST(NULL AS string) AS nothing")
    assert sorted(r.n for r in relational.numbered(df, "id", "n").collect()) == list(range(1, 501))
    by = relational.numbered(df, "id", "n", ["g", "nothing"], buckets=4).groupBy("g").agg(F.sort_array(F.collect_list("n")).alias("n")).collect()
    assert all(r.n == list(range(1, len(r.n) + 1)) for r in by) and len(by) == 3


def test_segmenter_is_brute_force():
    import itertools
    import math
    import random

    from domscope.functions import lexical

    words = {"mail": 50, "server": 40, "serv": 3, "er": 2, "army": 10, "my": 30, "ar": 1, "log": 8, "in": 60, "login": 20}
    pairs, total = {"mail server": 30, "log in": 7.9, "my mail": 11}, 224.0

    def score(ws):
        s = 0
        for before, w in zip(["<s>", *ws], ws):
            pair = pairs.get(f"{before} {w}") if before in words else None
            s += math.log10(pair / words[before]) if pair else math.log10(words[w] / total) if w in words else math.log10(10 / (total * 10 ** len(w)))
        return s

    random.seed(3)
    for _ in range(60):
        t = "".join(random.choice([*words, "q", "zz"]) for _ in range(3))[:13]
        cuts = ([0, *c, len(t)] for k in range(len(t)) for c in itertools.combinations(range(1, len(t)), k))
        best = max(score([t[a:b] for a, b in zip(c, c[1:])]) for c in cuts)
        got = lexical.segmented(t, words, pairs, total)
        assert "".join(got) == t and abs(score(got) - best) < 1e-9
    assert lexical.segmented("", words, pairs, total) == [] and lexical.segmented("-.", words, pairs, total) == []
    assert "".join(lexical.segmented("x" * 400, words, pairs, total)) == "x" * 400


def test_features_with_a_dictionary(spark):
    from domscope.functions import lexical

    segment = lexical.dictionary_segmenter({"mail": 50, "server": 40, "login": 20, "gov": 9})
    rows = spark.createDataFrame([("mailserver12-login.com",), ("12345678.com",), ("",), (None,)], "d string")
    got = detection.with_features(rows, "d", segment).collect()
    r = got[0]
    assert (r.words, r.split_parts, r.split_mean, r.edit_mail) == (4.0, 1.0, 12.0, 0.0)
    assert (got[1].words, got[1].split_parts) == (1.0, 0.0) and got[2].words == 1.0


def test_public_suffixes(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "uk", "co.uk", "*.ck", "!www.ck", None, " ")], "rule string")
    names = ["a.b.com", "com", "x.y.co.uk", "co.uk", "shop.any.ck", "www.ck", "a.www.ck", "10.0.0.1", "x.unknown", "unknown", ""]
    got = {r.domain: (r.sld, r.tld) for r in attribution.public_suffixes(rules)(spark.createDataFrame([(n,) for n in names], "domain string")).collect()}
    assert got == {"a.b.com": ("b", "com"), "com": ("", "com"), "x.y.co.uk": ("y", "co.uk"), "co.uk": ("", "co.uk"), "shop.any.ck": ("shop", "any.ck"), "www.ck": ("www", "ck"), "a.www.ck": ("www", "ck"), "10.0.0.1": ("10.0.0.1", ""), "x.unknown": ("unknown", ""), "unknown": ("unknown", ""), "": ("", "")}
    profs = spark.createDataFrame([(1, "Y", [], [], [], ["co.uk"], "v")], PROFILE)
    r = attribution.candidates(spark.createDataFrame([("x.y.co.uk",)], "domain string"), profs, split=attribution.public_suffixes(rules)).first()
    assert r.tld_hit and r.label_hit


def test_domains_are_created_once(spark):
    there = spark.createDataFrame([(4, "A.com"), (9, "b.com")], "id int, domain_name string")
    names = spark.createDataFrame([("a.COM",), ("new.org ",), ("NEW.org",), ("x.net",), (" ",), (None,)], "domain string")
    once = attribution.create_domains(there, names, F.lit("2024-01-01"))
    rows = {r.domain_name: r.id for r in once.collect()}
    assert set(rows) == {"A.com", "b.com", "NEW.org", "x.net"} and {rows["NEW.org"], rows["x.net"]} == {10, 11} and once.dtypes == there.dtypes
    assert attribution.create_domains(once, names, F.lit("2024-01-01")).count() == 4
    assert attribution.create_domains(there.limit(0), names, F.lit("2024-01-01")).agg(F.max("id")).first()[0] == 3


def test_profile_tables_equal_profiles(spark):
    kind = "id int, name string, alias string, previous_domains array<string>, keywords array<string>, common_tlds array<string>, is_active int, profile_version string, updated_at timestamp, update_time date"
    orgs = spark.createDataFrame(
        [
            (1, " Team Alpha ", "Al-pha | beta", [" Own.NET ", ""], None, None, 1, None, datetime(2024, 1, 2), None), (2, "Beta", None, None, ["Mail", " login "], [".COM", "org"], 1, "v9", None, None),
            (3, "Gamma", "", [], [], [], 1, None, None, date(2024, 2, 3)), (4, "off", None, None, None, None, 0, None, None, None), (5, " ", None, None, None, None, 1, None, None, None), (None, "x", None, None, None, None, 1, None, None, None),
        ],
        kind,
    )
    doms = spark.createDataFrame([(1, "Mail-login.alpha.com"), (1, "mail-login.ALPHA.com "), (1, "b.org"), (2, "c.info"), (3, "single"), (4, "d.com"), (None, "e.com"), (1, None), (9, "f.com")], "organization_id int, domain_name string")
    rows, whole = attribution.profile_rows(orgs, doms), {r.organization_id: r for r in attribution.profiles(orgs, doms).collect()}
    listed = lambda df, c: {o: sorted(r[c] for r in df.collect() if r.organization_id == o) for o in whole}
    assert set(whole) == {1, 2, 3} == {r.organization_id for r in rows.organizations.collect()}
    assert listed(rows.iocs, "ioc") == {o: r.previous_domains for o, r in whole.items()}
    assert {(r.organization_id, r.place - 1, r.ioc) for r in rows.iocs.collect()} == {(o, k, d) for o, r in whole.items() for k, d in enumerate(r.previous_domains)}
    assert listed(rows.keywords, "word") == {1: ["alpha", "login", "mail", "own"], 2: ["login", "mail"], 3: []} and listed(rows.tlds, "tld") == {1: ["com", "net", "org"], 2: ["com", "org"], 3: []}
    assert {r.organization_id: r.version for r in rows.organizations.collect()} == {o: r.version for o, r in whole.items()}
    names = spark.createDataFrame([("mail-login.alpha.com",), ("x.alpha.net",), ("q.beta.org",), ("none.zz",)], "domain string")
    found = lambda p: sorted(tuple(map(str, r)) for r in attribution.candidates(names, p).collect())
    assert found(rows) == found(attribution.profiles(orgs, doms))
