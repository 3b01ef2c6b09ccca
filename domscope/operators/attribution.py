"""Attribution of domains to organizations: profiles, explained scores, alert documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import any_list
from ..functions import labels
from ..functions.labels import confidence, evidence_lines, profile_version, risk_level
from ..functions.names import labels as labels_of
from ..functions.names import char_grams, domain_keywords, domain_tlds, domain_tokens, normal_domain, pattern_score, sld, text_tokens, tld
from ..plans.relational import first_by_key, in_order, numbered, top_by_key
from ..session import stored
from ..sources.stitched import write_stitched
from . import similar_sets

# The weights of what speaks for a match, and what is kept of the candidates.
WEIGHTS = {"ioc": 0.45, "keyword": 0.2, "tld": 0.1, "pattern": 0.15, "label": 0.1}
KEPT = 5
METHOD = "rule_v1"


def _as_list(df: DataFrame, c: str) -> Column:
    if c not in df.columns:
        return F.array().cast("array<string>")
    return F.coalesce(F.col(c), F.array().cast("array<string>")) if dict(df.dtypes)[c].startswith("array") else any_list(F.col(c))


def profiles(organizations: DataFrame, domains: DataFrame) -> DataFrame:
    """organization_id, name, alias, previous_domains, keywords, common_tlds, version of active organizations with
    an id and a name. Keywords and TLDs are taken from the domains where the organization has none of its own;
    optional columns may be missing."""
    o = organizations.where(F.col("id").isNotNull() & (F.trim("name") != ""))
    if "is_active" in o.columns:
        o = o.where(F.coalesce(F.col("is_active").cast("int"), F.lit(0)) == 1)
    seen = domains.where(F.col("organization_id").isNotNull() & (F.trim("domain_name") != "")).groupBy("organization_id").agg(F.collect_set(F.lower(F.trim("domain_name"))).alias("__seen"))
    j = o.join(seen, o["id"] == seen["organization_id"], "left").drop("organization_id")
    known = F.array_sort(F.array_distinct(F.concat(F.transform(_as_list(o, "previous_domains"), lambda x: F.lower(F.trim(x))), F.coalesce("__seen", F.array().cast("array<string>")))))
    j = j.withColumn("__known", F.filter(known, lambda x: x != ""))
    given = lambda c, derived: F.when(F.size(_as_list(o, c)) > 0, _as_list(o, c)).otherwise(derived)
    null = F.lit(None).cast("string")
    col = lambda c, kind: F.col(c) if c in o.columns else null.cast(kind)
    return j.select(
        F.col("id").alias("organization_id"),
        F.trim("name").alias("name"),
        _as_list(o, "alias").alias("alias"),
        F.col("__known").alias("previous_domains"),
        given("keywords", domain_keywords(F.col("__known"))).alias("keywords"),
        given("common_tlds", domain_tlds(F.col("__known"))).alias("common_tlds"),
        profile_version(col("profile_version", "string"), col("updated_at", "timestamp"), col("update_time", "date")).alias("version"),
    )


@dataclass(frozen=True)
class ProfileRows:
    """Profiles as tables, so that none has to fit in a row: ``organizations`` (organization_id, name, words - those of name and aliases -, version),
    ``iocs`` (organization_id, place, ioc: the known domains in order), ``keywords`` (organization_id, word), ``tlds`` (organization_id, tld)."""

    organizations: DataFrame
    iocs: DataFrame
    keywords: DataFrame
    tlds: DataFrame


def profile_rows(organizations: DataFrame, domains: DataFrame) -> ProfileRows:
    """What profiles() gives, as tables. Each domain adds its own words and ending, duplicates go by aggregation, and places are counted by ranges, so an
    organization may have any number of domains."""
    o = organizations.where(F.col("id").isNotNull() & (F.trim("name") != ""))
    if "is_active" in o.columns:
        o = o.where(F.coalesce(F.col("is_active").cast("int"), F.lit(0)) == 1)
    clean = lambda c: F.transform(_as_list(o, c), lambda x: F.lower(F.trim(x)))
    of = F.col("id").alias("organization_id")
    own = o.select(of, F.explode(clean("previous_domains")).alias("ioc"))
    seen = domains.where(F.col("organization_id").isNotNull()).select("organization_id", F.lower(F.trim("domain_name")).alias("ioc")).join(o.select(of), "organization_id", "left_semi")
    known = stored(own.unionByName(seen).where("ioc <> ''").distinct(), "known-domains")
    iocs = in_order(known, ["ioc"], "place", ["organization_id"])

    def given(c: str, name: str, derive: Callable[[Column], Column], form: Callable[[Column], Column]) -> DataFrame:
        """The organization's own list, or what its domains give where that is empty."""
        listed = o.select(of, F.explode(_as_list(o, c)).alias(name))
        none = o.where(F.size(_as_list(o, c)) == 0).select(of)
        derived = known.join(none, "organization_id", "left_semi").select("organization_id", F.explode(derive(F.array("ioc"))).alias(name))
        both = listed.unionByName(derived).select("organization_id", form(F.lower(F.trim(name))).alias(name))
        return both.where(F.col(name) != "").distinct()

    words = F.array_distinct(F.concat(text_tokens(F.col("name")), F.flatten(F.transform(_as_list(o, "alias"), text_tokens))))
    null = F.lit(None).cast("string")
    col = lambda c, kind: F.col(c) if c in o.columns else null.cast(kind)
    version = profile_version(col("profile_version", "string"), col("updated_at", "timestamp"), col("update_time", "date"))
    keywords = given("keywords", "word", domain_keywords, lambda x: x)
    tlds = given("common_tlds", "tld", domain_tlds, lambda x: F.ltrim(x, F.lit(".")))
    return ProfileRows(o.select(of, F.trim("name").alias("name"), words.alias("words"), version.alias("version")), iocs, keywords, tlds)


def _as_rows(profs: DataFrame | ProfileRows) -> ProfileRows:
    if isinstance(profs, ProfileRows):
        return profs
    lower = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    words = F.array_distinct(F.concat(text_tokens(F.col("name")), F.flatten(F.transform("alias", text_tokens))))
    return ProfileRows(
        profs.select("organization_id", "name", words.alias("words"), "version"),
        profs.select("organization_id", F.posexplode("previous_domains").alias("place", "ioc")),
        profs.select("organization_id", F.explode(lower(F.col("keywords"))).alias("word")),
        profs.select("organization_id", F.explode(F.transform(lower(F.col("common_tlds")), lambda x: F.ltrim(x, F.lit(".")))).alias("tld")).distinct(),
    )


def ioc_similarity(names: DataFrame, iocs: DataFrame) -> DataFrame:
    """domain, organization_id, ioc, ioc_score: for each pair that shares a trigram the most similar of the
    organization's known domains by Jaccard; of equals the first. ``names``: domain, grams; ``iocs``:
    organization_id, place, ioc. Exact, see similar_sets; candidates() needs only some of these pairs."""
    found = similar_sets.most_similar_of_each(names.select(F.col("domain").alias("own"), "grams"), _known_sets(iocs), "organization_id")
    return found.select(F.col("own").alias("domain"), "organization_id", F.col("name").alias("ioc"), F.col("score").alias("ioc_score"))


def _known_sets(iocs: DataFrame) -> DataFrame:
    return iocs.select("organization_id", "place", F.col("ioc").alias("name"), char_grams(F.col("ioc")).alias("grams"))


def last_labels(names: DataFrame) -> DataFrame:
    """``names`` (domain) with sld and tld: the label before the last, and the last."""
    return names.withColumns({"sld": sld(F.col("domain")), "tld": tld(F.col("domain"))})


def public_suffixes(rules: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A splitter like last_labels() by a table of suffixes (rule): ``com``, ``co.uk``, ``*.ck`` for any label there, or
    ``!www.ck`` for a name that such a rule isn't meant for. The rule of most labels counts; without one the ending is
    empty and sld the last label; an IPv4 address is its own sld. Endings meet rules in an equi-join."""
    known = rules.select(F.lower(F.trim("rule")).alias("rule")).where("rule <> ''").distinct()

    def split(names: DataFrame) -> DataFrame:
        x = names.where(~F.col("domain").rlike(r"^\d+(\.\d+){3}$")).select("domain", labels_of(F.col("domain")).alias("l")).where(F.size("l") > 0).distinct()
        ends = x.select("domain", "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("n")).withColumn("end", F.array_join(F.slice("l", -F.col("n"), F.col("n")), "."))
        forms = F.array(F.col("end"), F.concat(F.lit("!"), "end"), F.concat(F.lit("*"), F.substr("end", F.char_length(F.element_at("l", -F.col("n"))) + 1)))
        hits = ends.select("domain", "n", F.explode(forms).alias("rule")).join(known, "rule")
        # An exception is stronger than all others, and its own first label isn't part of the ending.
        kept = hits.groupBy("domain").agg(F.max(F.when(F.startswith("rule", F.lit("!")), F.col("n") - 1)).alias("e"), F.max("n").alias("m"))
        j = names.join(kept, "domain", "left").withColumns({"__l": labels_of(F.col("domain")), "__n": F.coalesce("e", "m", F.lit(0))}).drop("e", "m")
        size = F.size("__l") - F.col("__n")
        own = F.when(F.col("domain").rlike(r"^\d+(\.\d+){3}$"), F.col("domain")).otherwise(F.coalesce(F.get("__l", size - 1), F.lit("")))
        return j.withColumns({"sld": own, "tld": F.array_join(F.slice("__l", size + 1, F.col("__n")), ".")}).drop("__l", "__n")

    return split


def candidates(domains: DataFrame, profs: DataFrame | ProfileRows, kept: int = KEPT, split: Callable[[DataFrame], DataFrame] = last_labels, most: int = similar_sets.MOST) -> DataFrame:
    """The best ``kept`` profiles of each domain with their scores and evidence, rank 1 first; equals by id.

    Scores come from equi-joins on rare trigrams, keywords, endings and labels. A profile that shares none of these
    with a domain scores the same as all such profiles, so of them only the first few can be among the best;
    likewise of those that share the ending alone. What common trigrams (``com`` and the like) make alike is the same for all
    domains of a class: of it, too, the first few profiles are enough, with the domain's ending and whatever theirs is, and for
    a pair that something else speaks for the class is looked up. No domain meets all profiles. ``split`` gives sld and tld; a trigram that more than ``most`` known domains have is common.
    """
    d = domains.select(normal_domain(F.col("domain")).alias("domain")).where("domain <> ''").distinct()
    d = split(d).select("domain", "sld", "tld", domain_tokens(F.col("domain")).alias("tokens"), char_grams(F.col("domain")).alias("grams"))
    d = d.withColumn("pattern_score", pattern_score(F.col("tokens")))
    p = _as_rows(profs)
    iocs = p.iocs.withColumn("ioc", normal_domain(F.col("ioc"))).where("ioc <> ''")
    known = stored(similar_sets.ordered(_known_sets(iocs), _known_sets(iocs), most), "known-sets")
    own = stored(similar_sets.ordered(d.select(F.col("domain").alias("own"), "tld", "grams"), known, most), "own-sets")
    best = lambda rows: rows.select(F.col("own").alias("domain"), "organization_id", F.col("name").alias("ioc"), F.col("place").cast("long").alias("place"), F.col("score").alias("ioc_score"))
    by_rare = best(similar_sets.rare_pairs(own, known, ["organization_id"]))
    classes = stored(similar_sets.class_best(own, known, ["organization_id"]), "classes")
    by_word = d.select("domain", F.explode(F.array_distinct("tokens")).alias("word")).join(p.keywords, "word")
    by_label = d.where("sld <> ''").join(p.organizations.select("organization_id", F.explode("words").alias("sld")), "sld").select("domain", "organization_id")
    tlds = p.tlds
    by_tld = d.where("tld <> ''").select("domain", "tld").join(top_by_key(tlds, ["tld"], [F.col("organization_id")], kept), "tld").select("domain", "organization_id")
    first = p.organizations.select("organization_id").orderBy("organization_id").limit(kept).agg(F.collect_list("organization_id").alias("ids"))
    by_default = d.select("domain").join(F.broadcast(first)).select("domain", F.explode("ids").alias("organization_id"))
    # Of a class the first profiles of any ending, and those of each ending that its domains have.
    alike = [F.desc("score"), F.col("organization_id")]
    mine = own.select("own", "tld", F.size("grams").alias("nx"), "common")
    of_any = mine.join(top_by_key(classes, ["nx", "common"], alike, kept), ["nx", "common"])
    ended = mine.select("nx", "common", "tld").distinct().join(classes.join(tlds.withColumnRenamed("tld", "end"), "organization_id"), ["nx", "common"]).where("tld = end")
    of_end = mine.join(top_by_key(ended, ["nx", "common", "tld"], alike, kept), ["nx", "common", "tld"])
    # What speaks for a pair meets in one aggregation, however many kinds of evidence there are.
    kinds = {"ioc": "string", "ioc_score": "double", "place": "long", "word": "string"}
    widen = lambda df: df.select("domain", "organization_id", *[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
    rows = [widen(df) for df in (by_rare, best(of_any), best(of_end), by_word, by_label, by_tld, by_default)]
    met = stored(reduce(DataFrame.union, rows).groupBy("domain", "organization_id").agg(F.min(F.when(F.col("ioc_score").isNotNull(), F.struct((-F.col("ioc_score")).alias("s"), "place", "ioc"))).alias("best"), F.array_sort(F.collect_list("word")).alias("keyword_overlap")), "evidence")
    looked = met.join(mine.withColumnRenamed("own", "domain"), "domain").join(classes, ["nx", "common", "organization_id"], "left")
    common = F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("place").cast("long").alias("place"), F.col("name").alias("ioc")))
    pairs = looked.withColumn("best", F.least("best", common)).select("domain", "organization_id", F.col("best.ioc").alias("ioc"), (-F.col("best.s")).alias("ioc_score"), "keyword_overlap")
    full = pairs.join(d.select("domain", "tld", "sld", "pattern_score"), "domain").join(p.organizations.select("organization_id", "name", "words"), "organization_id")
    full = full.join(p.keywords.groupBy("organization_id").agg(F.count(F.lit(1)).alias("nk")), "organization_id", "left").join(tlds.withColumn("ends", F.lit(True)), ["organization_id", "tld"], "left")
    zero = F.lit(0.0)
    full = full.withColumns(
        {
            "ioc_score": F.coalesce("ioc_score", zero),
            "keyword_score": F.when(F.size("keyword_overlap") > 0, F.size("keyword_overlap") / F.col("nk")).otherwise(zero),
            "tld_hit": (F.col("tld") != "") & F.coalesce("ends", F.lit(False)),
            "label_hit": (F.col("sld") != "") & F.array_contains("words", F.col("sld")),
        }
    )
    score = WEIGHTS["ioc"] * F.col("ioc_score") + WEIGHTS["keyword"] * F.col("keyword_score") + WEIGHTS["tld"] * F.col("tld_hit").cast("int") + WEIGHTS["pattern"] * F.col("pattern_score") + WEIGHTS["label"] * F.col("label_hit").cast("int")
    scored = full.withColumn("score", F.greatest(zero, F.least(F.lit(1.0), score))).withColumn("confidence", confidence(F.col("score")))
    # Equal up to rounding is equal: sums of the same terms may differ in the last bit.
    best = top_by_key(scored, ["domain"], [F.desc(F.round("score", 12)), F.col("organization_id")], kept)
    return best.select("domain", "rank", "organization_id", "name", "score", "confidence", "ioc_score", F.col("ioc").alias("best_ioc"), "keyword_overlap", "keyword_score", "tld_hit", "pattern_score", "label_hit")


def best_matches(found: DataFrame) -> DataFrame:
    """One row for each domain: its best candidate, if that scores above 0, the reason, and all candidates."""
    evidence = F.struct("best_ioc", "keyword_overlap", "tld_hit", "label_hit", "ioc_score", "keyword_score", "pattern_score")
    one = F.struct("rank", "organization_id", "name", "score", "confidence", evidence.alias("evidence"))
    rows = found.groupBy("domain").agg(F.array_sort(F.collect_list(one)).alias("top_candidates"))
    best = F.col("top_candidates")[0]
    hit = best["score"] > 0
    name = F.when(F.trim(best["name"]) != "", F.trim(best["name"])).otherwise(labels.UNNAMED_ORGANIZATION)
    reason = F.when(
        hit,
        F.format_string(labels.REASON_MATCH, name, name),
    ).otherwise(labels.REASON_NONE)
    return rows.select(
        "domain", F.when(hit, best["organization_id"]).alias("organization_id"), F.when(hit, best["name"]).alias("organization_name"), best["score"].alias("actor_score"),
        best["confidence"].alias("confidence"), reason.alias("reason"), F.when(hit, best["evidence"]).alias("evidence"), "top_candidates", F.lit(METHOD).alias("method"),
    )


def with_snapshot(matches: DataFrame, profs: DataFrame | ProfileRows, split: Callable[[DataFrame], DataFrame] = last_labels) -> DataFrame:
    """``matches`` with enrichment_snapshot, JSON: what the score saw of the domain, and how many profiles were scored."""
    n = _as_rows(profs).organizations.agg(F.count(F.lit(1)).alias("candidate_count"))
    seen = F.struct("domain", "sld", "tld", domain_tokens(F.col("domain")).alias("tokens"))
    snapshot = F.to_json(F.struct(seen.alias("domain_features"), "candidate_count"))
    return split(matches).join(F.broadcast(n)).select(*matches.columns, snapshot.alias("enrichment_snapshot"))


def alert_items(high_risk: DataFrame, matches: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row for each domain of the alert, whatever its case, in order of position: the classifier's score, else
    the organization's, its level, organizations and evidence. ``scores``: domain, score, position; the last wins."""
    rows = high_risk.withColumn("key", F.lower(F.trim("domain"))).where("key <> ''")
    one = first_by_key(rows, ["key"], [F.col("position")]).select("key", F.trim("domain").alias("domain"), "position")
    m = matches.withColumn("key", F.lower("domain")).drop("domain")
    j = one.join(m, "key", "left")
    if scores is not None:
        s = scores.groupBy(F.lower(F.trim("domain")).alias("key")).agg(F.max_by("score", "position").alias("own_score"))
        j = j.join(s, "key", "left")
    else:
        j = j.withColumn("own_score", F.lit(None).cast("double"))
    risk = F.coalesce("own_score", "actor_score")
    organizations = F.transform(F.filter("top_candidates", lambda c: c["score"] > 0), lambda c: F.struct(c["organization_id"].alias("organization_id"), c["name"].alias("name"), c["score"].alias("score"), c["confidence"].alias("confidence")))
    lines = evidence_lines(F.col("evidence.best_ioc"), F.col("evidence.tld_hit"), F.col("evidence.keyword_overlap"), F.col("reason"))
    return j.select("position", "domain", risk.alias("risk_score"), risk_level(risk).alias("risk_level"), F.col("actor_score").alias("organization_score"), organizations.alias("matched_organizations"), lines.alias("evidence_lines"), "evidence", "top_candidates")


def _item() -> list[Column]:
    """What a document says of a domain."""
    return [F.col("domain"), F.col("risk_score"), F.col("risk_level"), F.struct("organization_score").alias("scores"), F.col("matched_organizations"), F.col("top_candidates"), F.struct("evidence", "evidence_lines").alias("evidence_summary")]


def _document(alert: DataFrame, count: Column, listed: Column) -> Column:
    given = lambda c: F.coalesce(F.col(c), count) if c in alert.columns else count
    return F.struct(
        F.lit("v1").alias("schema_version"),
        F.struct(*[F.col(c) for c in alert.columns]).alias("alert"),
        F.struct(given("detected_count").alias("detected_count"), given("high_risk_count").alias("high_risk_count")).alias("summary"),
        listed.alias("high_risk_domains"),
        F.struct(F.lit("subscription_alert").alias("source")).alias("meta"),
    )


def alert_document(alert: DataFrame, items: DataFrame) -> DataFrame:
    """``alert`` - one row - with the document: version, the alert, counts, its domains in order, as JSON in lines that people can
    read. All in one row; write_alert() has no such bound."""
    listed = items.agg(F.array_sort(F.collect_list(F.struct("position", *_item()))).alias("__items"))
    j = alert.crossJoin(listed)  # two frames of one row
    document = _document(alert, F.size("__items"), F.transform("__items", lambda x: x.dropFields("position")))
    return j.select(*alert.columns, F.to_json(document, {"pretty": "true"}).alias("document"))


def write_alert(alert: DataFrame, items: DataFrame, path: str) -> None:
    """The file of alert_document(), byte by byte, for an alert of any number of domains: each is written as it stands in the
    document, numbered by ranges, and only the alert itself passes through the driver."""
    one = F.to_json(F.struct(F.array(F.struct(*_item())).alias("high_risk_domains")), {"pretty": "true"})
    inner = F.regexp_extract(one, r"(?s)^\{\s+\"high_risk_domains\" : \[ \{\n(.*)\n  \} \]\s+\}$", 1)
    placed = in_order(items.select("position", "domain", inner.alias("line")), ["position", "domain"], "at")
    n = placed.count()
    frame = alert.select(F.to_json(_document(alert, F.lit(n), F.array().cast("array<int>")), {"pretty": "true"}).alias("d")).first().d
    head, _, tail = frame.partition('"high_risk_domains" : [ ],\n')
    between = F.when(F.col("at") < n, "\n  }, {").otherwise("\n  } ],")
    opening = '"high_risk_domains" : [ {\n' if n else '"high_risk_domains" : [ ],\n'
    write_stitched(placed.select("at", F.concat("line", between).alias("line")), ["at"], path, head + opening, tail + "\n")


def version_of(matched: DataFrame, profs: DataFrame) -> DataFrame:
    """One row: the version that all matched profiles have, ``mixed`` if they differ, the first one without any."""
    v = matched.join(profs.select("organization_id", "version"), "organization_id", "left_outer").agg(F.collect_set("version").alias("v"))
    return v.select(F.when(F.size("v") == 0, labels.FIRST_PROFILE_VERSION).when(F.size("v") == 1, F.element_at("v", 1)).otherwise("mixed").alias("version"))


def by_organization(matches: DataFrame, unknown: str = "未知") -> DataFrame:
    """organization, n, domains (sorted, whatever the case), known: groups of a notice in order of name, the
    unknown one last."""
    name = F.when(F.trim("organization_name") != "", F.trim("organization_name")).otherwise(unknown)
    rows = first_by_key(matches.withColumns({"organization": name, "__key": F.lower("domain")}), ["__key"], [F.col("domain")])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("domain").alias("l"), "domain"))), lambda x: x["domain"])
    groups = rows.groupBy("organization").agg(F.count(F.lit(1)).alias("n"), listed.alias("domains")).withColumn("known", F.col("organization") != unknown)
    return groups.orderBy(~F.col("known"), F.lower("organization"))


def notice_text(groups: DataFrame) -> DataFrame:
    """One row: the groups of by_organization() as one text with its totals."""
    numbered = F.array_join(F.transform("domains", lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d)), "\n")
    section = F.concat(F.format_string(labels.NOTICE_GROUP + "\n", "organization", "n"), numbered)
    g = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("known"), F.array_sort(F.collect_list(F.struct((~F.col("known")).alias("u"), F.lower("organization").alias("l"), section.alias("s")))).alias("s"))
    head = F.format_string(labels.NOTICE_TOTALS, "total", "known")
    return g.select("total", "known", F.when(F.col("total") == 0, labels.NOTICE_NONE).otherwise(F.concat(head, F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["s"]), "\n\n"))).alias("text"))


def notice_lines(matches: DataFrame, unknown: str = "未知") -> DataFrame:
    """u, l, organization, at, line: the lines of notice_text() below its totals, in this order. Domains are numbered by ranges within their group, so a
    group may have any number of them; the first line of a group has its heading before it."""
    name = F.when(F.trim("organization_name") != "", F.trim("organization_name")).otherwise(unknown)
    rows = first_by_key(matches.withColumns({"organization": name, "__key": F.lower("domain")}), ["__key"], [F.col("domain")])
    keyed = rows.select((F.col("organization") == unknown).alias("u"), F.lower("organization").alias("l"), "organization", "__key", "domain")
    placed = in_order(keyed, ["__key", "domain"], "at", ["u", "l", "organization"])
    sizes = placed.groupBy("organization").agg(F.count(F.lit(1)).alias("n"))
    heading = F.format_string(f"\n{labels.NOTICE_GROUP}\n", "organization", "n")
    line = F.concat(F.when(F.col("at") == 1, heading).otherwise(""), F.col("at").cast("string"), F.lit(". "), F.col("domain"))
    return placed.join(sizes, "organization").select("u", "l", "organization", "at", line.alias("line"))


def write_notice(matches: DataFrame, path: str, unknown: str = "未知") -> None:
    """The text of notice_text() as a file, with a line end."""
    lines = notice_lines(matches, unknown)
    total, known = lines.agg(F.count(F.lit(1)), F.count(F.when(~F.col("u"), 1))).first()
    head = f"{labels.NOTICE_TOTALS}\n" % (total, known) if total else f"{labels.NOTICE_NONE}\n"
    write_stitched(lines, ["u", "l", "organization", "at"], path, head)


def create_domains(domains: DataFrame, names: DataFrame, when: Column) -> DataFrame:
    """``domains`` with a row for each name (domain) that none of them has, whatever its case, with the ids after the
    largest; of spellings that differ in case alone the first. persist_matches() finds the ids there."""
    key = F.lower(F.trim("domain"))
    new = names.groupBy(key.alias("__key")).agg(F.min(F.trim("domain")).alias("domain_name")).where("__key <> ''")
    new = new.join(domains.select(F.lower(F.trim("domain_name")).alias("__key")), "__key", "left_anti").select("domain_name")
    last = domains.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    rows = numbered(new, "domain_name", "__n").join(F.broadcast(last))
    kinds = dict(domains.dtypes)
    rows = rows.select((F.col("__last") + F.col("__n")).cast(kinds["id"]).alias("id"), "domain_name", *([when.cast(kinds["created_at"]).alias("created_at")] if "created_at" in kinds else []))
    return domains.unionByName(rows, allowMissingColumns=True)


def persist_matches(stored: DataFrame, matches: DataFrame, domains: DataFrame, alert_id: str, when: Column) -> DataFrame:
    """``stored`` matches with those of an alert added, as pending, at 4 decimals; a pair of alert and domain
    that is there already is left as it is."""
    j = matches.join(domains.select(F.col("id").cast("long").alias("domain_id"), F.lower("domain_name").alias("__name")), F.lower("domain") == F.col("__name"), "left")
    new = j.select(
        F.lit(None).cast("long").alias("id"), F.lit(alert_id).alias("alert_id"), "domain_id", F.col("domain").alias("domain_name"), F.col("organization_id").cast("int").alias("organization_id"), "organization_name",
        F.round("actor_score", 4).cast("decimal(6,4)").alias("actor_score"), "confidence", F.to_json("evidence").alias("evidence"), F.to_json("top_candidates").alias("top_candidates"), F.lit("pending").alias("status"), when.cast("timestamp_ntz").alias("created_at"),
    )
    fresh = new.join(stored.select("alert_id", "domain_name"), ["alert_id", "domain_name"], "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))
