import itertools
import random
import timeit
import re

import pytest
from pyspark.sql import functions as F

from citemill import fixed
from citemill.config import Protocol, Term
from citemill.operators import scan
from citemill.operators.classify import summarize
from citemill.operators.mentions import BLOCK, find_mentions
from citemill.operators.relations import best_pairs, build_relations, near_pairs, relation_confidence, sentence_pairs
from citemill.operators.sections import with_sections
from tests import brute


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- scanning -----------------------------------------------------------------------


def test_only_four_characters_fold_to_ascii_letters():
    folded = {chr(c) for c in range(128, 0x30000) if re.fullmatch("[a-z]", chr(c), re.I)}
    assert folded == set(scan.FOLDED)


@pytest.mark.parametrize("pattern, sure", [
    (r"\bthing\b", "thing"), (r"\bpollutants?\b", "pollutant"), (r"\bwell\s+water\b", "water"), (r"\b(a|b)c\b", "c"), (r"x|y", ""),
    (r"ars[eé]nico", "nico"), (r"ab{0,2}c", "a"), (r"\d+ppm*", "pp"), (r"cafés", "caf"), (r"\x41rsenic", "arsenic"), (r"[a\]bcde]xy", "xy"),
    (r"\u0042ar\103", "barc"), (r"(?P<x>lead)ing", "ing"), (r"(?i:Z)inc(?:ated)?", "inc")])
def test_sure_text_is_in_every_match(pattern, sure):
    assert scan._sure_text(pattern)[0] == sure


def test_filter_never_hides_a_match_of_random_patterns():
    rng = random.Random(3)
    pieces = ["a", "B", "7", r"\x41", r"\u0062", r"\101", r"[a\]b]", r"[^\W\d]", r"\b", r"\s", r"\.", "(ab)", "(?:a|b7)", "(?P<n>b)", "a?", "b+", "7{1,2}", "b{0}", "x*?", "é", ".", "[ab]"]
    for _ in range(3000):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        if pattern.count("?P<n>") > 1:
            continue
        if rng.random() < 0.2:
            pattern += "|" + rng.choice(pieces[:6])
        (sure, lead), text = scan._sure_text(pattern), "".join(rng.choice("aAbB7x. é]") for _ in range(40))
        for m in re.finditer(pattern, text, re.I):
            assert sure in m.group().lower(), pattern
            assert lead is None or not sure or text.lower().startswith(sure, m.start() + lead), pattern


def test_automaton_finds_what_single_searches_find():
    """Many random patterns at once: the same spans as each pattern searched on its own, with literals close together and far apart."""
    rng = random.Random(8)
    pieces = ["a", "B", "7", "ab", "x7", r"\b", r"\s", "(?:a|b7)", "a?", "b+", "é", ".", "[ab]", r"(?<=\s)", "(?=b)"]
    for k in range(60):
        patterns = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(40)]
        matcher = scan.Matcher(patterns)
        for _ in range(8):
            text = "".join(rng.choice(("aAbB7x. é]" if k % 2 else "qrstuvw" * 30 + "aAbB7x é") + ("ſ" if k % 7 == 0 else "")) for _ in range(rng.choice([0, 60, 900])))
            want = {i: found for i, p in enumerate(patterns) if (found := [m.span() for m in re.finditer(p, text, re.I)])}
            assert matcher.find(text) == want


def test_cost_does_not_follow_the_dictionary():
    """Characters are visited once: 10,000 terms do not take much longer than 182 on the same text, where neither is found."""
    text = "the quick brown fox jumps over the lazy dog " * 200
    def timed(n):
        matcher = scan.Matcher([rf"\bterm{i:05d}z\b" for i in range(n)])
        return min(timeit.repeat(lambda: matcher.find(text), number=5, repeat=5))
    assert timed(10_000) < 4 * timed(182)


def test_longest_match_wins_and_terms_are_independent(spark, make_articles, protocol):
    text = "Methyl mercury and mercury. methyl  mercury; METHYL MERCURY ſ toxicantſ zinc"
    found = rows(find_mentions(make_articles([("x", text)]), protocol))
    spans = {}
    for m in found:
        spans.setdefault(m["entity_id"], []).append((m["start"], m["end"]))
        assert text[m["start"] : m["end"]] == m["matched_text"]
    for t in protocol.terms:
        assert sorted(spans.get(t.entity_id, [])) == brute.term_spans(t.patterns, text)


def test_mentions_of_random_texts_equal_brute_force(spark, protocol, make_articles):
    rng = random.Random(1)
    words = ["zinc", "Mercury", "methyl mercury", "stroke", "epilepsia", "toxicants", "may", "ñandú", "😀", "exposed", "5 ppm", "linked to",
             "not associated", "patients", "Results", "word.", "\n", "\nMethods\n", "\nReferences\n", "\f", "significantly", "end. The"]
    texts = [(f"t{i}", " ".join(rng.choice(words) for _ in range(rng.randint(60, 1500)))) for i in range(12)]
    assert max(len(t) for _, t in texts) > 2 * BLOCK
    articles = make_articles(texts)
    found = rows(find_mentions(articles, protocol))
    by_id = dict(texts)
    expected = 0
    spans = {i: brute.section_spans(t, protocol.headers) for i, t in texts}
    for i, t in texts:
        expected += sum(len(brute.term_spans(e.patterns, t)) for e in protocol.terms)
    assert len(found) == expected
    for m in found:
        t, s, e = by_id[m["article_id"]], m["start"], m["end"]
        assert m["context"] == brute.squash(t[max(0, s - 260) : e + 260])
        assert m["sentence"] == brute.sentence(t, s, e)
        assert m["left_text"] == t[max(0, s - 160) : s] and m["right_text"] == t[e : e + 160]
        assert m["page"] == (min(1, t[:s].count("\f") + 1) if "\f" in t else 1)
        assert m["section"] == next((n for n, b, z in spans[m["article_id"]] if b <= s < z), "other")
        for c in fixed.MENTION_CUES:
            assert m[f"cue_{c}"] == any(re.search(p, m["context"], re.I) for p in protocol.cues[c])
    for i, _ in texts:
        order = [m for m in sorted(found, key=lambda m: m["mention_idx"]) if m["article_id"] == i]
        assert [m["mention_idx"] for m in order] == list(range(len(order)))
        keys = [(m["start"], m["entity_type"], m["entity_id"]) for m in order]
        assert keys == sorted(keys)
    # relations on the same texts: every pair, brute force
    mentions = find_mentions(articles, protocol)
    best = {(r["article_id"], r["entity_a_id"], r["entity_b_id"]): (r["confidence_score"], r["section"], r["evidence"]) for r in rows(best_pairs(mentions))}
    want = {}
    for i, t in texts:
        own = sorted((m for m in found if m["article_id"] == i), key=lambda m: m["mention_idx"])
        want.update({(i, *k): v for k, v in brute.best_relations(t, own, protocol).items()})
    assert best == want


def test_no_terms_is_an_error(make_articles):
    with pytest.raises(ValueError):
        find_mentions(make_articles([("x", "zinc")]), Protocol(terms=()))


def test_short_articles_are_not_mined(make_articles, protocol):
    assert find_mentions(make_articles([("x", "zinc")], keep_short=False), protocol).count() == 0


# --- sections -----------------------------------------------------------------------------


def random_sections(rng):
    names = ["Methods", "methods", "RESULTS", "Discussion", "References", "references", "Abstract", "Conclusions", "Introduction"]
    lead, tail = ["", "", "  ", "3. ", "so "], ["", "", ".", ": plain text", " of all kinds", ". " + "a tail that goes on " * 4, " " + "and on " * 12]
    lines = [rng.choice(lead) + rng.choice(names) + rng.choice(tail) if rng.random() < 0.5 else rng.choice(["", "Plain line.", "another line of prose"]) for _ in range(rng.randrange(0, 12))]
    return "\n".join(lines)


def test_sections_of_random_texts_equal_brute_force(spark):
    rng = random.Random(11)
    texts = {str(i): random_sections(rng) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "article_id string, text string")
    got = {r["article_id"]: [tuple(x) for x in r["spans"]] for r in with_sections(df, fixed.SECTION_HEADERS).collect()}
    want = {i: brute.section_spans(t, fixed.SECTION_HEADERS) for i, t in texts.items()}
    assert got == want and len({n for spans in want.values() for n, _, _ in spans}) >= 7


def test_two_names_on_one_line_resolve_by_name(spark):
    df = spark.createDataFrame([("x", "Top\n\nSynthesis\nbody")], "article_id string, text string")
    for order in (("alpha", "omega"), ("omega", "alpha")):
        got = with_sections(df, {n: [r"(?im)^\s*synthesis\b"] for n in order}).head()["spans"]
        assert [s["name"] for s in got] == ["title", "omega"]


# --- summaries -----------------------------------------------------------------------------


def fake_mentions(spark, articles):
    """Hand-made mentions of one entity in each article: {article: (kind, [(section, set of cues)])}."""
    out = []
    for article, (kind, items) in articles.items():
        for i, (section, cues) in enumerate(items):
            flags = [c in cues for c in fixed.MENTION_CUES]
            score = fixed.SECTION_WEIGHTS[section] + sum(fixed.CUE_POINTS[c] for c in cues)
            out.append((article, kind, i, i, "a", "zinc", "cinc", "zinc", "Metals", False, section, 1, f"context {i}", *flags, score))
    return spark.createDataFrame(out, (
        "article_id string, article_kind string, mention_idx int, nth int, entity_type string, entity_id string, label_es string, label_en string, "
        "category string, is_generic boolean, section string, page int, context string, cue_exposure boolean, cue_dose boolean, "
        "cue_association boolean, cue_speculative boolean, cue_negation boolean, score int"))


def test_roles_confidence_and_scores_of_random_mentions(spark, protocol):
    rng = random.Random(17)
    articles = {}
    for i in range(600):
        sections = rng.sample(sorted(fixed.SECTION_WEIGHTS), rng.randint(1, 3))
        items = [(rng.choice(sections), {c for c in fixed.MENTION_CUES if rng.random() < 0.15}) for _ in range(rng.randint(1, 6))]
        articles[str(i)] = (rng.choice(["unclear", "unclear", "human_epidemiological", "review_or_synthesis"]), items)
    got = {r["article_id"]: r for r in summarize(fake_mentions(spark, articles), protocol).collect()}
    seen = set()
    for i, (kind, items) in articles.items():
        want = brute.summary(kind, items)
        seen.add(want[:2])
        assert (got[i]["role"], got[i]["confidence"], got[i]["confidence_score"]) == want, items
        assert got[i]["n_mentions"] == len(items) == sum(got[i]["sections"].values())
    assert len({r for r, _ in seen}) == 7 and {c for _, c in seen} == {"Alta", "Media", "Baja"}
    assert {s for s in range(7, 20)} <= {brute.summary(*a)[2] for a in articles.values()}  # each side of every threshold


def test_evidence_quotes_central_then_dose_then_score(spark, protocol):
    items = [("references", {"exposure", "dose"}), ("introduction", set()), ("results", {"dose"}), ("methods", {"exposure"}), ("methods", set())]
    got = summarize(fake_mentions(spark, {"x": ("unclear", items)}), protocol).head()
    assert got["evidence_text"] == "p.1 [results] context 2 || p.1 [methods] context 3 || p.1 [methods] context 4"


KINDS = [
    ("Systematic review of zinc", "review_or_synthesis"), ("Zinc in a cohort of adults", "human_epidemiological"),
    ("Zinc and the brain\nPregnant mice drank it.", "experimental_in_vivo"), ("Cell lines from mice with zinc", "experimental_in_vitro"),
    ("Experimental zinc assessment", "experimental_preclinical"), ("Monitoring of rural supplies", "unclear"),
    ("Registry of zinc suppliers", "human_epidemiological")]


def test_article_kinds(make_articles):
    got = {r["article_id"]: r["article_kind"] for r in make_articles([(str(i), t) for i, (t, _) in enumerate(KINDS)]).collect()}
    assert got == {str(i): k for i, (_, k) in enumerate(KINDS)}


# --- relations -------------------------------------------------------------------------------------


WORDING = {"speculative": "may", "strong_association": "significantly", "association": "be linked to", "negation": "though not linked with"}
SENTENCES = [
    (head, {f for f, on in zip(WORDING, bits, strict=True) if on}, f"{head}Zinc {' '.join(w for w, on in zip(WORDING.values(), bits, strict=True) if on)} epilepsy here.")
    for head in ("", "Heading\n\nDiscussion\n", "Heading\n\nResults\n") for bits in itertools.product((False, True), repeat=4)]


def relate(make_articles, protocol, texts):
    articles = make_articles(texts, using=protocol)
    m = find_mentions(articles, protocol)
    return rows(build_relations(m, summarize(m, protocol), protocol))


def test_association_of_every_wording(make_articles, protocol):
    found = {r["article_id"]: r for r in relate(make_articles, protocol, [(str(i), t) for i, (_, _, t) in enumerate(SENTENCES)])}
    for i, (head, flags, text) in enumerate(SENTENCES):
        assert found[str(i)]["association"] == brute.association(flags, "Discussion" not in head), text
    assert {r["association"] for r in found.values()} >= {"asociacion_fuerte", "asociacion_debil", "mencion_especulativa"}


def test_relation_confidence_on_each_side_of_its_thresholds(spark):
    cases = [(s, place, label) for s in range(3, 16) for place in ("methods", "discussion") for label in ("asociacion_fuerte", "asociacion_debil", "mencion_especulativa")]
    df = spark.createDataFrame(cases, "score int, section string, label string")
    for r in df.withColumn("got", relation_confidence(F.col("score"), F.col("section"), F.col("label"))).collect():
        grade = ("mencion" not in r["label"] and r["score"] >= 6) + ("fuerte" in r["label"] and r["section"] == "methods" and r["score"] >= 12)
        assert r["got"] == ("Baja", "Media", "Alta")[grade]


@pytest.mark.parametrize("distance", [0, 100, 400, 900, 1500])
def test_the_configured_distance_decides(make_articles, protocol, distance):
    p = Protocol(terms=protocol.terms, cues=protocol.cues, relation_distance=distance)
    texts = [(str(n), "Zinc was measured. " + "Filler text here. " * n + "A stroke followed.") for n in range(0, 100, 7)]
    kept = {r["article_id"] for r in relate(make_articles, p, texts)}
    assert kept == {i for i, t in texts if t.index("stroke") + 6 <= distance}


def test_far_apart_boilerplate_sentences_still_pair(make_articles, protocol):
    line = "Zinc was linked to stroke."
    far = "X " + "filler words. " * 200
    got = relate(make_articles, protocol, [("x", f"{line} {far} {line}")])
    assert [r["evidence_text"] for r in got] == [line]


def test_swapping_slots_changes_nothing_but_the_sides(make_articles, protocol):
    flipped = Protocol(terms=tuple(Term("b" if t.slot == "a" else "a", *list(t.__dict__.values())[1:]) for t in protocol.terms), cues=protocol.cues)
    texts = [(str(i), t + " A stroke was seen. Mercury rose.") for i, (_, _, t) in enumerate(SENTENCES)]
    def keyed(found, a, b):
        return {(r["article_id"], r[a], r[b]): (r["association"], r["confidence"], r["confidence_score"], r["section"]) for r in found}

    one = keyed(relate(make_articles, protocol, texts), "entity_a_id", "entity_b_id")
    two = keyed(relate(make_articles, flipped, texts), "entity_b_id", "entity_a_id")
    assert len(one) >= 7 and one == two


def test_one_article_with_most_mentions(spark, make_articles, protocol):
    """A dense hot article next to small ones; the result does not depend on partitioning."""
    hot = "Zinc was linked to stroke. " * 400 + "Mercury rose after epilepsy may come. " * 300
    articles = make_articles([("hot", hot), *[(f"s{i}", "Zinc and stroke.") for i in range(20)]])
    m = find_mentions(articles, protocol)
    base = sorted(map(str, rows(best_pairs(m))))
    again = sorted(map(str, rows(best_pairs(find_mentions(articles.repartition(7), protocol)))))
    assert base == again
    own = sorted((r for r in rows(m) if r["article_id"] == "hot"), key=lambda r: r["mention_idx"])
    got = {(r["entity_a_id"], r["entity_b_id"]): (r["confidence_score"], r["section"], r["evidence"]) for r in rows(best_pairs(m)) if r["article_id"] == "hot"}
    assert got == brute.best_relations(hot, own[:0] + own, protocol)


def test_the_text_scan_runs_once_per_plan(make_articles, protocol):
    plan = find_mentions(make_articles([("x", "zinc")]), protocol)._jdf.queryExecution().executedPlan().toString()
    assert sum("(text#" in line for line in plan.splitlines() if "ArrowEvalPython" in line) == 1


def test_no_text_is_shuffled_before_the_best_pair(make_articles, protocol):
    """Exchanges of a relation plan carry no sentence and no text ahead of a mention; quotations come from text blocks, once each."""
    m = find_mentions(make_articles([("x", "Zinc and stroke.")]), protocol)
    plan = best_pairs(m)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "ahead" not in plan
    pairs = sentence_pairs(m).unionByName(near_pairs(m))
    assert not {n for n, kind in pairs.dtypes if kind == "string"} - {"article_id", "entity_a_id", "entity_b_id", "section", "article_kind"}


def test_no_text_travels_to_every_match(make_articles, protocol):
    """Fragments are cut before matches are exploded; neither the text nor its blocks stand beside the generator."""
    plan = find_mentions(make_articles([("x", "zinc")]), protocol)._jdf.queryExecution().executedPlan().toString()
    (beside,) = [re.search(r", \[([^\[\]]*)\], true, \[", line).group(1) for line in plan.splitlines() if "Generate posexplode" in line]
    assert "article_id#" in beside and not re.search(r"\b(text|blocks)#", beside)
