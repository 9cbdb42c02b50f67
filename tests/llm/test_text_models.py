"""Secret scan, decontamination, toxicity and page text."""

import hashlib
import random
import re

import numpy as np
import pytest

from citemill.llm import decontamination, html_text, secret_scan, toxicity

DOCS = "doc_id bigint, text string, score string, spans string"


def test_base_spans():
    spans = lambda t: [(secret_scan.KINDS[k], a, b) for a, k, b in secret_scan.base_spans(t)]
    assert spans("") == []
    assert spans("Password = hunter22 x") == [("assign", 0, 19)]
    assert spans("password: abc") == [] and spans("é API_KEY=\"abcdef\"") == [("assign", 2, 17)]
    assert spans("AKIA" + "A1" * 8) == [("access", 0, 20)] and spans("AKIA" + "A" * 15) == []
    assert spans("f" * 24) == [("hex", 0, 24)] and spans("f" * 23) == []
    assert spans("token=" + "a" * 24) == [("assign", 0, 30), ("hex", 6, 30)]
    assert spans("pa\u017f\u017fword=abcdef") == []  # letters beyond ASCII are no case variants


def some_field(seed):
    r = np.random.RandomState(seed)
    names = {f for w in WORDS for f in secret_scan.word_features(w)}
    names |= {n for w in WORDS for s in "<>" for n in secret_scan.neighbour_features(secret_scan.word_features(w), s)}
    return secret_scan.Field({n: r.normal(0, 1, 3) for n in sorted(names)}, r.normal(0, 1, (4, 3)))


WORDS = ["the", "token", "=", "\"x9F3kq\"", "Word", "abc,", "12", "key:", "3f3f3f3f3f3f3f3f3f3f"]


@pytest.mark.parametrize("seed", range(12))
def test_pruned_viterbi_equals_all_paths(seed):
    """Best score over all tag sequences, by trying them all."""
    import itertools

    field, r = some_field(seed), random.Random(seed)
    tagger = secret_scan.Tagger(field)
    for _ in range(5):
        words = [r.choice(WORDS) for _ in range(r.randrange(1, 7))]
        text = " ".join(words)
        e, m = tagger.scores(words, text), field.moves
        value = lambda tags: m[3][tags[0]] + sum(e[i][y] for i, y in enumerate(tags)) + sum(m[a][b] for a, b in zip(tags, tags[1:], strict=False))  # noqa: B023, E731
        best = max(value(t) for t in itertools.product(range(3), repeat=len(words)))
        tags = tagger.tags(words, text)
        assert value([tags.get(i, 0) for i in range(len(words))]) == pytest.approx(best)


def test_field_learns_and_keeps_base_spans(spark):
    r = random.Random(1)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    filler = lambda: " ".join(r.choice(["of", "the", "word", "Then,", "it."]) for _ in range(30))
    rows = [(i, f"{filler()} {'key' if i % 2 else 'secret'} = {hexes(30)} {filler()}" if i % 3 else filler()) for i in range(90)]
    rows += [(200, f"{filler()} secret of {hexes(20)}A and more"), (201, None), (202, ""), (None, f"token={hexes(12)}"), (5, rows[5][1])]
    df = spark.createDataFrame([(*x, "e", "e") for x in rows], DOCS)
    found = secret_scan.find_secrets(df).collect()
    assert len(found) == len(rows)
    texts = {(d, t or "") for d, t in rows}
    for f in found:
        base = [(s["start"], secret_scan.KINDS.index(s["kind"]), s["end"]) for s in f["spans"] if s["kind"] != "crf"]
        assert any(d == f["doc_id"] and secret_scan.base_spans(t) == base for d, t in texts)
        for s in f["spans"]:
            if s["kind"] == "crf":
                assert not any(a < s["end"] and s["start"] < b for a, _, b in base)
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def test_fitted_tags_reproduce_labels():
    r = random.Random(2)
    windows = []
    for i in range(200):
        words = [r.choice(["of", "the", "word", "Then,", "it."]) for _ in range(20)]
        tags = [0] * 20
        if i % 2:
            words[7:10], tags[7:10] = ["token", "=", "\"" + hashlib.md5(str(i).encode()).hexdigest() + "\""], [1, 2, 2]
        own = [secret_scan.word_features(w) for w in words]
        side = lambda k, s: secret_scan.neighbour_features(own[k], s) if 0 <= k < 20 else ()  # noqa: B023, E731
        windows.append(([[*own[k], *side(k - 1, "<"), *side(k + 1, ">")] for k in range(20)], tags))
    tagger = secret_scan.Tagger(secret_scan.fit(windows[:150]))
    words = ["of"] * 9 + ["token", "=", "\"" + "0f" * 16 + "\""] + ["it."] * 9
    assert tagger.tags(words, " ".join(words)) == {9: 1, 10: 2, 11: 2}
    assert secret_scan.fit([]).weights == {}


def base_by_hand(text):
    """Base spans by walking over the characters, without regular expressions."""
    low, found = text.translate({c: c + 32 for c in range(65, 91)}), []
    hexes, upper, value = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

    def run(at, of):
        end = at
        while end < len(text) and text[end] in of:
            end += 1
        return end

    def assign(at):
        for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(key, at):
                i = at + len(key)
                i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
                i = run(i, " ")
                if text[i : i + 1] not in (":", "="):
                    return None
                i = run(i + 1, " ")
                starts = [i + 1, i] if text[i : i + 1] in ("'", '"') else [i]
                end = next((e for b in starts if (e := run(b, value)) > b), None)
                return None if end is None else (end, end - next(b for b in starts if run(b, value) > b))
        return None

    at = 0
    while at < len(text):
        hit = assign(at)
        if hit and hit[1] >= 6:
            found.append((at, 0, hit[0]))
        at = hit[0] if hit else at + 1
    at = 0
    while at < len(text):
        end = run(at + 4, upper) if text.startswith("AKIA", at) else at
        if end > at + 4 and end - at >= 20:
            found.append((at, 1, end))
        at = end if end > at + 4 else at + 1
    at = 0
    while at < len(text):
        end = run(at, hexes)
        if end - at >= 24:
            found.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(found)


def test_base_spans_equal_a_walk_over_the_characters():
    r = random.Random(12)
    pieces = ["password", "PASSWD", "Secret", "token", "api_key", "apiKey", "=", ":", " ", "\"", "'", "AKIA", "ABCDEFGH12345678", "ab12", "0123456789abcdef0", "é", "x.y-z", "\n", "K", "_", "tokentoken=abcdefg"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(9)))
        assert secret_scan.base_spans(text) == base_by_hand(text), text


HELD_OUT = ["passphrase {mixed}", "AWS_PASSWORD {base36}", "glpat-{base20}", "AccountKey {base44}==", "SECRET_KEY <- {value}", "token {base48} expires", "Authorization: Basic {base28}=", "root password now {mixed}"]
HARMLESS = ["192.168.{two}.{two}", "2024-01-05T10:00:00Z", "v{two}.{two}.{two}-rc{two}", "https://cdn.{w}.net/{w}.js?v={digits}", "{Camel}{Camel}{Camel}", "{w}-{w}-{w}", "keyboard {w}", "the token {w}", "{w}_{w}_{w}()"]


def test_field_finds_forms_it_never_saw():
    """Precision and recall of the added spans on forms that no fixed pattern and no training phrase has."""
    r = random.Random(21)
    assert not set(HELD_OUT) & set(secret_scan.FORMS) and not set(HARMLESS) & set(secret_scan.DECOYS)
    prose = lambda n: [r.choice(("", "", "", "", "\n")) + "".join(r.choice(["ba", "no", "ti", "er", "su", "lé", "ing"]) for _ in range(r.randrange(1, 5))) + r.choice(["", "", "", ",", "."]) for _ in range(n)]
    windows = [(f, y) for d in range(300) for _, _, f, y in secret_scan.windows_of(d, " ".join(prose(80)))]
    tagger = secret_scan.Tagger(secret_scan.fit(windows))
    right = missed = wrong = 0
    for d in range(240):
        words = prose(60)
        form = r.choice(HELD_OUT if d % 2 else HARMLESS)
        phrase = secret_scan.Drawn(f"held-out {d}", words).phrase(form)
        assert not secret_scan.base_spans(phrase)
        text = " ".join([*words[:30], phrase, *words[30:]])
        found = [text[a:b] for a, _, b in tagger.spans(text, [])]
        if d % 2:
            value = phrase.split()[secret_scan.phrase_tags(form, phrase, True).index(1)]
            hit = sum(value.startswith(f) and len(f) >= len(value) - 2 for f in found)
            right, missed, wrong = right + bool(hit), missed + (not hit), wrong + len(found) - hit
        else:
            wrong += len(found)
    assert right >= 0.8 * (right + missed) and right >= 0.8 * (right + wrong), (right, missed, wrong)


def brute_items(index, text):
    """Items of which 0.8 of the shingles, and half of the answer's, stand in the text."""
    words = decontamination.words_of(text)
    return {i for i in range(len(index.items)) if (s := index.overlap(i, words))[0] >= 0.8 and s[1] >= 0.5}


def test_wand_equals_scoring_every_unit():
    r = random.Random(4)
    words = [f"w{i}" for i in range(120)] + ["the"] * 30 + ["of"] * 20
    index = decontamination.Index([(i, " ".join(r.choice(words) for _ in range(r.randrange(3, 80)))) for i in range(150)])
    for _ in range(60):
        terms = list(dict.fromkeys(index.terms[w] for _ in range(60) if (w := r.choice(words)) in index.terms))
        if r.random() < 0.7:
            terms = list(dict.fromkeys(terms + [index.terms[w] for w in r.choice(index.items)[1][:32]]))
        score = [0.0] * len(index.units)
        for t in terms:
            for units, impacts, _ in index.postings[t].values():
                for u, x in zip(units, impacts, strict=True):
                    score[u] += x
        assert sorted(index.search(terms, list(range(index.n_blocks)))) == [u for u, s in enumerate(score) if s >= decontamination.MIN_SCORE - 1e-9]


def test_bound_keeps_every_unit_that_reaches_the_threshold():
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["the"] * 60
    index = decontamination.Index([(i, " ".join(r.choice(words) for _ in range(r.randrange(10, 60)))) for i in range(100)])
    text = []
    for i in range(40):
        text += [r.choice(words) for _ in range(r.randrange(0, 90))] + index.items[i][1]
    ids = np.array([index.terms.get(w, len(index.terms)) for w in text])
    hopeful = index.hopeful(ids)
    for p in range(max(1, -(-len(text) // 32))):
        terms = [t for t in dict.fromkeys(ids[32 * p : 32 * p + 64].tolist()) if t < len(index.terms)]
        for u in index.search(terms, list(range(index.n_blocks))):
            assert u // decontamination.BLOCK in hopeful.get(p, [])


def test_decontamination_cases(spark):
    r = random.Random(6)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", f"z{r.randrange(900)}"]) for _ in range(n))
    items = [(i, prose(r.choice([15, 40, 59, 300]))) for i in range(25)] + [(100, "Two Words"), (101, ""), (102, None), (103, items_text := prose(30)), (104, items_text)]
    rows = [(i, prose(r.randrange(1, 500))) for i in range(20)]
    rows += [(50 + i, f"{prose(r.randrange(0, 200))} {t.upper()}, {prose(70)}") for i, (_, t) in enumerate(items[:25])]
    rows += [(90, None), (91, ""), (92, "here are two,\nwords alone"), (93, items_text), (93, items_text), (None, items_text)]
    df, bench = spark.createDataFrame([(*x, "e", "e") for x in rows], DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    index = decontamination.Index([(i, t) for i, t in items if t])
    want = sorted(((d, index.items[i][0]) for d, t in rows for i in brute_items(index, t or "")), key=repr)
    for slice_bytes in (decontamination.SLICE_BYTES, 3000):
        found = decontamination.contaminated(df, bench, slice_bytes)
        assert sorted(((x["doc_id"], x["item_id"]) for x in found.collect()), key=repr) == want
        clean = decontamination.drop_contaminated(df, bench, slice_bytes)
        assert clean.columns == df.columns
        assert sorted((x["doc_id"] for x in clean.collect())) == sorted(d for d, t in rows if not brute_items(index, t or ""))
    assert {50 + i for i in range(25)} <= {d for d, _ in want}
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0 and decontamination.contaminated(df.limit(0), bench).count() == 0
    assert decontamination.drop_contaminated(df, bench.limit(0)).count() == len(rows)


def test_character_counts(spark):
    df = spark.createDataFrame([("ab É!",), (None,), ("",)], "text string")
    counts = toxicity.character_counts(df)
    a, b = 1, 2
    assert counts[0, a, b] == 1 and counts[a, b, 0] == 1 and counts[b, 0, toxicity.OTHER] == 1 and counts[0, toxicity.OTHER, 0] == 1


def test_spelled_words():
    assert toxicity.spelled("you s t u p i d man a b".split()) == ["stupid"]
    assert toxicity.spelled("a b".split()) == [] and toxicity.spelled([]) == []


@pytest.fixture(scope="module")
def trained(spark):
    r = random.Random(7)
    plain = ["that", "other", "water", "letter", "under", "with", "these", "station", "moral", "order", "idle", "clown", "stop", "person", "loose"]
    bad = ["idiot", "moron", "stupid"]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "that other water")]
    labels += [(1000, None), (None, 1), (3, 0)]
    docs = spark.createDataFrame([(*x, "e", "e") for x in rows], DOCS)
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), labels


def test_toxicity_held_out(spark, trained):
    docs, labels, known = trained
    scorer = toxicity.learn(docs, labels)
    truth = {d: y for d, y in known if d is not None and d != 1000}
    rows = toxicity.score(docs, scorer).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    import zlib

    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    for written, word in (("1d1ot", "idiot"), ("m0ron", "moron"), ("s.t.u.p.i.d", "stupid"), ("idiooot", "idiot"), ("$tupid", "stupid"), ("water", "water"), ("water,", "water")):
        assert scorer.channel.word(written) == word
    hidden = "that other m0ron with these 1diot under s t u p i d water letter"
    assert scorer.score(hidden) > 0.5 > scorer.score("that other water with these letter under order water letter")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_one_doubled_letter_is_restored(spark, trained):
    docs, labels, _ = trained
    scorer = toxicity.learn(docs, labels)
    for written, word in (("stuupid", "stupid"), ("iddiot", "idiot"), ("morron", "moron"), ("cloown", "clown"), ("iddiot!", "idiot"), ("iddiot$", "idiot")):
        assert scorer.channel.word(written) == word == scorer.channel.word(written)
    assert [scorer.channel.word(w) for w in ("letter", "loose", "letter,", "water")] == ["letter", "loose", "letter", "water"]
    assert scorer.score("that other morron with these iddiot under stuupid water letter") > 0.5
    small = toxicity.Channel(scorer.channel.model, cache_size=2)
    assert [small.word(w) for w in ("stuupid", "iddiot", "morron", "stuupid")] == ["stupid", "idiot", "moron", "stupid"] and len(small.cache) == 2


def test_toxicity_without_labels(spark, trained):
    docs, labels, _ = trained
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels)).count() == 0


PAGES = [
    ("", ""), (None, ""), ("plain text", "plain text"), ("<p>hi", "hi"), ("a<!-- b", "a"), ("<p>x &amp; y&nbsp;z &lt;b&gt; &am</p>", "x & y z <b> &am"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=1>n</a></nav><article><h1>Head line</h1><p>One <b>bold</b>ed.<p>Two.<br>Three</article><footer>f</footer>",
     "Head line One bolded. Two. Three"),
    ("<body><div id='menu'><a href=1>m</a></div><div class='page with-sidebar'><h1>T</h1><p>First text of this page.</p><p>More of it.</p><div class='comments'><p>nice</p></div></div><div class=footer>c</div>",
     "T First text of this page. More of it."),
    ("<body><header><h2>Site</h2></header><main><header><h1>T</h1></header><p>Para one.</p><form><input><label>x</label></form><ul><li>l1<li>l2</ul></main><aside>s</aside>", "T Para one. l1 l2"),
    ("<body><script>var t='</p>';</script><div><p>Text one is here.</p><p>Text two is here.</p></div><ul><li><a href=1>aa</a><li><a href=2>bb</a><li><a href=3>cc</a></ul>", "Text one is here. Text two is here."),
    ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
    ("<p title='a>b'>quoted</p></p></i>", "quoted"),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_main_text(html, want):
    assert html_text.main_text(html or "") == want


def test_pages_table(spark):
    df = spark.createDataFrame([(i, None if i == 1 else "u", h, "x") for i, (h, _) in enumerate(PAGES)] * 2, "page_id int, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    assert got == sorted((i, w, len(w)) for i, (_, w) in enumerate(PAGES)) or got == sorted([(i, w, len(w)) for i, (_, w) in enumerate(PAGES)] * 2)
    assert html_text.extract(df.limit(0)).count() == 0


def test_page_text_equals_a_plain_reading():
    """Generated pages with a frame around: the article's blocks, all of them."""
    r = random.Random(9)
    for _ in range(40):
        blocks = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(1, 9))]
        body = "".join(r.choice(["<p>{}</p>", "<p>{}\n", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<p><i>{}</i></p>"]).format(re.sub(" ", r.choice([" ", "\n ", "  "]), b)) for b in blocks)
        wrap = r.choice(["<article>{}</article>", "<div class='post'>{}</div>", "<main><div>{}</div></main>"])
        page = f"<html><body><nav><ul><li><a href=1>a</a><li><a href=2>b</a></ul></nav><div class='ad'>Buy now</div>{wrap.format(body)}<footer>&copy; x</footer></body></html>"
        assert html_text.main_text(page) == " ".join(blocks)


SOURCES = "".join(f'<li><a href="/{i}">Source {i}</a></li>' for i in range(3))
LINKS = " ".join(f'<a href="/{i}">source number {i}</a>' for i in range(3))


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("inner, text", [
    (f"<ul>{SOURCES}</ul>", "Source 0 Source 1 Source 2"), (f"<p>{LINKS}</p>", "source number 0 source number 1 source number 2"),
    ('<section id="discussion"><h2>Discussion</h2><p>We discuss.</p></section>', "Discussion We discuss."), ('<h2 id="related-work">Related work</h2>', "Related work"),
    ('<p class="popular-science">Stars.</p>', "Stars."), ('<p class="notice">Mind this.</p>', "Mind this."), ('<div class="ad">Buy</div>', ""),
    ('<div class="comments"><p>First!</p></div>', ""), ('<div class="newsletter-signup">Sign up</div>', ""), ('<aside>Aside</aside>', ""), ('<form>Name</form>', "")])
def test_text_inside_articles_stays(tag, inner, text):
    before, after = "The article begins with a long sentence of many words. " * 3, "And it ends with another one of as many words. " * 3
    page = f"<html><body><nav><ul>{SOURCES}</ul></nav><{tag}><h1>Title</h1><p>{before}</p>{inner}<p>{after}</p></{tag}><div><ul>{SOURCES}</ul></div></body></html>"
    assert html_text.main_text(page) == " ".join(x for x in ("Title", before.strip(), text, after.strip()) if x)
